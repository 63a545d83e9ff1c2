"""Conversation repair against exhaustive search and a plain dynamic programme, and its edge cases."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import repair
from tidewatch.llm.queries import op13_repair

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("start", "s"): "s", ("start", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SPACES = " \t\n\v\f\r"


def every_script(turns, inserts=2):
    """(cost, audit) of all scripts with at most so many insertions in a row."""

    def go(i, state, run):
        if i == len(turns) and state in ("start", "a"):
            yield 0, ""
        if run < inserts:
            for c in "ua":
                if (state, c) in NEXT:
                    for cost, rest in go(i, NEXT[state, c], run + 1):
                        yield cost + 3, "I" + rest
        if i < len(turns):
            initial, gone, cut = turns[i]
            for cost, rest in go(i + 1, state, 0):
                yield cost + 4, "D" + rest
            if not gone:
                for c in "sua":
                    if (state, c) in NEXT and (c == initial or c != "s"):
                        for cost, rest in go(i + 1, NEXT[state, c], 0):
                            yield cost + (0 if c == initial else 3) + 3 * cut, ("K" if c == initial else "R") + rest

    return go(0, "start", 0)


def plain_repair(turns):
    """(cost, audit) by a table over turns and grammar states, filled from the end."""
    below = None
    for i in range(len(turns), -1, -1):
        row = {s: (0, "") if s in ("start", "a") else (10**9, "") for s in ("start", "s", "u", "a")} if below is None else {}
        if below is not None:
            initial, gone, cut = turns[i]
            for s in ("start", "s", "u", "a"):
                found = [(below[s][0] + 4, "D" + below[s][1])]
                if not gone:
                    for c in "sua":
                        if (s, c) in NEXT and (c == initial or c != "s"):
                            cost, rest = below[NEXT[s, c]]
                            found.append((cost + (0 if c == initial else 3) + 3 * cut, ("K" if c == initial else "R") + rest))
                row[s] = min(found)
        for _ in range(4):
            row = {s: min([v] + [(row[NEXT[s, c]][0] + 3, "I" + row[NEXT[s, c]][1]) for c in "ua" if (s, c) in NEXT]) for s, v in row.items()}
        below = row
    return below["start"]


def plain_report(rows):
    """op13's row of one conversation from its original (conv_id, turn, role, text) rows, in the order of their place."""
    after = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        after += [(turn, role, text)] * (2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, turns, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in after:
        fault = "blank" if not text.strip(SPACES) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACES)[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    known = [t for t, *_ in after if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    cost, audit = plain_repair(turns)
    out, left, want = [], iter(after), "u"
    for edit in audit:
        if edit == "I":
            role, text = {"u": "user", "a": "assistant"}[want], ""
        else:
            _, role, text = next(left)
            if edit == "D":
                continue
            if edit == "R":
                role = {"u": "user", "a": "assistant"}[want]
        out.append(f"{role}:{text}")
        want = "a" if role[:1] == "u" else "u"
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def random_turns(dice, n):
    return [(dice.choice("uuaaaust "), dice.random() < 0.15, dice.random() < 0.2) for _ in range(n)]


def test_tables_equal_exhaustive_search():
    dice = random.Random(5)
    for _ in range(300):
        turns = random_turns(dice, dice.randrange(0, 5))
        want = min(every_script(turns))
        assert plain_repair(turns) == want
        assert repair._best(repair.align(turns, (repair.START,), (repair.START, repair.AFTER_A))) == want, turns


def test_pieces_join_to_the_whole():
    dice = random.Random(6)
    for n in (1, 7, 64, 65, 130, 700):
        turns = random_turns(dice, n)
        c = repair._Conversation(("1", False))
        for initial, gone, cut in turns:
            c.add(initial, 1, gone, False, cut)
        assert repair._best(c.whole()) == plain_repair(turns)


ODD = [
    (1, 0, "user", "Hi there."), (1, 1, "assistant", "Hello!"), (2, None, "assistant", "no turn?"), (2, 5, None, "who?"), (2, 5, "user", None), (2, 9, "system", "Be good."), (2, 10, "user", "cut off"),
    (None, 0, "user", "Same."), (None, 1, "user", "Same."), (None, 1, "user", "Same."), (None, 2, "assistant", "   "), (3, None, "", "x.\n"), (3, None, "", "x.\n"), (4, 7, "tool", "é" * 70_000 + "."), (4, 8, "assistant", "ok. \t\n"),
]


def check(spark, folder, rows, schema=SCHEMA, extra=()):
    spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    got = op13_repair(spark, str(folder)).collect()
    want = {c: plain_report([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert len(got) == len(want)
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == want


def test_odd_rows(spark, tmp_path):
    check(spark, tmp_path, ODD)


def test_clashing_columns_and_empty_table(spark, tmp_path):
    check(spark, tmp_path / "a", ODD, SCHEMA + ", ck string, head long, audit string", ("x", 1, None))
    check(spark, tmp_path / "b", [])


def test_long_conversation_over_many_ranges(spark, tmp_path):
    dice = random.Random(7)
    texts = [f"text {k}{dice.choice(['.', '!', '', ' '])}" for k in range(500)]
    rows = [(8, k, dice.choice(["user", "assistant", "assistant", "system"]), dice.choice(texts)) for k in range(3000)]
    rows += [(c, k, ("user", "assistant")[k % 2], f"{c} and {k}.") for c in range(9, 40) for k in range(6)]
    rows += [(50, 1, "user", "again and again.")] * 2000 + [(50, 2, "assistant", "Yes.")]
    check(spark, tmp_path, rows)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_test_data(spark, sf):
    got = op13_repair(spark, f"/root/testdata/{sf}").collect()
    rows = {}
    for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, []).append((r.conv_id, r.turn, r.role, r.text))
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == {c: plain_report(x) for c, x in rows.items()}


def test_repaired_turns(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "More."), (1, 3, "user", "")], SCHEMA)
    got = repair.repaired(turns, repair.reports(turns)).orderBy("place").collect()
    # The second turn repeats the first and the last is blank; one new role costs less than two insertions.
    assert [(r.edit, r.role, r.text) for r in got] == [("R", "user", "Hello."), ("K", "assistant", "More.")]
    assert repair.reports(turns).select(F.sum("duplicate"), F.sum("blank")).first()[:] == (1, 1)
