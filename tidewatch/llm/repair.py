"""Conversation structure repair by Wagner-Fischer target alignment.

The role initials of a sound conversation are ``(s?(ua)+)?``. Turns are aligned with every feasible length of that
alternating string. All lengths share one table: cell (i, r) is the least cost of turning the turns from i on into the
last r letters, so the string of length m starts at (0, m). A greedy repair gives the incumbent cost, and Ukkonen's band
keeps the cells whose insertions or deletions alone don't pass it. From each start of the least cost the table is traced
forwards, letter by letter in ASCII order; of the audits found, the ASCII-least counts.

Edits and their costs: Keep 0, Rerole to user or assistant 3, Delete 4 (the only edit of a blank or repeated turn), Insert
an empty user or assistant turn 3; a truncated turn that isn't deleted costs 3 more.

Scale: alignment works on narrow rows (no texts). They are range-partitioned by conversation and turn, so a conversation
of any length is spread over tasks. It is cut into pieces of PIECE turns; a piece is aligned once for every state in which
the grammar may enter and leave it, and pieces are joined by adding costs and audits, in each task first and then over
the tasks of a conversation, of which each gives one row. Of the edits of a piece with the same ends and cost none is a
prefix of another (it would hold insertions more), so the least audit of the whole is made of least audits.
Turns with equal text are counted, not listed. Texts are shuffled once, to be rewritten in order.

Order and defined results: turns are ordered by turn (nulls first), ties by role, then by the first 64 characters of the
text and its digest; so repeated rows lie side by side and all but the first are duplicates. A null role or text is one
space (so such a text is blank). Rows of a null conv_id form one conversation. Extra columns aren't read, whatever their
names. A conversation without a row left has no report here (``op13_repair`` adds zeros). An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns of a long conversation that are aligned in one table.
PIECE = 64
#: States of the grammar: nothing written, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = (START, AFTER_S, AFTER_U, AFTER_A)
ROLES = {"u": "user", "a": "assistant"}
SOUND = {"su", "ua", "au"}
FAR = 1 << 60
KEY = ["ck", "cn"]
PLACE = ["tn", "tk", "role", "head", "digest"]
REPORT = "illegal long, cost long, audit string"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of a conversation table after reproducible damage, nulls as one space; see op13's contract."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    hurt = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def conversation_key(df: DataFrame) -> DataFrame:
    return df.withColumns({"ck": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "cn": F.col("conv_id").isNull()})


def keyed(turns: DataFrame) -> DataFrame:
    """turns with columns without nulls to group and sort by."""
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return conversation_key(rows).withColumns(
        {"tn": F.col("turn").isNotNull(), "tk": F.coalesce(F.col("turn").cast("long"), F.lit(0)), "head": F.substring("text", 1, 64), "digest": F.md5("text")}
    )


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def counted(turns: DataFrame) -> DataFrame:
    """A narrow row per distinct turn: how often it stands there (n), and its faults."""
    rows = keyed(turns).withColumns({"blank": _blank(F.col("text")), "cut": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")})
    groups = rows.groupBy(*KEY, *PLACE).agg(F.count("*").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    # Only texts that stand at several turns have earlier copies elsewhere; few rows, so hot keys are those of real repeats.
    at = F.struct("tn", "tk")
    repeated = groups.groupBy(*KEY, "role", "digest").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at")).where("first_at <> last_at").drop("last_at")
    return groups.join(repeated, [*KEY, "role", "digest"], "left").select(
        *KEY, *PLACE, "n", "blank", "cut", F.coalesce(at > F.col("first_at"), F.lit(False)).alias("later")
    )


def _greedy(turns: list[tuple[str, bool, bool]], entry: int) -> int:
    """Cost of a plain repair, with two insertions more, that reach any exit: the incumbent."""
    cost, want = 0, "a" if entry == AFTER_U else "u"
    live = [t for t in turns if not t[1]]
    for k, (initial, _, cut) in enumerate(live):
        cost += TRUNCATED * cut
        if initial != want:
            after = "u" if want == "a" else "a"
            if k + 1 < len(live) and live[k + 1][0] == after or initial not in ("u", "a"):
                cost += REROLE
            else:
                cost += INSERT
                want = after
        want = "u" if want == "a" else "a"
    return cost + DELETE * (len(turns) - len(live)) + 2 * INSERT


class Table:
    """Costs of turning the turns from i on into the last r letters of a string that ends in ``last``, inside the band."""

    def __init__(self, turns: list[tuple[str, bool, bool]], last: str, incumbent: int):
        self.turns, self.last = turns, last
        forced = sum(t[1] for t in turns)
        slack = incumbent - DELETE * forced
        up, down = slack // INSERT, slack // DELETE
        self.low, self.rows = [0] * (len(turns) + 1), [[]] * (len(turns) + 1)
        other = "u" if last == "a" else "a"
        self.letters = (other, last)  # of r even, r odd
        left = 0
        for i in range(len(turns), -1, -1):
            if i < len(turns):
                left += not turns[i][1]
            low, high = max(0, left - down), left + up
            row = [FAR] * (high - low + 1)
            if i == len(turns):
                row = [INSERT * r for r in range(low, high + 1)]
            else:
                initial, gone, cut = turns[i]
                below, base = self.rows[i + 1], self.low[i + 1]
                for r in range(low, high + 1):
                    k = r - base
                    best = below[k] + DELETE if 0 <= k < len(below) else FAR
                    if r > low and row[r - low - 1] + INSERT < best:
                        best = row[r - low - 1] + INSERT
                    if not gone and r and 0 <= k - 1 < len(below):
                        kept = below[k - 1] + (KEEP if initial == self.letters[r & 1] else REROLE) + (TRUNCATED if cut else 0)
                        if kept < best:
                            best = kept
                    row[r - low] = best
            self.low[i], self.rows[i] = low, row

    def cost(self, i: int, r: int) -> int:
        k = r - self.low[i]
        return self.rows[i][k] if 0 <= k < len(self.rows[i]) else FAR

    def starts(self, i: int, parity: int, least: int) -> tuple[int, list[int]]:
        """The least cost from turn i on over the lengths of this parity and of ``least`` or more, and its lengths."""
        best, found = FAR, []
        low = self.low[i]
        for k, cost in enumerate(self.rows[i]):
            r = low + k
            if r % 2 == parity and r >= least:
                if cost < best:
                    best, found = cost, [r]
                elif cost == best < FAR:
                    found.append(r)
        return best, found

    def audit(self, i: int, r: int) -> str:
        """The ASCII-least cheapest edits from cell (i, r) on."""
        out, turns = [], self.turns
        while i < len(turns) or r:
            cost = self.cost(i, r)
            if i < len(turns) and self.cost(i + 1, r) + DELETE == cost:
                out.append("D")
                i += 1
            elif r and self.cost(i, r - 1) + INSERT == cost:
                out.append("I")
                r -= 1
            else:
                out.append("K" if turns[i][0] == self.letters[r & 1] else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def align(turns: list[tuple[str, bool, bool]], entries=STATES, exits=STATES) -> dict[tuple[int, int], tuple[int, str]]:
    """(entry, exit) -> (cost, audit) of turns given as (initial, must be deleted, truncated)."""
    out: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(entry: int, leave: int, cost: int, audit: str) -> None:
        if (entry, leave) not in out or (cost, audit) < out[entry, leave]:
            out[entry, leave] = (cost, audit)

    n = len(turns)
    for e in entries:
        if e in (START, AFTER_S) and e in exits:
            offer(e, e, DELETE * n, "D" * n)
    heads = [i for i, t in enumerate(turns) if t[0] == "s" and not t[1]] if START in entries else []
    if AFTER_S in exits:
        for i in heads:
            offer(START, AFTER_S, DELETE * (n - 1) + TRUNCATED * turns[i][2], "D" * i + "K" + "D" * (n - 1 - i))
    for leave, last in ((AFTER_U, "u"), (AFTER_A, "a")):
        if leave not in exits:
            continue
        table = Table(turns, last, max(_greedy(turns, e) for e in entries))
        wants_u = 0 if last == "a" else 1  # parity of the lengths whose first letter is u
        for e in entries:
            parity = 1 - wants_u if e == AFTER_U else wants_u
            least = 0 if e == leave else 1
            cost, lengths = table.starts(0, parity, least)
            for r in lengths:
                offer(e, leave, cost, table.audit(0, r))
        for i in heads:
            cost, lengths = table.starts(i + 1, wants_u, 1)
            cost += DELETE * i + TRUNCATED * turns[i][2]
            if lengths and ((START, leave) not in out or cost <= out[START, leave][0]):
                for r in lengths:
                    offer(START, leave, cost, "D" * i + "K" + table.audit(i + 1, r))
    return out


def joined(one: dict, two: dict) -> dict:
    """Edits of two neighbouring pieces."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for e in {k[0] for k in one}:
        for x in {k[1] for k in two}:
            found = [(one[e, m][0] + two[m, x][0], m) for m in STATES if (e, m) in one and (m, x) in two]
            if found:
                least = min(found)[0]
                out[e, x] = (least, min(one[e, m][1] + two[m, x][1] for cost, m in found if cost == least))
    return out


def _folded(parts: list[dict]) -> dict:
    """All parts joined, neighbours first, so that no text of edits is copied more than log2 times."""
    while len(parts) > 1:
        parts = [joined(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


class _Conversation:
    """What streams by of one conversation: its pieces, ends, and adjacent initials that the grammar forbids."""

    def __init__(self, key):
        self.key, self.turns, self.parts, self.illegal, self.first, self.last = key, [], [], 0, None, None

    def add(self, role: str, n: int, gone: bool, later: bool, cut: bool) -> None:
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in SOUND
        self.illegal += (n - 1) * (initial + initial not in SOUND)
        self.last = initial
        self.turns.append((initial, gone or later, cut))
        if n - 1 > PIECE:  # the rest are duplicates, deleted before anything else happens there
            self.flush()
            self.parts.append({(s, s): (DELETE * (n - 1), "D" * (n - 1)) for s in STATES})
            return
        self.turns += [(initial, True, False)] * (n - 1)
        if len(self.turns) >= PIECE:
            self.flush()

    def flush(self) -> None:
        if self.turns:
            self.parts.append(align(self.turns))
            self.turns = []

    def whole(self) -> dict:
        if not self.parts:
            return align(self.turns, (START,), (START, AFTER_A))
        return self.matrix()

    def matrix(self) -> dict:
        self.flush()
        return _folded(self.parts)


def _best(matrix: dict) -> tuple[int, str]:
    return min(matrix[START, x] for x in (START, AFTER_A) if (START, x) in matrix)


PIECES = "ck string, cn boolean, part int, whole boolean, first string, last string, illegal long, enters array<int>, leaves array<int>, costs array<long>, audits array<string>"
PIECE_SCHEMA = pa.schema(
    [("ck", pa.string()), ("cn", pa.bool_()), ("part", pa.int32()), ("whole", pa.bool_()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()),
     ("enters", pa.list_(pa.int32())), ("leaves", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)


def _piece_row(c: _Conversation, part: int, inner: bool) -> dict:
    if inner:
        cost, audit = _best(c.whole())
        matrix = {(START, START): (cost, audit)}
    else:
        matrix = c.matrix()
    return {
        "ck": c.key[0], "cn": c.key[1], "part": part, "whole": inner, "first": c.first, "last": c.last, "illegal": c.illegal,
        "enters": [k[0] for k in matrix], "leaves": [k[1] for k in matrix], "costs": [v[0] for v in matrix.values()], "audits": [v[1] for v in matrix.values()],
    }


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a range in, a row per conversation out. Only its first and its last one can go on in another range."""
    now, before, part, rows = None, 0, 0, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("ck", "cn", "role", "n", "blank", "later", "cut", "part")]
        for ck, cn, role, n, blank, later, cut, part in zip(*columns, strict=True):
            if now is None or now.key != (ck, cn):
                if now is not None:
                    rows.append(_piece_row(now, part, before > 0))
                    before += 1
                now = _Conversation((ck, cn))
            now.add(role, n, blank, later, cut)
        if len(rows) >= 500:
            yield pa.RecordBatch.from_pylist(rows, schema=PIECE_SCHEMA)
            rows = []
    if now is not None:
        rows.append(_piece_row(now, part, False))
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=PIECE_SCHEMA)


def _meet(key, pieces):
    """The rows of a conversation that lies in several ranges: one of each range."""
    import pandas as pd

    pieces = pieces.sort_values("part")
    matrices = [{(int(e), int(x)): (int(c), a) for e, x, c, a in zip(p.enters, p.leaves, p.costs, p.audits, strict=True)} for p in pieces.itertuples()]
    cost, audit = _best(_folded(matrices))
    seams = sum(a + b not in SOUND for a, b in zip(pieces["last"][:-1], pieces["first"][1:], strict=True))
    return pd.DataFrame({"ck": [key[0]], "cn": [bool(key[1])], "illegal": [int(pieces.illegal.sum()) + seams], "cost": [cost], "audit": [audit]})


def alignments(rows: DataFrame) -> DataFrame:
    """ck, cn, illegal, cost and audit of each conversation of ``counted`` rows."""
    bounded_batches(rows.sparkSession, 4000)
    order = [*KEY, *PLACE]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    pieces = stored(ranges.mapInArrow(_aligned, PIECES), "repair-pieces")
    whole = pieces.where("whole").select(*KEY, "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    open_ones = pieces.where("NOT whole").groupBy(*KEY).applyInPandas(_meet, f"ck string, cn boolean, {REPORT}")
    return whole.unionByName(open_ones)


def reports(turns: DataFrame) -> DataFrame:
    """A row per conversation with turns: gaps, blank, duplicate, truncated, illegal, cost, audit (and ck, cn, its key)."""
    rows = stored(counted(turns), "repair-turns")
    fresh = F.when(F.col("blank") | F.col("later"), 0).otherwise(1)  # of n equal turns one at most isn't a duplicate
    per_turn = rows.groupBy(*KEY, "tn", "tk").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"), F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - fresh)).alias("duplicate"),
        F.sum(F.when(F.col("cut"), fresh).otherwise(0)).alias("truncated"),
    )
    known = F.when(F.col("tn"), F.col("tk"))
    faults = per_turn.groupBy(*KEY).agg(
        F.coalesce(F.max(known) - F.min(known) + 1 - F.count(known), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    return faults.join(alignments(rows), KEY)


SHOWN = ["ck", "cn", "kind", "role", "text", "audit"]


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of sorted rows, a conversation's audit before its turns: (key, edit, role, text) of each edit but deletions, (key,) at its end."""
    key, audit, at, want = None, "", 0, "u"

    def inserted():
        nonlocal at, want
        while at < len(audit) and audit[at] == "I":
            yield key, "I", ROLES[want], ""
            at, want = at + 1, "u" if want == "a" else "a"

    for batch in batches:
        for ck, cn, kind, role, text, given in zip(*(batch.column(c).to_pylist() for c in SHOWN), strict=True):
            if kind == 0:
                if key is not None:
                    yield from inserted()
                    yield (key,)
                key, audit, at, want = (ck, cn), given, 0, "u"
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES[want]
            yield key, edit, role, text
            want = "a" if role[:1] == "u" else "u"
    if key is not None:
        yield from inserted()
        yield (key,)


def _rows(batches):
    out, place, held = [], 0, 0
    schema = pa.schema([("ck", pa.string()), ("cn", pa.bool_()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    for edit in _edits(batches):
        if len(edit) == 1:
            place = 0
            continue
        (ck, cn), letter, role, text = edit
        out.append({"ck": ck, "cn": cn, "place": place, "edit": letter, "role": role, "text": text})
        place, held = place + 1, held + len(text)
        if len(out) >= 1000 or held > 1 << 23:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _digests(batches):
    out, sha, empty = [], hashlib.sha256(), True
    schema = pa.schema([("ck", pa.string()), ("cn", pa.bool_()), ("repaired_sha256", pa.string())])
    for edit in _edits(batches):
        if len(edit) == 1:
            out.append({"ck": edit[0][0], "cn": edit[0][1], "repaired_sha256": sha.hexdigest()})
            sha, empty = hashlib.sha256(), True
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
            continue
        sha.update((("" if empty else "\n") + edit[2] + ":").encode())
        sha.update(edit[3].encode())
        empty = False
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _stream(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Audits and turns of each conversation, in order: read as a stream, so a long conversation needs no more memory than its audit."""
    bounded_batches(turns.sparkSession)
    heads = audits.select(*KEY, F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("tn", "boolean"), ("tk", "long"), ("role", "string"), ("head", "string"), ("digest", "string"), ("text", "string"))], "audit")
    rows = keyed(turns).select(*KEY, F.lit(1).alias("kind"), *PLACE, "text", F.lit(None).cast("string").alias("audit"))
    both = heads.unionByName(rows).repartition(*KEY).sortWithinPartitions(*KEY, "kind", *PLACE)
    return both.select(*SHOWN)


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired turns: ck, cn, place (from 0), edit (K, R or I), role, text."""
    return _stream(turns, audits).mapInArrow(_rows, "ck string, cn boolean, place long, edit string, role string, text string")


def digests(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """SHA-256 of the repaired turns of each conversation, ``role:text`` joined by newlines."""
    return _stream(turns, audits).mapInArrow(_digests, "ck string, cn boolean, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """op13's rows: every conv_id of the table, with the repair of its damaged turns."""
    turns = damaged(conversations)
    found = stored(reports(turns), "repair-reports")
    ids = conversation_key(conversations.select("conv_id").distinct())
    both = found.join(digests(turns, found), KEY)
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(both, KEY, "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    )
