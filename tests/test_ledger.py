"""Canonical JSON and hash-chained logs against the standard library."""

import hashlib
import json

from pyspark.sql import functions as F

from tidewatch.functions.scalars import canonical_json
from tidewatch.operators import logs as L
from tidewatch.operators import replay as R

TEXTS = ["plain", "", None, 'q"uote \\ back', "line\nfeed\ttab\r\b\f", "é ü 漢", "pair 😀 end", "\x01\x0b\x1f\x7f", "/slash", "\\u000B literal"]


def canonical(record):
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def test_canonical_json_equals_the_library(spark):
    rows = [(i, t, i % 2 == 0 if i % 3 else None) for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "n long, text string, flag boolean")
    fields = {"text": (F.col("text"), "string"), "n": (F.col("n"), "number"), "flag": (F.col("flag"), "boolean")}
    got = {r["n"]: r["j"] for r in frame.select("n", canonical_json(fields).alias("j")).collect()}
    assert got == {n: canonical({"n": n, "text": t, "flag": f}) for n, t, f in rows}


def test_ledger(spark):
    previous, rows = L.GENESIS, []
    for n in range(6):
        record = {"alert": f"a{n}", "text": TEXTS[n], "previous_hash": previous}
        digest = hashlib.sha256(canonical(record).encode()).hexdigest()
        rows.append(["log", n, f"a{n}", TEXTS[n], previous, digest])
        previous = digest
    schema = "log string, n long, alert string, text string, previous_hash string, record_hash string"
    fields = {"alert": (F.col("alert"), "string"), "text": (F.col("text"), "string"), "previous_hash": (F.col("previous_hash"), "string")}

    def check(changed):
        seen = L.verify_chain(spark.createDataFrame([tuple(r) for r in changed], schema), "log", "n", fields)
        summary = L.ledger_summary(seen, "log").first()
        errors = [r["error"] for r in L.ledger_errors(seen, "log", "alert").orderBy("place", F.col("error").desc()).collect()]
        assert summary["records_checked"] == len(changed) and summary["errors"] == len(errors) and summary["valid"] == (not errors)
        return errors

    assert check(rows) == []
    tampered = [list(r) for r in rows]
    tampered[2][3] = "other"
    assert check(tampered) == ["record 3 (a2): record hash mismatch"]
    tampered = [list(r) for r in rows]
    tampered[5][5] = "0" * 64
    assert check(tampered) == ["record 6 (a5): record hash mismatch"]
    tampered[3][5] = "1" * 64
    assert check(tampered) == ["record 4 (a3): record hash mismatch", "record 5 (a4): broken previous-hash link", "record 6 (a5): record hash mismatch"]
    assert check(rows[1:]) == ["record 1 (a1): broken previous-hash link"]


def test_supporting_entities(spark):
    import random

    dice = random.Random(2)
    names = {i: sorted({f"h{dice.randrange(60):02d}" for _ in range(dice.choice([0, 1, 4, 40]))}) for i in range(30)}
    states = spark.createDataFrame([(1, i) for i in names], "scenario long, idx long")
    entities = spark.createDataFrame([(1, i, e) for i, es in names.items() for e in es], "scenario long, idx long, entity string")
    got = {r["idx"]: r["entities"] for r in R.supporting(states, entities).collect()}
    for i in names:
        want = list(dict.fromkeys(e for j in range(max(0, i - 2), i + 1) for e in names[j]))[:10]
        assert got[i] == want


def test_normal_quantile(spark):
    from statistics import NormalDist

    from tidewatch.functions.scalars import normal_quantile

    ps = [0.0001, 0.02, 0.02425, 0.1, 0.5, 0.8, 0.975, 0.98, 0.9999]
    got = {r["p"]: r["z"] for r in spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()}
    assert all(abs(got[p] - NormalDist().inv_cdf(p)) < 3e-9 * max(1, abs(got[p])) for p in ps) and got[0.0] is None and got[1.0] is None


def test_next_techniques(spark):
    from tidewatch.operators import correlate as C

    model = spark.createDataFrame([("a", "b", 0.7), ("a", "c", 0.2), ("a", "d", 0.1), ("x", "b", 1.0)], "source string, target string, probability double")
    prior = spark.createDataFrame([("p", "q", 0.4), ("a", "z", 0.9)], "source string, target string, probability double")
    starts = C.start_model(spark.createDataFrame([(["a", "b"],), (["a"],), (["x"],), ([],)], "techniques array<string>"))
    observed = spark.createDataFrame([(1, "a"), (2, None), (3, "p"), (4, "unknown")], "id int, last string")
    got = {(r["id"], r["rank"]): (r["target"], round(r["probability"], 6), r["origin"]) for r in C.next_techniques(model, starts, prior, observed, "id", 2).collect()}
    assert got == {(1, 1): ("b", 0.7, "model"), (1, 2): ("c", 0.2, "model"), (2, 1): ("a", 0.666667, "start"), (2, 2): ("x", 0.333333, "start"), (3, 1): ("q", 0.4, "prior")}


def test_recalibration_gate_checks_the_order(spark):
    from tidewatch.operators import learn

    rows = [(i / 100, i / 100 * 0.9, i % 3 == 0) for i in range(101)]
    frame = lambda r: spark.createDataFrame(r, "score double, calibrated double, truth boolean")
    assert learn.order_kept(frame(rows)).first()[0]
    for at in (50, 51):
        fallen = [(s, c - (0.05 if k == at else 0), t) for k, (s, c, t) in enumerate(rows)]
        assert not learn.order_kept(frame(fallen)).first()[0] and not learn.gate(frame(fallen)).first()["ship"]
    close = [(0.5 + i / 1e5, 0.4 - i / 1e5, True) for i in range(5)]  # inside one cell
    assert not learn.order_kept(frame(close)).first()[0]


def test_running_sums_with_many_cuts(spark):
    from tidewatch.operators import scores

    cuts = [i / 1000 for i in range(700)]
    frame = spark.createDataFrame([(-1.0,), (0.0,), (0.0005,), (0.2561,), (0.5, ), (0.699,), (0.9,)], "v double")
    got = {r["v"]: r["n"] for r in frame.select("v", scores.below(cuts, F.col("v")).alias("n")).collect()}
    assert got == {v: sum(c < v for c in cuts) for v in got}
    few = {r["v"]: r["n"] for r in frame.select("v", scores.below(cuts[:3], F.col("v")).alias("n")).collect()}
    assert few == {v: sum(c < v for c in cuts[:3]) for v in few} and frame.select(scores.below([], F.col("v")).alias("n")).agg(F.max("n")).first()[0] == 0


def test_active_keys(spark):
    rows = [
        ("a", 1, "viewer", None, False), ("a", 2, "admin", None, None), ("b", 1, "viewer", None, False), ("b", 2, "viewer", None, True),
        ("c", 1, "viewer", None, True), ("c", 3, "analyst", 101, False), ("d", 1, "viewer", 100, False), ("e", 5, "admin", 99, False), ("e", 4, "admin", 500, False), (None, 1, "viewer", 200, False),
    ]
    log = spark.createDataFrame(rows + rows[:1], "key_id string, place long, role string, expires long, revoked boolean")
    got = {tuple(r) for r in L.active_keys(log, F.lit(100)).collect()}
    assert got == {("a", "admin", None), ("c", "analyst", 101), (None, "viewer", 200)}
    assert L.active_keys(log.limit(0), F.lit(100)).count() == 0
