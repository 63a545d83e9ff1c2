"""Replay, survival, drift, counterfactual and registry cases worked out by hand."""

import math

from tidewatch.operators import logs, replay, scores, whatif


def walked(spark, truth, p, horizon):
    rows = [("s", i, float(x), "Exfiltration" if t else "Benign", bool(t)) for i, (t, x) in enumerate(zip(truth, p, strict=True))]
    return replay.replay(spark.createDataFrame(rows, "scenario string, idx long, p double, stage string, infiltration boolean"), horizon, 0.5)


def test_replay_of_one_scenario(spark):
    # 8 states, attack from 3 on; horizon 2: states 1 to 5 are walked
    rows = walked(spark, [0, 0, 0, 1, 1, 1, 0, 0], [0.9, 0.1, 0.7, 0.2, 0.1, 0.8, 0.9, 0.9], 2).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == [1, 2, 3, 4, 5]
    assert [r["realized"] for r in rows] == [True, True, True, True, False]
    assert [r["phase"] for r in rows] == ["PRE_ONSET", "PRE_ONSET", "DURING_ATTACK", "DURING_ATTACK", "POST_ATTACK"]
    assert [r["lead"] for r in rows] == [None, 0, None, None, None]
    assert [r["next_crossing"] for r in rows] == [2, 2, 5, 5, 5]
    records = replay.survival_records(walked(spark, [0, 0, 0, 1, 1, 1, 0, 0], [0.9, 0.1, 0.7, 0.2, 0.1, 0.1, 0.9, 0.9], 2)).orderBy("idx").collect()
    assert [(r["idx"], r["duration"], r["event"]) for r in records] == [(1, 1, True), (2, 0, True), (3, 3, False), (4, 2, False)]


def test_lead_counts_from_the_first_window_ahead(spark):
    rows = walked(spark, [0, 0, 0, 0, 1], [0.9] * 5, 3).orderBy("idx").collect()
    assert [(r["idx"], r["realized"], r["lead"]) for r in rows] == [(1, True, 2)]


def test_values_on_an_edge_belong_below_it(spark):
    frame = lambda values: spark.createDataFrame([("f", float(v)) for v in values], "feature string, value double")
    reference = frame(range(1, 11))
    edges = scores.psi_edges(reference)
    assert edges.first()["edges"] == [float(i) for i in range(1, 10)]
    assert scores.psi(edges, reference, frame(range(1, 11)), []).first()["psi"] == 0.0
    moved = scores.psi(edges, reference, frame([1] * 5 + [10] * 5), []).first()["psi"]
    part = (0.5 - 0.1) * math.log(5)
    assert abs(moved - (2 * part + 8 * (1e-6 - 0.1) * math.log(1e-6 / 0.1))) < 1e-5


def test_null_limit_is_picked_by_rounded_rank(spark):
    blocks = spark.createDataFrame([("f", d, float(d)) for d in range(1, 7)], "feature string, day long, psi double")
    assert scores.null_band(blocks, 0.9).first()["limit"] == 5.0  # round(0.9 * 5) = 4, from 0
    row = scores.banded(spark.createDataFrame([("f", 9, 4.0)], "feature string, day long, psi double"), blocks, ["day"], 0.9).first()
    assert (row["percentile"], row["band"]) == (66.7, "within_null")


def test_running_sums_hold_any_number_of_values(spark):
    rows = spark.range(5000).selectExpr("id % 2 AS g", "CAST(id * 7919 % 5000 AS DOUBLE) AS v", "1 AS one")
    for down in (False, True):
        got = {(r["g"], r["v"]): r["one_before"] for r in scores.running(rows, "v", ["one"], ["g"], down).collect()}
        for g in (0, 1):
            values = sorted((v for h, v in got if h == g), reverse=down)
            assert [got[g, v] for v in values] == list(range(2500))


def test_counterfactual_takes_the_largest_parts_in_turn(spark):
    parts = [("a", 3.0, 1.0), ("b", -4.0, 1.0), ("c", 2.0, -1.0), ("d", 1.0, 1.0)]
    frame = spark.createDataFrame([(1, *p) for p in parts], "k long, feature string, contribution double, weight double")
    row = whatif.counterfactual(frame, ["k"], 0.0, -3.0).first()  # logit 2, gap 5: b can't help, a gives 3, c gives all of its 2
    assert (row["logit"], row["needed"], row["reduced"], row["reached"]) == (2.0, 5.0, 5.0, True)
    row = whatif.counterfactual(frame, ["k"], 0.0, -4.0).first()
    assert (row["reduced"], row["reached"]) == (5.0, False)
    assert whatif.counterfactual(frame, ["k"], 0.0, 3.0).first()["reduced"] == 0.0


def test_registry_refuses_steps_out_of_order(spark):
    log = [("m", i, a) for i, a in enumerate(["register", "rollback", "approve", "approve", "rollback", "approve"])] + [("n", 0, "approve"), ("n", 1, "register")]
    got = {r["version"]: (r["status"], r["refused"]) for r in logs.registry_state(spark.createDataFrame(log, "version string, at long, action string"), "version", "at").collect()}
    assert got == {"m": ("rolled_back", 3), "n": ("registered", 1)}
