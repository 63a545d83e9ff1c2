"""Queries whose results have to depend on all of the data."""

from tidewatch.operators import correlate as C
from tidewatch.events import events
from tidewatch.queries import backtests, logs, replay, windows

SF = "/root/testdata/sf0.001"


def test_empty_windows_count_all_events(spark):
    want = {(r["scenario"], r["k"]): r["count"] for r in windows.members(spark, SF).groupBy("scenario", "k").count().collect()}
    got = {(r["scenario"], r["k"]): r["event_count"] for r in windows.m5(spark, SF).collect()}
    assert {k: n for k, n in got.items() if n} == want
    assert len(got) == sum(1 + max(k for t, k in want if t == s) for s in {t for t, _ in want})


def test_long_paths(spark):
    nodes = spark.createDataFrame([("b", str(i)) for i in range(40)], "bundle string, id string")
    links = spark.createDataFrame([("b", str(i), str(i + 1)) for i in range(39)], "bundle string, src string, dst string")
    assert [r["path"] for r in C.paths(nodes, links, nodes.where("id = '0'")).collect()] == [[str(i) for i in range(40)]]


def test_rollout_is_classified(spark):
    rows = backtests.QUERIES["k40_open_loop_rollout"](spark, SF).collect()
    assert sorted(r["step"] for r in rows) == [1, 2, 3] and all(0 <= r["flagged"] <= r["windows"] and 0 < r["mean_score"] < 1 for r in rows)


def test_audit_and_weights_follow_the_tables(spark):
    fields = {"flow_window": ["bytes", "failed_auth"], "flow_per_flow": ["duration", "dport"], "packet": ["ttl", "payload_size", "retransmission"]}
    want = {}
    for r in events(spark, SF).collect():
        for tier, names in fields.items():
            for f in names:
                if r[f] is not None:
                    seen, n = want.get((r["scenario"], tier), (set(), 0))
                    want[r["scenario"], tier] = (seen | {f}, n + 1)
    assert {(r["scenario"], r["tier"]): (r["features"], r["values"]) for r in logs.b11(spark, SF).collect()} == {k: (len(seen), n) for k, (seen, n) in want.items()}
    top = [(r["feature"], r["weight"]) for r in replay.f4(spark, SF).collect()]
    assert len(top) == 3 and set(top).isdisjoint(replay.WEIGHTS.items()) and [abs(w) for _, w in top] == sorted((abs(w) for _, w in top), reverse=True)
