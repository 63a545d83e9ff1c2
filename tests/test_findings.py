"""Findings' evidence, warnings and assets, the sequence finding and the feature policy, computed by hand."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import detect as D
from tidewatch.operators import windows as W
from tidewatch.operators.correlate import NEXT_TRANSITIONS


@pytest.fixture(scope="module")
def scored(spark):
    schema = (
        "scenario long, k long, idx long, event_count long, flow_count long, bytes double, failed_auth double, rst_count double, probe_share double, max_fanout long, edge_entropy double, domain_length double, tunnel double, beacon double, execs double, "
        "known_edges long, known_bytes double, new_edges long, matches long, z_rate double, z_total double, z_bits double, p_ddos double, start long"
    )
    rows = [
        (1, 0, 0, 10, 4, 600.0, None, None, 0.25, 2, None, None, None, None, None, 0, 0.0, 3, None, 0.0, 0.0, 0.0, 0.0, 3_600_000_000 * 25),
        (1, 5, 5, 10, 6, 1200.0, 2.0, 3.0, 0.5, 4, 1.5, 30.0, None, 0.4, 0.5, 2, 90.0, 1, 2, 6.0, 4.0, -2.0, 0.95, 3_600_000_000 * 30),
    ]
    return spark.createDataFrame(rows, schema)


def test_evidence(scored):
    got = {(r["k"], r["detector"], r["name"]): r["observed"] for r in D.evidence(scored, 60.0).collect()}
    assert not [x for x in got if x[0] == 0 and x[1] in ("phishing", "malware_activity", "command_and_control")]
    assert (0, "exfiltration", "bytes_zscore") not in got and (0, "ddos", "bytes_per_second") not in got and got[0, "insider_threat", "window_hour_utc"] == 1
    assert got[5, "ddos", "flows_per_second"] == 0.1 and got[5, "ddos", "bytes_per_second"] == 20 and got[5, "reconnaissance", "rst_probe_ratio"] == 0.5
    assert got[5, "credential_abuse", "failed_auth_per_min"] == 12 and got[5, "lateral_movement", "known_edge_bytes_per_sec"] == 1.5 and got[5, "exfiltration", "intel_matches"] == 2
    assert got[5, "command_and_control", "intel_matches"] == 2 and (5, "command_and_control", "c2_beacon_score") not in got
    assert got[5, "phishing", "tunnel_marker_share"] == 0 and got[5, "malware_activity", "process_executions"] == 5 and got[5, "entropy_anomaly", "entropy_deviation"] == -2
    assert D.evidence(scored.limit(0), 60.0).count() == 0


def test_warnings(scored):
    got = {(r["k"], r["detector"], r["warning"]) for r in D.warnings(scored, 60.0, baseline=True, stale=True).collect()}
    assert {x[2] for x in got} <= set(D.WARNINGS)
    assert sum(x[2] == "short_history" for x in got) == 10 and not [x for x in got if x[0] == 5 and x[2] in ("short_history", "no_known_edges", "no_deployment_baseline")]
    assert {(0, "phishing", "no_dns_data"), (5, "phishing", "dns_only"), (5, "exfiltration", "feed_stale"), (5, "ddos", "flood_unvalidated"), (0, "command_and_control", "no_beacon_data")} <= got


def test_affected_assets(spark):
    fresh = spark.createDataFrame([(1, 0, "a", True), (1, 1, "a", False), (1, 1, "b", True), (1, 2, "c", False)], "scenario long, k long, entity string, fresh boolean")
    registry = spark.createDataFrame([("a", "critical"), ("a", "critical"), ("c", "low")], "asset_id string, criticality string")
    assert sorted(map(tuple, D.affected_assets(fresh, registry).collect())) == [(1, 0, "a", True, True), (1, 1, "a", False, True), (1, 1, "b", True, False)]


def test_lateral_by_baseline(spark):
    rates = spark.createDataFrame([(1, 0, 0, None), (1, 5, 5, 10.0), (1, 6, 6, 20.0)], "scenario long, k long, idx long, rate double")
    fitted = rates.where("false").agg(F.lit(10.0).alias("median"), F.lit(1.349).alias("mad"))
    got = {r["k"]: (r["probability"], r["is_alert"], r["sigma"]) for r in D.lateral_by_baseline(rates, fitted).collect()}
    assert got == {0: (0.0, False, None), 5: (0.0, False, 0.0), 6: (0.667, False, 5.0)}


def test_sequence(spark):
    moves = spark.createDataFrame([(*t, i) for i, t in enumerate(NEXT_TRANSITIONS)], "current string, next string, p double, place int")
    rows = [(1, 0, 0, "reconnaissance", True), (1, 0, 0, "credential_abuse", True), (1, 0, 0, "exfiltration", False), (1, 1, 1, "ddos", True), (1, 2, 2, "ddos", True), (1, 2, 2, "phishing", True)]
    found = spark.createDataFrame(rows, "scenario long, k long, idx long, detector string, is_alert boolean").withColumn("attack_type", F.col("detector"))
    got = {r["k"]: (r["attack_type"], r["transition"]) for r in D.sequence_findings(D.alert_places(found), moves).collect()}
    # window 0: lateral .70 + .15 / 2 against credential .85 / 2; window 2: phishing leads nowhere, so the flood's step at half weight
    assert got == {0: ("lateral_movement", 0.70), 2: ("credential_abuse", 0.0)}


def test_policy_and_fragments(spark):
    schema = "scenario long, k long, x double, y double, header_flags int, ip_flags int"
    rows = spark.createDataFrame([(1, 0, 1.0, None, None, 0x4000), (1, 0, 3.0, None, None, 0), (1, 1, 5.0, 2.0, 0x2000, 0x4000), (1, 2, None, None, None, None)], schema)
    got = {r["k"]: r.asDict() for r in W.policy_features(rows, {"x": "sum mean std p50 entropy nunique", "y": "sum nunique"}).collect()}
    assert got[0] == {"scenario": 1, "k": 0, "x_sum": 4.0, "x_mean": 2.0, "x_std": pytest.approx(2**0.5), "x_p50": 2.0, "x_entropy": 1.0, "x_nunique": 2, "y_sum": None, "y_nunique": None}
    assert got[1]["x_std"] is None and got[1]["x_entropy"] is None and got[1]["y_nunique"] == 1 and got[2]["x_sum"] is None
    flags = {r["k"]: (r["frag_df_share"], r["frag_mf_share"]) for r in W.fragments(rows).collect()}
    assert flags == {0: (0.5, 0.0), 1: (0.0, 1.0), 2: (0.0, 0.0)}
