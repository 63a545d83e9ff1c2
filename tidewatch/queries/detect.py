"""History, detectors and correlation: B5 to B8, C5 to C8, C13, D32, E2, E3, E11, E12, E14, I1 to I17, J1 to J5, J7, J8, F3, F6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..events import SECONDS, STRIDE, WIDTH, events
from ..functions import scalars as S
from ..operators import correlate as C
from ..operators import detect as D
from ..operators import windows as W
from ..plans.tables import stored
from .windows import EDGES, edge_table, members, rounded

QUERIES, ORACLE_SQL = {}, {}
GAP = 300_000_000


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def bounds(start: str) -> str:
    return f"scenario, k, {start}"


STATES = EDGES + """,
ef AS (SELECT scenario, k, avg(CAST(events > 0 AND bytes / events < 200 AS DOUBLE)) AS probe_share, count(*) AS edge_count FROM edge GROUP BY scenario, k),
ff AS (SELECT scenario, k, max(n) AS max_fanout FROM (SELECT scenario, k, src, count(*) AS n FROM edge GROUP BY ALL) GROUP BY scenario, k),
eb AS (SELECT scenario, k, greatest(0, log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS edge_entropy FROM (SELECT scenario, k, bytes, count(*) AS n FROM edge WHERE bytes > 0 GROUP BY ALL) GROUP BY scenario, k),
ad AS (SELECT scenario, k, count(*) AS event_count, count(*) FILTER (kind = 'flow') AS flow_count, sum(bytes) AS bytes, sum(failed_auth) AS failed_auth, sum(CAST((tcp_flags & 4) <> 0 AS DOUBLE)) AS rst_count, sum(retransmission) AS retransmission, sum(domain_length) AS domain_length,
 sum(tunnel) AS tunnel, sum(beacon) AS beacon, sum(execs) AS execs, max(origin) AS origin FROM mem GROUP BY scenario, k),
st AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY k) - 1 AS idx FROM ad JOIN ef USING (scenario, k) JOIN ff USING (scenario, k) LEFT JOIN eb USING (scenario, k)),
ek AS (SELECT *, coalesce(idx - lag(idx) OVER (PARTITION BY scenario, src, dst ORDER BY idx) <= 5, false) AS known FROM (SELECT edge.*, st.idx FROM edge JOIN st USING (scenario, k))),
kr AS (SELECT scenario, k, idx, sum(CASE WHEN known THEN bytes ELSE 0 END) AS known_bytes, count(*) FILTER (known) AS known_edges, count(*) FILTER (NOT known) AS new_edges,
 CASE WHEN idx >= 3 THEN sum(CASE WHEN known THEN bytes ELSE 0 END) / 21600.0E0 END AS rate FROM ek GROUP BY scenario, k, idx),
en AS (SELECT DISTINCT scenario, k, unnest([src, dst]) AS entity FROM edge),
feed AS (SELECT 'user-' || c_custkey AS indicator, c_mktsegment AS list_type FROM customer WHERE c_custkey % 29 = 0),
hit AS (SELECT scenario, k, count(DISTINCT entity) AS matches, arg_min(list_type, entity) AS first_type FROM en JOIN feed ON entity = indicator GROUP BY scenario, k)"""


def exact(sql: str) -> str:
    """sql with the edges' entropy over bytes at six digits, as edge_features takes it."""
    return sql.replace("SELECT scenario, k, bytes, count(*) AS n FROM edge", "SELECT scenario, k, round(bytes, 6) AS bytes, count(*) AS n FROM edge")


def z_sql(value: str, name: str) -> str:
    v, w = f"coalesce({value}, 0)", "OVER h"
    return f"CASE WHEN count({v}) {w} < 3 THEN 0 WHEN min({v}) {w} = max({v}) {w} THEN CASE WHEN {v} = min({v}) {w} THEN 0 ELSE 6 END ELSE ({v} - avg({v}) {w}) / stddev_pop({v}) {w} END AS {name}"


def band_sql(v: str, warn: float, alert: float) -> str:
    return f"(CASE WHEN {v} >= {alert}E0 THEN 1 WHEN {v} <= {warn}E0 THEN 0 WHEN {v} IS NOT NULL THEN ({v} - {warn}E0) / ({alert}E0 - {warn}E0) END)"


SCORED = STATES + f""",
z AS (SELECT st.*, rate, matches, {z_sql('flow_count / 21600.0E0', 'z_flow')}, {z_sql('bytes / 21600.0E0', 'z_byte')}, {z_sql('bytes', 'z_total')}, {z_sql('edge_entropy', 'z_bits')}
 FROM st LEFT JOIN (SELECT scenario, k, rate FROM kr) USING (scenario, k) LEFT JOIN hit USING (scenario, k) WINDOW h AS (PARTITION BY scenario ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, least(1, greatest(0, z_total) / 10) AS spike, least(0.9E0, greatest(0, z_total) / 6) AS inside FROM z),
x AS (SELECT *, CASE WHEN idx < 3 THEN least(0.5E0, greatest(spike, {band_sql('bytes', 75000.0, 150000.0)})) ELSE spike END AS exfil FROM y),
p AS (SELECT *, least(0.95E0, greatest(0, greatest(z_flow, z_byte)) / 6) AS p_ddos, {band_sql('least(1, rst_count / greatest(1, flow_count))', 0.10, 0.30)} AS p_reconnaissance,
 {band_sql('(failed_auth * flow_count * 60 / 21600.0E0)', 1.0, 2.0)} AS p_credential_abuse, coalesce({band_sql('rate', 750.0, 900.0)}, 0) AS p_lateral_movement,
 CASE WHEN matches IS NOT NULL THEN 0.85E0 ELSE coalesce({band_sql('beacon', 0.30, 0.60)}, 0) END AS p_command_and_control, CASE WHEN matches IS NOT NULL THEN greatest(exfil, 0.9E0) ELSE exfil END AS p_exfiltration,
 CASE WHEN idx < 3 THEN least(0.5E0, inside) ELSE inside END AS p_insider_threat, coalesce(greatest({band_sql('domain_length', 25.0, 45.0)}, {band_sql('coalesce(tunnel, 0)', 0.10, 0.30)}), 0) AS p_phishing,
 coalesce({band_sql('(execs * event_count)', 2.0, 5.0)}, 0) AS p_malware_activity, least(0.9E0, abs(z_bits) / 4.8E0) AS p_entropy_anomaly FROM x)"""

FOUND = SCORED + ",\nfi AS (" + " UNION ALL ".join(
    f"SELECT scenario, k, idx, origin, '{n}' AS detector, '{'reconnaissance' if n == 'entropy_anomaly' else n}' AS attack_type, '{D.TECHNIQUES[n]}' AS technique, p_{n} AS p, {at}E0 AS lim FROM p" for n, at in D.ALERT_AT.items()
) + """),
fd AS (SELECT scenario, k, idx, origin, detector, attack_type, technique, round_even(p, 3) AS probability, CASE WHEN p >= 0.85 THEN 'critical' WHEN p >= 0.65 THEN 'high' WHEN p >= 0.40 THEN 'medium' ELSE 'low' END AS severity,
 CASE WHEN p >= 0.85 THEN 'high' WHEN p >= 0.5 THEN 'medium' ELSE 'low' END AS confidence, p >= lim AS is_alert FROM fi)"""


def state_table(spark, sf_dir, edges=None):
    return W.states(members(spark, sf_dir), edge_table(spark, sf_dir) if edges is None else edges)


def feed_table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 29 = 0").select(F.concat(F.lit("user-"), F.col("c_custkey")).alias("indicator"), F.col("c_mktsegment").alias("list_type"))


def known_edges(spark, sf_dir):
    edges = stored_edges(spark, sf_dir)
    return D.seen_edges(edges, state_table(spark, sf_dir, edges))


def stored_edges(spark, sf_dir):
    """The edges of all windows, written once: states, known edges, entities and hits all come from them."""
    return stored(edge_table(spark, sf_dir), "edges")


def hits_table(spark, sf_dir, edges=None):
    return D.ioc_hits(W.entities(edge_table(spark, sf_dir) if edges is None else edges), feed_table(spark, sf_dir))


def scored(spark, sf_dir, edges=None):
    edges = stored_edges(spark, sf_dir) if edges is None else edges
    states = stored(state_table(spark, sf_dir, edges), "states")
    return D.probabilities(states, D.seen_edges(edges, states), hits_table(spark, sf_dir, edges), SECONDS)


def found(spark, sf_dir, edges=None):
    return D.findings(scored(spark, sf_dir, edges))


@query("flagship_window_states", f"WITH {SCORED} SELECT scenario, k, idx, event_count, round(bytes, 6) AS bytes, edge_count, max_fanout, round(z_total, 6) AS z_total, round(p_ddos, 6) AS p_ddos, round(p_exfiltration, 6) AS p_exfiltration FROM p")
def flagship(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("scenario", "k", "idx", "event_count", "bytes", "edge_count", "max_fanout", "z_total", "p_ddos", "p_exfiltration"))


NAMED = ["bytes", "domain_length", "tunnel", "beacon", "execs", "edge_entropy"]
NAMES = "nm AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS windows FROM st WHERE {f} IS NOT NULL HAVING count(*) > 0" for f in NAMED) + ")"


def names(spark, sf_dir):
    return W.feature_names(state_table(spark, sf_dir), NAMED)


@query("g2_feature_names", f"WITH {STATES}, {NAMES} SELECT * FROM nm")
def g2(spark, sf_dir):
    return names(spark, sf_dir)


@query("g5_feature_mismatch", f"WITH {STATES}, {NAMES}, x AS (SELECT unnest(['bytes', 'tunnel', 'beacon', 'edge_entropy', 'payload']) AS feature) SELECT feature, 'missing' AS status FROM x WHERE feature NOT IN (SELECT feature FROM nm) UNION ALL SELECT feature, 'unexpected' FROM nm WHERE feature NOT IN (SELECT feature FROM x)")
def g5(spark, sf_dir):
    expected = spark.createDataFrame([(f,) for f in ("bytes", "tunnel", "beacon", "edge_entropy", "payload")], "feature string")
    return W.schema_mismatch(names(spark, sf_dir), expected)


@query("d1_state_table", f"WITH {STATES} SELECT scenario, k, idx, event_count, round(bytes, 6) AS bytes, round(failed_auth, 6) AS failed_auth, round(rst_count, 6) AS rst_count, round(retransmission, 6) AS retransmission, round(probe_share, 6) AS probe_share, max_fanout, round(edge_entropy, 6) AS edge_entropy FROM st")
def state_query(spark, sf_dir):
    return rounded(state_table(spark, sf_dir).select("scenario", "k", "idx", "event_count", "bytes", "failed_auth", "rst_count", "retransmission", "probe_share", "max_fanout", "edge_entropy"))


@query("e2_history_z_scores", f"WITH {exact(SCORED)} SELECT scenario, k, idx, round(z_flow, 6) AS z_flow, round(z_total, 6) AS z_total, round(z_bits, 6) AS z_bits FROM z")
def e2(spark, sf_dir):
    over = D.prior()
    return rounded(state_table(spark, sf_dir).select("scenario", "k", "idx", D.z_score(F.col("flow_count") / SECONDS, over).alias("z_flow"), D.z_score(F.col("bytes"), over).alias("z_total"), D.z_score(F.col("edge_entropy"), over).alias("z_bits")))


@query("e3_bounded_history", f"WITH {STATES} SELECT scenario, k, idx, count(*) OVER w AS held, round(avg(bytes) OVER w, 6) AS mean_bytes FROM st WINDOW w AS (PARTITION BY scenario ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def e3(spark, sf_dir):
    from pyspark.sql import Window

    last = Window.partitionBy("scenario").orderBy("idx").rowsBetween(-3, -1)
    return rounded(state_table(spark, sf_dir).select("scenario", "k", "idx", F.count("*").over(last).alias("held"), F.avg("bytes").over(last).alias("mean_bytes")))


@query("c5_known_edges", f"WITH {STATES} SELECT scenario, k, idx, src, dst, known FROM ek")
def c5(spark, sf_dir):
    return known_edges(spark, sf_dir).select("scenario", "k", "idx", "src", "dst", "known")


@query("c6_fresh_entities", f"WITH {STATES} SELECT scenario, k, entity, lag(idx) OVER (PARTITION BY scenario, entity ORDER BY idx) IS NULL AS fresh FROM (SELECT en.*, idx FROM en JOIN st USING (scenario, k))")
def c6(spark, sf_dir):
    return D.fresh_entities(W.entities(edge_table(spark, sf_dir)), state_table(spark, sf_dir)).select("scenario", "k", "entity", "fresh")


SEGMENT = {"AUTOMOBILE": "critical", "BUILDING": "high", "FURNITURE": "medium"}


def assets(spark, sf_dir):
    level = F.lit("low")
    for s, c in SEGMENT.items():
        level = F.when(F.col("c_mktsegment") == s, c).otherwise(level)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 = 0").select(F.concat(F.lit("user-"), F.col("c_custkey")).alias("asset_id"), level.alias("criticality"))


ASSETS = "asset AS (SELECT 'user-' || c_custkey AS asset_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1.0E0 WHEN 'BUILDING' THEN 0.75E0 WHEN 'FURNITURE' THEN 0.5E0 ELSE 0.25E0 END AS weight FROM customer WHERE c_custkey % 3 = 0)"
WORST = f"{ASSETS}, wa AS (SELECT scenario, k, max(weight) AS criticality, count(asset_id) AS registered FROM en LEFT JOIN asset ON entity = asset_id GROUP BY scenario, k)"


def worst_assets(spark, sf_dir, edges=None):
    rows = W.entities(edge_table(spark, sf_dir) if edges is None else edges).join(assets(spark, sf_dir), F.col("entity") == F.col("asset_id"), "left")
    return rows.groupBy("scenario", "k").agg(F.max(C.weight(F.col("criticality"), C.CRITICALITY)).alias("criticality"), F.count("asset_id").alias("registered"))


@query("c7_asset_enrichment", f"WITH {STATES}, {WORST} SELECT * FROM wa")
def c7(spark, sf_dir):
    return worst_assets(spark, sf_dir)


@query("c8_ioc_matches", f"WITH {STATES} SELECT * FROM hit")
def c8(spark, sf_dir):
    return hits_table(spark, sf_dir)


@query("e14_known_edge_rates", f"WITH {STATES} SELECT scenario, k, idx, round(known_bytes, 6) AS known_bytes, known_edges, new_edges, round(rate, 12) AS rate FROM kr")
def e14(spark, sf_dir):
    return rounded(D.known_edge_rates(known_edges(spark, sf_dir), SECONDS), ("rate",)).withColumn("rate", F.round("rate", 12))


BASELINE = "ref AS (SELECT rate FROM kr WHERE rate IS NOT NULL AND idx < 72), md AS (SELECT median(rate) AS median, count(rate) AS samples FROM ref), bl AS (SELECT any_value(median) AS median, any_value(samples) AS samples, median(abs(rate - median)) AS mad FROM ref, md)"


@query("d32_deployment_baseline", f"WITH {STATES}, {BASELINE} SELECT round(median, 6) AS median, samples, round(mad, 6) AS mad FROM bl")
def d32(spark, sf_dir):
    return rounded(D.fit_baseline(D.known_edge_rates(known_edges(spark, sf_dir), SECONDS).where("idx < 72")))


SIGMA = "CASE WHEN mad <= 0 THEN CASE WHEN rate <= median THEN 0 ELSE 6 END ELSE 0.6745E0 * (rate - median) / mad END"


@query("i12_baseline_scores", f"WITH {STATES}, {BASELINE}, sg AS (SELECT scenario, k, idx, {SIGMA} AS sigma FROM kr, bl) SELECT scenario, k, idx, round({band_sql('sigma', 3.0, 6.0)}, 6) AS score FROM sg")
def i12(spark, sf_dir):
    rates = D.known_edge_rates(known_edges(spark, sf_dir), SECONDS)
    fitted = D.fit_baseline(rates.where("idx < 72"))
    return rounded(rates.join(F.broadcast(fitted)).select("scenario", "k", "idx", D.baseline_score(F.col("rate"), F.col("median"), F.col("mad")).alias("score")))


@query("i17_reference_measurement", f"""WITH {STATES}, lab AS (SELECT scenario, k, max(CASE WHEN stage <> 'Benign' THEN 1 ELSE 0 END) AS attack FROM mem GROUP BY scenario, k),
rr AS (SELECT kr.*, attack, percent_rank() OVER (PARTITION BY attack ORDER BY k, scenario) AS pr FROM kr JOIN lab USING (scenario, k) WHERE rate IS NOT NULL),
rf AS (SELECT * FROM rr WHERE attack = 0 AND pr < 0.3), m1 AS (SELECT median(rate) AS median FROM rf), m2 AS (SELECT any_value(median) AS median, median(abs(rate - median)) AS mad FROM rf, m1),
sg AS (SELECT attack, {SIGMA} AS sigma FROM rr, m2 WHERE NOT (attack = 0 AND pr < 0.3))
SELECT CAST(attack AS INT) AS attack, count(*) AS windows, count(*) FILTER (sigma >= 5.1) AS alerts FROM sg GROUP BY attack""")
def i17(spark, sf_dir):
    from pyspark.sql import Window

    labels = members(spark, sf_dir).groupBy("scenario", "k").agg(F.max((F.col("stage") != "Benign").cast("int")).alias("attack"))
    rates = D.known_edge_rates(known_edges(spark, sf_dir), SECONDS).where("rate is not null").join(labels, ["scenario", "k"])
    ranked = rates.withColumn("reference", (F.percent_rank().over(Window.partitionBy("attack").orderBy("k", "scenario")) < 0.3) & (F.col("attack") == 0))
    fitted = D.fit_baseline(ranked.where("reference"))
    score = D.baseline_score(F.col("rate"), F.col("median"), F.col("mad"))
    return ranked.where("not reference").join(F.broadcast(fitted)).groupBy("attack").agg(F.count("*").alias("windows"), F.count_if(score >= 0.7 - 1e-9).alias("alerts"))


def detector_query(number: int, name: str):
    @query(f"i{number}_{name}", f"WITH {exact(FOUND) if name == 'entropy_anomaly' else FOUND} SELECT scenario, k, idx, probability, severity, confidence, is_alert FROM fd WHERE detector = '{name}'")
    def run(spark, sf_dir):
        return found(spark, sf_dir).where(F.col("detector") == name).select("scenario", "k", "idx", "probability", "severity", "confidence", "is_alert")


for _i, _n in enumerate(D.ALERT_AT, 1):
    detector_query(_i, _n)


@query("i13_all_findings", f"WITH {exact(FOUND)} SELECT scenario, k, idx, detector, attack_type, technique, probability, severity, confidence, is_alert FROM fd")
def i13(spark, sf_dir):
    return found(spark, sf_dir)


STARTED = f"ts AS (SELECT p.*, kr.known_edges, kr.known_bytes, kr.new_edges, greatest(z_flow, z_byte) AS z_rate, p.origin + p.k * {STRIDE} AS start_us, domain_length IS NOT NULL OR tunnel IS NOT NULL AS dns FROM p JOIN kr USING (scenario, k))"


def started(spark, sf_dir, edges=None):
    """Scored windows with their starts in micros."""
    origin = events(spark, sf_dir).groupBy("scenario").agg(F.min("us").alias("origin"))
    return scored(spark, sf_dir, edges).join(origin, "scenario").withColumn("start", F.col("origin") + F.col("k") * STRIDE)


def near_sql(value: str, digits: int) -> str:
    return f"round_even(round(CAST({value} AS DOUBLE), 6), {digits})"


SHOWN = [
    ("ddos", "flows_per_second", near_sql("flow_count / 21600.0E0", 2), "true"), ("ddos", "bytes_per_second", near_sql("bytes / 21600.0E0", 0), "z_rate >= 3"),
    ("reconnaissance", "rst_probe_ratio", near_sql("least(1, coalesce(rst_count, 0) / greatest(1, flow_count))", 3), "true"), ("reconnaissance", "low_byte_probes", near_sql("probe_share", 3), "true"),
    ("reconnaissance", "max_source_fanout", "max_fanout", "true"), ("credential_abuse", "failed_auth_per_min", near_sql("coalesce(failed_auth, 0) * flow_count * 60 / 21600.0E0", 2), "true"),
    ("lateral_movement", "known_internal_edges", "known_edges", "true"), ("lateral_movement", "known_edge_bytes", near_sql("known_bytes", 0), "true"),
    ("lateral_movement", "known_edge_bytes_per_sec", near_sql("known_bytes / 21600.0E0", 1), "true"), ("lateral_movement", "new_internal_edges", "new_edges", "true"),
    ("command_and_control", "intel_matches", "matches", "matches IS NOT NULL"), ("command_and_control", "c2_beacon_score", near_sql("beacon", 3), "matches IS NULL AND beacon IS NOT NULL"),
    ("exfiltration", "window_bytes", near_sql("bytes", 0), "true"), ("exfiltration", "bytes_zscore", near_sql("z_total", 2), "abs(z_total) > 1e-9"), ("exfiltration", "intel_matches", "matches", "matches IS NOT NULL"),
    ("insider_threat", "bytes_zscore", near_sql("z_total", 2), "true"), ("insider_threat", "window_hour_utc", "(start_us // 3600000000) % 24", "true"),
    ("phishing", "mean_domain_length", near_sql("coalesce(domain_length, 0)", 1), "dns"), ("phishing", "tunnel_marker_share", near_sql("coalesce(tunnel, 0)", 3), "dns"),
    ("malware_activity", "process_executions", near_sql("execs * event_count", 0), "execs IS NOT NULL"), ("entropy_anomaly", "byte_entropy", near_sql("coalesce(edge_entropy, 0)", 3), "true"),
    ("entropy_anomaly", "entropy_deviation", near_sql("z_bits", 2), "abs(z_bits) > 1.5"),
]


@query("i13_finding_evidence", f"WITH {exact(SCORED)}, {STARTED} " + " UNION ALL ".join(f"SELECT scenario, k, idx, '{d}' AS detector, '{n}' AS name, CAST({v} AS DOUBLE) AS observed FROM ts WHERE {w}" for d, n, v, w in SHOWN))
def i13_evidence(spark, sf_dir):
    return D.evidence(started(spark, sf_dir), SECONDS)


WARNED = [
    ("ddos", "flood_kind_unknown", "p_ddos > 1e-9"), ("ddos", "flood_unvalidated", "p_ddos >= 0.8"), ("ddos", "window_too_long", "true"), ("credential_abuse", "failures_not_by_edge", "failed_auth * flow_count > 0"),
    ("lateral_movement", "no_known_edges", "idx < 3"), ("lateral_movement", "no_deployment_baseline", "idx >= 3"), ("command_and_control", "list_only", "matches IS NOT NULL"),
    ("command_and_control", "no_beacon_data", "matches IS NULL AND beacon IS NULL"), ("command_and_control", "sensor_score", "matches IS NULL AND beacon IS NOT NULL"),
    ("exfiltration", "volume_floor", "idx < 3"), ("exfiltration", "listed_host", "matches IS NOT NULL"), ("insider_threat", "needs_identity_data", "true"), ("phishing", "no_dns_data", "NOT dns"), ("phishing", "dns_only", "dns"),
    ("malware_activity", "no_process_data", "execs IS NULL"), ("malware_activity", "burst_only", "execs IS NOT NULL"), *((d, "short_history", "idx < 3") for d in D.ALERT_AT),
]


@query("i13_finding_warnings", f"WITH {SCORED}, {STARTED} " + " UNION ALL ".join(f"SELECT scenario, k, idx, '{d}' AS detector, '{n}' AS warning FROM ts WHERE {w}" for d, n, w in WARNED))
def i13_warnings(spark, sf_dir):
    return D.warnings(scored(spark, sf_dir), SECONDS)


AFFECTED = """fe AS (SELECT scenario, k, entity, lag(idx) OVER (PARTITION BY scenario, entity ORDER BY idx) IS NULL AS fresh FROM (SELECT en.*, idx FROM en JOIN st USING (scenario, k))),
aa AS (SELECT scenario, k, entity AS asset, fresh, weight IS NOT NULL AS critical FROM fe LEFT JOIN (SELECT asset_id, weight FROM asset WHERE weight = 1) ON entity = asset_id WHERE fresh OR weight IS NOT NULL)"""


def affected(spark, sf_dir, edges=None):
    edges = stored_edges(spark, sf_dir) if edges is None else edges
    return D.affected_assets(D.fresh_entities(W.entities(edges), state_table(spark, sf_dir, edges)), assets(spark, sf_dir))


@query("i13_affected_assets", f"WITH {STATES}, {ASSETS}, {AFFECTED} SELECT * FROM aa")
def i13_assets(spark, sf_dir):
    return affected(spark, sf_dir)


@query("i4_lateral_baseline", f"""WITH {STATES}, {BASELINE}, sg AS (SELECT scenario, k, idx, {SIGMA} AS sigma FROM kr, bl), lp AS (SELECT *, coalesce({band_sql('sigma', 3.0, 6.0)}, 0) AS p FROM sg)
SELECT scenario, k, idx, round_even(p, 3) AS probability, CASE WHEN p >= 0.85 THEN 'critical' WHEN p >= 0.65 THEN 'high' WHEN p >= 0.40 THEN 'medium' ELSE 'low' END AS severity,
 CASE WHEN p >= 0.85 THEN 'high' WHEN p >= 0.5 THEN 'medium' ELSE 'low' END AS confidence, p >= 0.7 AS is_alert, CASE WHEN idx >= 3 THEN {near_sql('sigma', 2)} END AS sigma FROM lp""")
def i4_baseline(spark, sf_dir):
    rates = stored(D.known_edge_rates(known_edges(spark, sf_dir), SECONDS), "rates")
    return D.lateral_by_baseline(rates, D.fit_baseline(rates.where("idx < 72")))


EXTERNAL = "xt AS (SELECT scenario, k, count(*) FILTER (entity LIKE 'user-1%') AS external_count FROM en GROUP BY scenario, k)"


@query("i14_stage_mapping", f"""WITH {SCORED}, {EXTERNAL}, ru AS (
 SELECT scenario, k, idx, p_ddos, 'Reconnaissance' AS stage, 0 AS i, least(0.95E0, 0.6E0 + 0.1E0 * failed_auth) AS c FROM p WHERE failed_auth > 0
 UNION ALL SELECT scenario, k, idx, p_ddos, 'Initial Access', 1, least(0.9E0, 0.5E0 + event_count / 100.0E0) FROM p WHERE event_count > 20
 UNION ALL SELECT scenario, k, idx, p_ddos, 'Lateral Movement', 2, least(0.95E0, 0.65E0 + bytes / 200000.0E0) FROM p WHERE bytes > 10000
 UNION ALL SELECT scenario, k, idx, p_ddos, 'Command and Control', 3, least(0.95E0, 0.6E0 + 0.05E0 * retransmission) FROM p WHERE retransmission > 2
 UNION ALL SELECT p.scenario, p.k, idx, p_ddos, 'Exfiltration', 4, least(0.95E0, 0.7E0 + bytes / 400000.0E0) FROM p JOIN xt USING (scenario, k) WHERE bytes > 100000 AND external_count > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY scenario, k ORDER BY c DESC, i DESC) AS rn, count(*) OVER (PARTITION BY scenario, k) AS rules FROM ru)
SELECT p.scenario, p.k, p.idx, coalesce(b.stage, 'Unknown') AS stage, round(coalesce(greatest(0, least(1, 0.5E0 * p.p_ddos + 0.5E0 * c)), 0), 6) AS probability, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.6 THEN 'medium' WHEN c IS NOT NULL THEN 'low' ELSE 'unknown' END AS confidence, coalesce(CAST(rules AS INT), 0) AS rules
FROM p LEFT JOIN b ON p.scenario = b.scenario AND p.k = b.k AND rn = 1""")
def i14(spark, sf_dir):
    rows = W.entities(edge_table(spark, sf_dir)).groupBy("scenario", "k").agg(F.count_if(W.external(F.col("entity"), ("user-1",))).alias("external_count"))
    return rounded(D.map_stage(scored(spark, sf_dir).join(rows, ["scenario", "k"]), F.col("p_ddos")))


@query("i15_adaptive_entropy", f"WITH {STATES}, a AS (SELECT scenario, k, idx, edge_entropy, avg(edge_entropy) OVER (PARTITION BY scenario ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM st) SELECT scenario, k, idx, round(greatest(0, least(1, CASE WHEN m IS NULL THEN (edge_entropy - 3.8) / 2 ELSE abs(edge_entropy - m) / 3 END)), 6) AS score FROM a")
def i15(spark, sf_dir):
    return rounded(D.adaptive_entropy(state_table(spark, sf_dir)))


STAGE_OF = {"reconnaissance": "Reconnaissance", "lateral_movement": "Lateral Movement", "exfiltration": "Exfiltration", "command_and_control": "Command and Control"}
LABEL = """rk AS (SELECT *, CASE stage WHEN 'Reconnaissance' THEN 1 WHEN 'Exfiltration' THEN 5 WHEN 'Lateral Movement' THEN 6 ELSE 0 END AS rank FROM mem),
wl AS (SELECT scenario, k, stage FROM (SELECT *, row_number() OVER (PARTITION BY scenario, k ORDER BY rank DESC, event_id DESC) AS rn FROM rk) WHERE rn = 1)"""


@query("i16_detector_scorecard", f"""WITH {FOUND}, {LABEL}, mp AS (SELECT unnest({list(STAGE_OF)}) AS detector, unnest({list(STAGE_OF.values())}) AS m),
c AS (SELECT detector, count(*) FILTER (is_alert AND stage = m) AS tp, count(*) FILTER (is_alert AND stage <> m) AS fp, count(*) FILTER (NOT is_alert AND stage = m) AS fn, count(*) FILTER (NOT is_alert AND stage <> m) AS tn FROM fd JOIN mp USING (detector) JOIN wl USING (scenario, k) GROUP BY detector)
SELECT detector, tp, fp, fn, tn, round(CASE WHEN tp + fn > 0 AND tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c""")
def i16(spark, sf_dir):
    return rounded(D.scorecard(found(spark, sf_dir), W.window_label(members(spark, sf_dir)), STAGE_OF))


def alerts(spark, sf_dir, edges=None):
    """Alerts with the bounds of their windows in micros, and the window's worst asset."""
    edges = stored_edges(spark, sf_dir) if edges is None else edges
    origin = events(spark, sf_dir).groupBy("scenario").agg(F.min("us").alias("origin"))
    rows = found(spark, sf_dir, edges).where("is_alert").join(origin, "scenario").join(worst_assets(spark, sf_dir, edges).select("scenario", "k", "criticality"), ["scenario", "k"])
    return rows.withColumn("start", F.col("origin") + F.col("k") * STRIDE).withColumn("end", F.col("start") + WIDTH)


CHAINS = f"""{FOUND}, {WORST}, al AS (SELECT fd.*, criticality, origin + k * {STRIDE} AS "start", origin + k * {STRIDE} + {WIDTH} AS "end" FROM fd JOIN wa USING (scenario, k) WHERE is_alert),
nw AS (SELECT *, CASE WHEN "start" - lag("end") OVER o > {GAP} THEN 1 ELSE 0 END AS isnew FROM al WINDOW o AS (PARTITION BY scenario ORDER BY "start", probability DESC, attack_type)),
ch AS (SELECT *, CAST(sum(isnew) OVER (PARTITION BY scenario ORDER BY "start", probability DESC, attack_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS chain FROM nw)"""


def chained(spark, sf_dir):
    """All alerts with their chains."""
    return C.chains(alerts(spark, sf_dir), GAP)


@query("e11_alert_chains", f"WITH {CHAINS} SELECT scenario, k, attack_type, probability, chain FROM ch")
def e11(spark, sf_dir):
    return chained(spark, sf_dir).select("scenario", "k", "attack_type", "probability", "chain")


PROGRESS = "fs AS (SELECT scenario, chain, attack_type, min(\"start\") AS s FROM ch GROUP BY ALL), pg AS (SELECT scenario, chain, list(attack_type ORDER BY s, attack_type) AS progression FROM fs GROUP BY ALL)"


@query("e12_progressions", f"WITH {CHAINS}, {PROGRESS} SELECT scenario, chain, array_to_string(progression, '>') AS progression FROM pg")
def e12(spark, sf_dir):
    return C.progression(chained(spark, sf_dir), ["scenario", "chain"]).withColumn("progression", F.array_join("progression", ">"))


SEV = "CASE severity WHEN 'critical' THEN 1.0E0 WHEN 'high' THEN 0.75E0 WHEN 'medium' THEN 0.5E0 WHEN 'low' THEN 0.25E0 ELSE 0 END"
LEVEL = "CASE WHEN {0} >= 0.8 THEN 'critical' WHEN {0} >= 0.6 THEN 'high' WHEN {0} >= 0.35 THEN 'medium' WHEN {0} > 0 THEN 'low' ELSE 'info' END"


@query("j1_incidents", f"""WITH {CHAINS}, {PROGRESS}, g AS (SELECT scenario, chain, min("start") AS first_seen, max("end") AS last_seen, count(*) AS findings, count(DISTINCT attack_type) AS types, max(criticality) AS worst FROM ch GROUP BY scenario, chain),
pk AS (SELECT scenario, chain, probability, severity FROM (SELECT *, row_number() OVER (PARTITION BY scenario, chain ORDER BY probability DESC, attack_type DESC) AS rn FROM ch) WHERE rn = 1),
sc AS (SELECT g.*, least(1, round_even(least(1, 0.5E0 * probability + 0.3E0 * coalesce(worst, 0.5E0) + 0.2E0 * {SEV}), 3) + CASE WHEN findings > 1 THEN least(0.15E0, 0.03E0 * (types - 1)) ELSE 0 END) AS score FROM g JOIN pk USING (scenario, chain))
SELECT scenario, chain, first_seen, last_seen, findings, types, round_even(score, 3) AS risk, {LEVEL.format('score')} AS level, array_to_string(progression, '>') AS progression, 'INC-' || printf('%03d', row_number() OVER (PARTITION BY scenario ORDER BY first_seen, chain)) AS incident_id FROM sc JOIN pg USING (scenario, chain)""")
def j1(spark, sf_dir):
    return C.incidents(chained(spark, sf_dir)).withColumn("progression", F.array_join("progression", ">"))


@query("j1_incident_assets", f"WITH {CHAINS}, {AFFECTED} SELECT scenario, chain, asset, max(critical) AS critical FROM (SELECT DISTINCT scenario, chain, k FROM ch) JOIN aa USING (scenario, k) GROUP BY ALL")
def j1_assets(spark, sf_dir):
    edges = stored_edges(spark, sf_dir)
    return C.incident_assets(C.chains(alerts(spark, sf_dir, edges), GAP), affected(spark, sf_dir, edges))


@query("j3_incident_risk", f"SELECT scenario, chain, types, risk, level FROM ({ORACLE_SQL['j1_incidents']})")
def j3(spark, sf_dir):
    return C.incidents(chained(spark, sf_dir)).select("scenario", "chain", "types", "risk", "level")


@query("j2_finding_risk", f"""WITH {exact(FOUND)}, {WORST}, s AS (SELECT scenario, k, detector, least(1, 0.5E0 * probability + 0.3E0 * coalesce(criticality, 0.5E0) + 0.2E0 * {SEV}) AS score FROM fd JOIN wa USING (scenario, k))
SELECT scenario, k, detector, round(score, 6) AS score, {LEVEL.format('score')} AS level FROM s""")
def j2(spark, sf_dir):
    edges = stored_edges(spark, sf_dir)
    rows = found(spark, sf_dir, edges).join(worst_assets(spark, sf_dir, edges), ["scenario", "k"])
    score = C.fused_risk(F.col("probability"), F.col("severity"), F.col("criticality"))
    return rounded(rows.select("scenario", "k", "detector", score.alias("score"), S.risk_level(score).alias("level")))


@query("j4_recommendations", f"WITH {CHAINS}, ty AS (SELECT DISTINCT scenario, chain, attack_type FROM ch) SELECT scenario, chain, CASE attack_type " + " ".join(f"WHEN '{t}' THEN {i}" for t, i in C.STEPS.items()) + " END AS step, CASE attack_type " + " ".join("WHEN '{}' THEN '{}'".format(t, a.replace("'", "''")) for t, a in C.ADVICE.items()) + f" END AS action FROM ty UNION ALL SELECT scenario, chain, 99, '{C.LAST_ADVICE}' FROM ty GROUP BY scenario, chain HAVING count(*) FILTER (attack_type = 'exfiltration') = 0")
def j4(spark, sf_dir):
    return C.recommendations(chained(spark, sf_dir))


def values_sql(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}E0" for v in r) + ")" for r in rows) + ")"


@query("j5_chain_likelihood", f"""WITH {CHAINS}, {PROGRESS}, mv AS (SELECT * FROM {values_sql(C.PRIOR_TRANSITIONS)} AS t(cur, nxt, p1)), sp AS (SELECT * FROM {values_sql(C.STARTS)} AS t(t0, p0)),
u AS (SELECT scenario, chain, progression, unnest(range(1, len(progression) + 1)) AS i FROM pg), v AS (SELECT scenario, chain, i, progression[i] AS b, CASE WHEN i > 1 THEN progression[i - 1] END AS a FROM u)
SELECT scenario, chain, round(exp(sum(ln(CASE WHEN i = 1 THEN coalesce(p0, 0.05E0) ELSE coalesce(p1, 0.05E0) END))), 9) AS likelihood FROM v LEFT JOIN mv ON a = cur AND b = nxt LEFT JOIN sp ON b = t0 GROUP BY scenario, chain""")
def j5(spark, sf_dir):
    return C.sequence_likelihood(spark, C.progression(chained(spark, sf_dir), ["scenario", "chain"]), ["scenario", "chain"]).withColumn("likelihood", F.round("likelihood", 9))


NEXT = f"pa AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS target FROM ev), pc AS (SELECT source, target, count(*) AS n FROM pa WHERE target IS NOT NULL GROUP BY ALL), tm AS (SELECT *, (n + 0.1E0) / (sum(n) OVER (PARTITION BY source) + 0.1E0 * count(*) OVER (PARTITION BY source)) AS probability FROM pc)"


def model(spark, sf_dir):
    from pyspark.sql import Window

    pairs = events(spark, sf_dir).select(F.col("event_type").alias("source"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("us", "event_id")).alias("target"))
    return C.transition_model(pairs.where("target is not null"))


@query("j7_transition_model", f"WITH {EDGES}, {NEXT} SELECT source, target, n, round(probability, 6) AS probability FROM tm")
def j7(spark, sf_dir):
    return rounded(model(spark, sf_dir))


@query("f3_top_next", f"WITH {EDGES}, {NEXT}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(probability, 9) DESC, target) AS rank FROM tm) SELECT source, target, n, round(probability, 6) AS probability, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def f3(spark, sf_dir):
    return rounded(C.top_next(model(spark, sf_dir).withColumn("probability", F.round("probability", 9))))


@query("j8_next_with_fallback", f"WITH {EDGES}, {NEXT}, m AS (SELECT source, target, probability FROM tm WHERE source < 'p'), pr AS (SELECT source, target, 0.5E0 AS probability FROM tm WHERE n > 50) SELECT source, target, round(probability, 6) AS probability, 'model' AS origin FROM m UNION ALL SELECT source, target, probability, 'prior' FROM pr WHERE source NOT IN (SELECT source FROM m)")
def j8(spark, sf_dir):
    rows = model(spark, sf_dir)
    return rounded(C.with_fallback(rows.where("source < 'p'"), rows.where("n > 50").withColumn("probability", F.lit(0.5)), rows))


@query("j8_next_techniques", f"""WITH {EDGES}, {NEXT}, ob AS (SELECT user_id, max(CASE WHEN user_id % 3 > 0 THEN event_type END) AS last FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS r FROM ev) WHERE r = 1 GROUP BY user_id),
fi AS (SELECT event_type FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS r FROM ev) WHERE r = 1), st AS (SELECT event_type AS target, count(*) * 1E0 / (SELECT count(*) FROM fi) AS probability FROM fi GROUP BY event_type),
mo AS (SELECT source, target, probability FROM tm WHERE source < 'p'), al AS (SELECT user_id, target, probability, 'start' AS origin FROM ob, st WHERE last IS NULL UNION ALL SELECT user_id, target, probability, 'model' FROM ob JOIN mo ON last = source
 UNION ALL SELECT user_id, target, 1E0 / n, 'prior' FROM ob JOIN tm ON last = source WHERE source >= 'p' AND source NOT IN (SELECT source FROM mo))
SELECT user_id, target, round(probability, 6) AS probability, origin, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY probability DESC, target) AS rank FROM al) WHERE rank <= 3""")
def j8_next(spark, sf_dir):
    """What follows each user's last event type: the model for some types, a prior for the others, the first types for users of whom nothing is known."""
    rows, known = events(spark, sf_dir), model(spark, sf_dir)
    last = rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("us", "event_id")).alias("t"))
    observed = last.select("user_id", F.when(F.col("user_id") % 3 > 0, F.col("t")).alias("last"))
    starts = C.start_model(rows.groupBy("user_id").agg(F.array(F.min_by("event_type", F.struct("us", "event_id"))).alias("techniques")))
    prior = known.where("source >= 'p'").withColumn("probability", 1 / F.col("n"))
    return rounded(C.next_techniques(known.where("source < 'p'"), starts, prior, observed, "user_id"))


@query("c13_transition_lookup", f"WITH {CHAINS}, mv AS (SELECT * FROM {values_sql(C.NEXT_TRANSITIONS)} AS t(cur, nxt, p1)) SELECT DISTINCT scenario, k, attack_type, nxt, p1 AS p FROM al JOIN mv ON attack_type = cur")
def c13(spark, sf_dir):
    moves = spark.createDataFrame(C.NEXT_TRANSITIONS, "cur string, nxt string, p double")
    return alerts(spark, sf_dir).join(F.broadcast(moves), F.col("attack_type") == F.col("cur")).select("scenario", "k", "attack_type", "nxt", "p").distinct()


ORDER = "CASE detector " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(D.ALERT_AT)) + " END"
PLACED = f"mv AS (SELECT * FROM {values_sql([(*t, i) for i, t in enumerate(C.NEXT_TRANSITIONS)])} AS t(cur, nxt, p1, place)), a AS (SELECT scenario, k, idx, attack_type, row_number() OVER (PARTITION BY scenario, k ORDER BY {ORDER} DESC) - 1 AS back FROM fd WHERE is_alert), s AS (SELECT scenario, k FROM a GROUP BY ALL HAVING count(*) >= 2)"
SEQUENCE = f"""{PLACED}, sv AS (SELECT scenario, k, idx, nxt, round(sum(p1 / (back + 1)), 9) AS votes, min(back * 1000 + place) AS first_named, max(CASE WHEN back = 0 THEN p1 END) AS last_p FROM a JOIN mv ON attack_type = cur GROUP BY ALL),
sq AS (SELECT scenario, k, idx, nxt AS attack_type, coalesce(last_p, 0) AS transition FROM sv JOIN s USING (scenario, k) QUALIFY row_number() OVER (PARTITION BY scenario, k ORDER BY votes DESC, first_named) = 1)"""


def moves_table(spark):
    return spark.createDataFrame([(*t, i) for i, t in enumerate(C.NEXT_TRANSITIONS)], "current string, next string, p double, place int")


@query("i11_sequence_findings", f"WITH {FOUND}, {SEQUENCE} SELECT scenario, k, idx, attack_type, round(transition, 6) AS transition FROM sq")
def i11_findings(spark, sf_dir):
    return D.sequence_findings(D.alert_places(found(spark, sf_dir)), moves_table(spark)).select("scenario", "k", "idx", "attack_type", "transition")


@query("i13_run_all", f"""WITH {exact(FOUND)}, {SEQUENCE} SELECT scenario, k, idx, detector, attack_type, technique, probability, severity, confidence, is_alert FROM fd
UNION ALL SELECT scenario, k, idx, 'sequence_prediction', attack_type, 'sequence-prediction', 1.0E0, 'critical', 'high', true FROM sq""")
def i13_run_all(spark, sf_dir):
    rows = stored(found(spark, sf_dir), "findings")
    return rows.unionByName(D.sequence_findings(D.alert_places(rows), moves_table(spark)).drop("transition"))


@query("i11_next_technique", f"""WITH {exact(FOUND)}, {PLACED}, v AS (SELECT a.scenario, a.k, nxt, sum(p1 / (back + 1)) AS votes FROM a JOIN s USING (scenario, k) JOIN mv ON attack_type = cur GROUP BY ALL)
SELECT scenario, k, nxt AS next, round(votes / max(votes) OVER (PARTITION BY scenario, k), 6) AS probability FROM v""")
def i11(spark, sf_dir):
    return rounded(D.next_techniques(D.alert_places(found(spark, sf_dir)), moves_table(spark)))
