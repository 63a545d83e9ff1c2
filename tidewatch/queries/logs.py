"""Append logs, sources over the driver tables, set operations and coverage: A7, A8, A16, A17, A22, B2, B11, B12, D27 to D31, E15, F2, F5, F7, G1, G5, G6, H2, H8, L1 to L6."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..events import EVENTS_SQL, events
from ..functions import scalars as S
from ..operators import replay as R2
from ..operators import windows as W
from ..operators.experiments import PACKET_PREFIXES, PER_FLOW_PREFIXES, tier
from ..operators import logs as L

from ..sources import readers as R
from ..sources.sinks import alert_payloads
from .detect import FOUND, exact, found, state_table
from .windows import EDGES, edge_table, members, rounded

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


EV = f"WITH {EVENTS_SQL}"


def conversations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


@query("f5_latest_record", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def f5(spark, sf_dir):
    return L.latest(conversations(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


ROLE_RULES = {"system": ["user"], "user": ["assistant"], "assistant": ["user"]}


@query("l2_status_transitions", "SELECT conv_id, turn, role, lag(role) OVER w AS before, lag(role) OVER w IS NULL OR coalesce((lag(role) OVER w = 'system' AND role = 'user') OR (lag(role) OVER w = 'user' AND role = 'assistant') OR (lag(role) OVER w = 'assistant' AND role = 'user'), false) AS allowed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def l2(spark, sf_dir):
    return L.transitions(conversations(spark, sf_dir), "conv_id", "turn", "role", ROLE_RULES).select("conv_id", "turn", "role", "before", "allowed")


@query("l4_registry_states", """WITH l AS (SELECT l_orderkey AS version, l_linenumber AS line, CASE WHEN l_linenumber = 1 THEN 'register' WHEN l_returnflag = 'R' THEN 'rollback' ELSE 'approve' END AS action FROM lineitem),
a AS (SELECT version, action, row_number() OVER (PARTITION BY version ORDER BY line, action) AS n FROM l),
f AS (SELECT version, min(CASE WHEN action = 'register' THEN n END) AS r, min(CASE WHEN action = 'approve' THEN n END) AS a, count(*) AS actions FROM a GROUP BY version), b AS (SELECT f.*, (SELECT min(n) FROM a WHERE a.version = f.version AND action = 'rollback' AND n > f.a) AS k FROM f)
SELECT version, CASE WHEN k IS NOT NULL THEN 'rolled_back' WHEN a IS NOT NULL THEN 'approved' ELSE 'registered' END AS status, CAST(actions - 1 - CAST(a IS NOT NULL AS INT) - CAST(k IS NOT NULL AS INT) AS INT) AS refused FROM b WHERE r IS NOT NULL""")
def l4(spark, sf_dir):
    """Lines of an order as the log of a version: the first registers it, the others ask for approval or rollback."""
    action = F.when(F.col("l_linenumber") == 1, "register").when(F.col("l_returnflag") == "R", "rollback").otherwise("approve")
    log = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("version"), "l_linenumber", action.alias("action"))
    return L.registry_state(log, "version", "l_linenumber").where("status is not null")


JSON_CHAR = "CASE c WHEN '\"' THEN '\\\\\"' WHEN '\\\\' THEN '\\\\\\\\' WHEN chr(10) THEN '\\\\n' WHEN chr(13) THEN '\\\\r' WHEN chr(9) THEN '\\\\t' ELSE CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c ELSE printf('\\\\u%04x', unicode(c)) END END".replace("\\\\", "\\")
JSON_TEXT = f"CASE WHEN {{0}} IS NULL THEN 'null' ELSE '\"' || coalesce(array_to_string(list_transform(string_split({{0}}, ''), lambda c: {JSON_CHAR}), ''), '') || '\"' END"
#: Conversations as logs: every fifth turn's record was altered behind its hash, every seventh has another link.
LEDGER = f"""WITH a AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, CASE WHEN turn % 7 = 6 THEN 'x' ELSE coalesce('h' || lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), repeat('0', 64)) END AS previous_hash, 'h' || turn AS own,
  CASE WHEN turn % 5 = 4 THEN NULL ELSE role END AS seen_role FROM conversations),
b AS (SELECT *, sha256('{{"previous_hash":"' || previous_hash || '","role":' || {JSON_TEXT.format('role')} || ',"text":' || {JSON_TEXT.format('text')} || ',"turn":' || turn || '}}') AS digest,
  sha256('{{"previous_hash":"' || previous_hash || '","role":' || {JSON_TEXT.format('seen_role')} || ',"text":' || {JSON_TEXT.format('text')} || ',"turn":' || turn || '}}') AS again FROM a)"""


def ledger(spark, sf_dir):
    """The logs with their faults; record_hash is the digest of the record before it was altered."""
    over = Window.partitionBy("conv_id").orderBy("turn")
    before = F.when(F.col("turn") % 7 == 6, F.lit("x")).otherwise(F.coalesce(F.concat(F.lit("h"), F.lag("turn").over(over).cast("string")), F.lit(L.GENESIS)))
    rows = conversations(spark, sf_dir).select("conv_id", "turn", "role", "text").withColumn("previous_hash", before)
    fields = lambda role: {"turn": (F.col("turn"), "number"), "role": (role, "string"), "text": (F.col("text"), "string"), "previous_hash": (F.col("previous_hash"), "string")}
    rows = rows.withColumn("record_hash", L.record_hash(fields(F.col("role"))))
    altered = rows.withColumn("role", F.when(F.col("turn") % 5 != 4, F.col("role")))
    return L.verify_chain(altered, "conv_id", "turn", fields(F.col("role")))


@query("l1_hash_chain", LEDGER + " SELECT conv_id, turn, place, digest AS record_hash, again <> digest AS bad_hash, previous_hash IS DISTINCT FROM coalesce(lag(digest) OVER (PARTITION BY conv_id ORDER BY turn), CASE WHEN place = 1 THEN repeat('0', 64) END) AS bad_link FROM b")
def l1(spark, sf_dir):
    return ledger(spark, sf_dir).select("conv_id", "turn", "place", "record_hash", "bad_hash", "bad_link")


@query("l1_ledger_errors", f"SELECT conv_id, place, 'record ' || place || ' (' || turn || '): ' || what AS error FROM ({ORACLE_SQL['l1_hash_chain']}), (SELECT unnest(['record hash mismatch', 'broken previous-hash link']) AS what) WHERE what LIKE 'record%' AND bad_hash OR what LIKE 'broken%' AND bad_link")
def l1_errors(spark, sf_dir):
    return L.ledger_errors(ledger(spark, sf_dir), "conv_id", "turn")


@query("l1_ledger_summary", f"SELECT conv_id, count(*) AS records_checked, sum(bad_hash::INT + bad_link::INT)::BIGINT AS errors, NOT bool_or(bad_hash OR bad_link) AS valid FROM ({ORACLE_SQL['l1_hash_chain']}) GROUP BY conv_id")
def l1_summary(spark, sf_dir):
    return L.ledger_summary(ledger(spark, sf_dir), "conv_id")


@query("e15_chain_links", "SELECT conv_id, turn, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_hash FROM conversations")
def e15(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", F.lag(F.sha2("text", 256)).over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous_hash"))


@query("h8_canonical_digest", f"WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus || CASE WHEN o_orderkey % 3 = 1 THEN ' é\"' ELSE '' END END AS s FROM orders) SELECT o_orderkey, sha256('{{\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":' || {JSON_TEXT.format('s')} || '}}') AS digest FROM o")
def h8(spark, sf_dir):
    """Digests of orders, with nulls and characters that JSON escapes."""
    status = F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 1, F.lit(' é"')).otherwise(F.lit(""))))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", S.canonical_digest({"o_orderstatus": (status, "string"), "o_custkey": (F.col("o_custkey"), "number")}).alias("digest"))


@query("l3_sla_report", EV + ", c AS (SELECT us AS opened, CASE level % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status FROM ev), n AS (SELECT max(opened) AS now FROM c), s AS (SELECT risk, CASE WHEN status = 'resolved' THEN 'resolved' WHEN opened + CASE risk WHEN 'critical' THEN 4 WHEN 'high' THEN 24 WHEN 'medium' THEN 72 ELSE 168 END * 3600000000 < now THEN 'breached' ELSE 'on_track' END AS state FROM c, n) SELECT risk, count(*) FILTER (state = 'on_track') AS on_track, count(*) FILTER (state = 'breached') AS breached, count(*) FILTER (state = 'resolved') AS resolved FROM s GROUP BY risk")
def l3(spark, sf_dir):
    rows = events(spark, sf_dir)
    risk = F.when(F.col("level") % 4 == 0, "critical").when(F.col("level") % 4 == 1, "high").when(F.col("level") % 4 == 2, "medium").otherwise("low")
    cases = rows.select(F.col("us").alias("opened"), risk.alias("risk"), F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("open").alias("status"))
    now = rows.agg(F.max("us").alias("now"))
    return L.sla_report(cases.join(F.broadcast(now)), F.col("now"))


@query("d30_verdicts", "WITH v AS (SELECT CASE WHEN quality = 1 THEN 'true_positive' WHEN toxic = 1 THEN 'needs_review' ELSE 'false_positive' END AS verdict FROM labels) SELECT verdict, count(*) AS n, (SELECT round(avg(CAST(verdict = 'false_positive' AS DOUBLE)), 6) FROM v) AS false_positive_rate FROM v GROUP BY verdict")
def d30(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.when(F.col("quality") == 1, "true_positive").when(F.col("toxic") == 1, "needs_review").otherwise("false_positive").alias("verdict"))
    return rounded(L.verdict_counts(rows))


@query("l5_feedback", "WITH v AS (SELECT coalesce(source, '') AS source, CASE WHEN quality = 1 THEN 'true_positive' WHEN toxic = 1 THEN 'needs_review' ELSE 'false_positive' END AS verdict FROM labels JOIN documents USING (doc_id)) SELECT source, count(*) AS n, count(*) FILTER (verdict = 'true_positive') AS true_positive, count(*) FILTER (verdict = 'false_positive') AS false_positive, count(*) FILTER (verdict = 'needs_review') AS needs_review, round(avg(CAST(verdict = 'false_positive' AS DOUBLE)), 6) AS false_positive_rate FROM v GROUP BY source")
def l5(spark, sf_dir):
    """Verdicts by what was judged: the source of each labelled document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.when(F.col("quality") == 1, "true_positive").when(F.col("toxic") == 1, "needs_review").otherwise("false_positive").alias("verdict"))
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return rounded(L.feedback_by(labels.join(sources, "doc_id"), "source"))


AUDIT = EV + ", au AS (SELECT event_id AS request_id, src AS key_id, CASE user_id % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'analyst' ELSE 'viewer' END AS role, CASE WHEN level >= 8 THEN 403 WHEN level >= 7 THEN 401 ELSE 200 END AS status, CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, '/v1/' || event_type || '/' || level AS path, us AS seen_us FROM ev)"
MATRIX = [("analyst", "GET", "/v1/"), ("analyst", "POST", "/v1/click"), ("viewer", "GET", "/v1/view")]


def audit(spark, sf_dir):
    role = F.when(F.col("user_id") % 3 == 0, "admin").when(F.col("user_id") % 3 == 1, "analyst").otherwise("viewer")
    status = F.when(F.col("level") >= 8, 403).when(F.col("level") >= 7, 401).otherwise(200)
    return events(spark, sf_dir).select(F.col("event_id").alias("request_id"), F.col("src").alias("key_id"), role.alias("role"), status.alias("status"), F.when(F.col("event_id") % 4 == 0, "POST").otherwise("GET").alias("method"), F.concat(F.lit("/v1/"), "event_type", F.lit("/"), "level").alias("path"), F.col("us").alias("at"))


@query("l6_access_audit", AUDIT + " SELECT key_id, role, status, count(*) AS requests, count(*) FILTER (status IN (401, 403)) AS denied, max(seen_us) AS last_at FROM au GROUP BY ALL")
def l6(spark, sf_dir):
    return L.access_summary(audit(spark, sf_dir))


@query("l6_active_keys", AUDIT + """, kl AS (SELECT key_id, request_id AS place, role, status = 403 AS revoked, CASE WHEN request_id % 5 <> 0 THEN seen_us + (request_id % 7) * 21600000000 END AS expires FROM au),
 la AS (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY place DESC) AS back FROM kl)
 SELECT key_id, role, expires FROM la WHERE back = 1 AND NOT revoked AND (expires IS NULL OR expires > (SELECT max(seen_us) FROM au))""")
def l6_keys(spark, sf_dir):
    """Keys in force at the last event, of a log in which each event writes its user's key anew."""
    rows = audit(spark, sf_dir)
    expires = F.when(F.col("request_id") % 5 != 0, F.col("at") + F.col("request_id") % 7 * 21_600_000_000)
    log = rows.select("key_id", F.col("request_id").alias("place"), "role", (F.col("status") == 403).alias("revoked"), expires.alias("expires"))
    return L.active_keys(log, F.lit(rows.agg(F.max("at")).first()[0]))


@query("d31_request_counters", AUDIT + " SELECT status, count(*) AS requests, count(DISTINCT key_id) AS keys FROM au GROUP BY status")
def d31(spark, sf_dir):
    return audit(spark, sf_dir).groupBy("status").agg(F.count("*").alias("requests"), F.count_distinct("key_id").alias("keys"))


@query("b12_permissions", AUDIT + " SELECT request_id, role = 'admin' OR (role = 'analyst' AND (method = 'GET' AND starts_with(path, '/v1/') OR method = 'POST' AND starts_with(path, '/v1/click'))) OR (role = 'viewer' AND method = 'GET' AND starts_with(path, '/v1/view')) AS permitted FROM au")
def b12(spark, sf_dir):
    return L.allowed(audit(spark, sf_dir), spark.createDataFrame(MATRIX, "m_role string, m_method string, prefix string")).select("request_id", "permitted")


LISTED = ["T1498", "T1046", "T1110", "T1021", "T1071", "T1048", "T1078", "T1566", "T1059", "T1190"]


COVERED = f"{FOUND}, t AS (SELECT unnest({LISTED}) AS technique), s AS (SELECT technique, count(*) AS n, max(probability) AS p FROM fd GROUP BY technique), cv AS (SELECT t.technique, coalesce(n, 0) AS n, coalesce(p, 0) AS max_probability FROM t LEFT JOIN s USING (technique))"


def covered(spark, sf_dir):
    return L.technique_coverage(found(spark, sf_dir), spark.createDataFrame([(t,) for t in LISTED], "technique string"))


@query("d27_technique_coverage", f"WITH {COVERED} SELECT technique, n, max_probability, max_probability > 0 AS observed FROM cv")
def d27(spark, sf_dir):
    return covered(spark, sf_dir)


@query("d28_coverage_layer", f"""WITH {COVERED} SELECT technique, '{{"techniqueID":"' || technique || '","score":' || least(10, n) || ',"color":"' || CASE WHEN max_probability >= 0.65 THEN '#67000d' WHEN max_probability >= 0.3 THEN '#fb6a4a' ELSE '#fff5f0' END || '","comment":"' || n || ' detection(s) | max_prob=' || format('{{:.3f}}', max_probability) || '","enabled":true}}' AS entry FROM cv WHERE max_probability > 0""")
def d28(spark, sf_dir):
    return L.coverage_layer(covered(spark, sf_dir))


@query("d29_phase_summary", EV + ", p AS (SELECT *, CASE WHEN day(ts) <= 10 THEN 'early' WHEN day(ts) <= 20 THEN 'middle' ELSE 'late' END AS phase FROM ev), t AS (SELECT phase, event_type, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT phase, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS types FROM t GROUP BY phase) SELECT phase, count(*) AS events, round(sum(bytes), 2) AS bytes, count(DISTINCT dst) AS endpoints, any_value(types) AS types FROM p JOIN s USING (phase) GROUP BY phase")
def d29(spark, sf_dir):
    phase = F.when(F.dayofmonth("ts") <= 10, "early").when(F.dayofmonth("ts") <= 20, "middle").otherwise("late")
    return L.phase_summary(events(spark, sf_dir).withColumn("phase", phase)).withColumn("bytes", F.round("bytes", 2))


@query("d29_phase_traffic", EV + """, p AS (SELECT CASE WHEN day(ts) <= 10 THEN 'early' WHEN day(ts) <= 20 THEN 'middle' ELSE 'late' END AS phase, CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 200 WHEN 'click' THEN 302 ELSE 0 END AS code, bytes, coalesce(payload_size, 0) AS received FROM ev),
c AS (SELECT phase, code, count(*) AS n, sum(bytes) AS sent, sum(received) AS received FROM p GROUP BY ALL)
SELECT phase, CAST(sum(n) AS BIGINT) AS events, round(sum(sent), 2) AS bytes_sent, round(sum(received), 2) AS bytes_received, string_agg(code || '=' || n, ',' ORDER BY code) AS statuses FROM c GROUP BY phase""")
def d29_traffic(spark, sf_dir):
    phase = F.when(F.dayofmonth("ts") <= 10, "early").when(F.dayofmonth("ts") <= 20, "middle").otherwise("late")
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 302)
    rows = events(spark, sf_dir).select(phase.alias("phase"), status.alias("http_status"), F.col("bytes").alias("bytes_sent"), F.col("payload_size").alias("bytes_received"))
    return L.phase_traffic(rows).withColumns({c: F.round(c, 2) for c in ("bytes_sent", "bytes_received")})


@query("d31_request_latency", AUDIT + ", la AS (SELECT status, CASE WHEN request_id % 9 <> 0 THEN (request_id * 37 % 4000) / 10.0E0 END AS ms FROM au) SELECT status, count(*) AS requests, round(sum(ms), 3) AS latency_ms_sum, count(ms) AS latency_ms_count FROM la GROUP BY status")
def d31_latency(spark, sf_dir):
    rows = audit(spark, sf_dir).withColumn("latency_ms", F.when(F.col("request_id") % 9 != 0, F.col("request_id") * 37 % 4000 / 10))
    return L.request_latency(rows).withColumn("latency_ms_sum", F.round("latency_ms_sum", 3))


@query("c14_phase_boundaries", EV + " SELECT event_id, CASE WHEN day(ts) > 20 THEN 'Lateral Movement' WHEN day(ts) > 10 THEN 'Reconnaissance' ELSE 'Benign' END AS stage FROM ev")
def c14(spark, sf_dir):
    bounds = spark.createDataFrame([("Benign", 0), ("Reconnaissance", 10), ("Lateral Movement", 20)], "stage string, after int")
    rows = events(spark, sf_dir).select("event_id", F.dayofmonth("ts").alias("day")).join(F.broadcast(bounds), F.col("day") > F.col("after"))
    return rows.groupBy("event_id").agg(F.max_by("stage", "after").alias("stage"))


HOST = "nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '')"


@query("h2_url_hosts", f"SELECT page_id, {HOST} AS host FROM pages")
def h2(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", S.url_host(F.col("url")).alias("host"))


@query("a17_feed_indicators", f"SELECT indicator, url, page_id FROM (SELECT {HOST} AS indicator, url, page_id, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id DESC) AS rn FROM pages) WHERE rn = 1 AND indicator IS NOT NULL")
def a17(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(S.url_host(F.col("url")).alias("indicator"), "url", "page_id").where("indicator is not null")
    return R.latest(rows, ["indicator"], "page_id")


@query("f7_most_recent", f"SELECT page_id, {HOST} AS host FROM pages ORDER BY page_id DESC LIMIT 100")
def f7(spark, sf_dir):
    return h2(spark, sf_dir).orderBy(F.col("page_id").desc()).limit(100)


@query("a8_label_map", "WITH m AS (SELECT * FROM (VALUES ('fr', 'Reconnaissance', true), ('de', 'Lateral Movement', true), ('en', 'Benign', false)) AS t(label, stage, infiltration)) SELECT doc_id, m.stage, m.infiltration FROM documents JOIN m ON lang = label")
def a8(spark, sf_dir):
    rules = spark.createDataFrame([("FR", "Reconnaissance", True), ("de", "Lateral Movement", True), ("en", "Benign", False)], "label string, stage string, infiltration boolean")
    return R.map_labels(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("label")), rules)[0].select("doc_id", "stage", "infiltration")


@query("g6_unmapped_labels", "SELECT DISTINCT lang AS label FROM documents WHERE lang NOT IN ('fr', 'de', 'en')")
def g6(spark, sf_dir):
    rules = spark.createDataFrame([("fr", "x", True), ("de", "x", True), ("en", "x", False)], "label string, stage string, infiltration boolean")
    return R.map_labels(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("label")), rules)[1]


@query("b2_contract_validation", EV + ", t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'auth' WHEN event_type = 'view' THEN 'dns' WHEN event_type = 'click' THEN 'flow' ELSE event_type END AS kind FROM ev) SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN kind NOT IN ('auth', 'dns', 'flow') THEN 'event_type' END AS reason FROM t")
def b2(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "auth").when(F.col("event_type") == "view", "dns").when(F.col("event_type") == "click", "flow").otherwise(F.col("event_type"))
    good, bad = R.validate(events(spark, sf_dir).select(F.col("event_id").cast("string"), "ts", "src", "dst", kind.alias("event_type")))
    return good.select("event_id", F.lit(None).cast("string").alias("reason")).union(bad.select("event_id", "reason"))


@query("g1_union_of_formats", EV + " SELECT event_id, 'a' AS part, bytes, NULL AS domain_length FROM ev WHERE event_type <> 'view' UNION ALL SELECT event_id, 'b', NULL, domain_length FROM ev WHERE event_type = 'view'")
def g1(spark, sf_dir):
    rows = events(spark, sf_dir)
    return R.union_events(rows.where("event_type <> 'view'").select("event_id", F.lit("a").alias("part"), "bytes"), rows.where("event_type = 'view'").select("event_id", F.lit("b").alias("part"), "domain_length"))


TIER_SQL = "CASE WHEN regexp_matches(lower(name), '^(" + "|".join(PACKET_PREFIXES) + ")') THEN 'packet' WHEN regexp_matches(lower(name), '^(" + "|".join(PER_FLOW_PREFIXES) + ")') THEN 'flow_per_flow' ELSE 'flow_window' END"


@query("b11_tier_audit", EV + f""", t AS (SELECT unnest(['bytes', 'duration', 'ttl', 'payload_size', 'retransmission', 'failed_auth', 'dport']) AS field, unnest(['bytes_mean', 'flow_duration_mean', 'ttl_mean', 'payload_size_mean', 'retransmission_rate', 'failed_auth_count', 'dst_port_count']) AS name),
v AS (SELECT scenario, unnest([bytes::DOUBLE, duration::DOUBLE, ttl::DOUBLE, payload_size::DOUBLE, retransmission::DOUBLE, failed_auth::DOUBLE, dport::DOUBLE]) AS value, unnest(['bytes', 'duration', 'ttl', 'payload_size', 'retransmission', 'failed_auth', 'dport']) AS field FROM ev),
c AS (SELECT scenario, {TIER_SQL} AS tier, count(DISTINCT name) AS features, count(*) AS "values" FROM v JOIN t USING (field) WHERE value IS NOT NULL GROUP BY ALL) SELECT * FROM c""")
def b11(spark, sf_dir):
    """Features and values of each collection tier that each scenario's events hold."""
    names = {"bytes": "bytes_mean", "duration": "flow_duration_mean", "ttl": "ttl_mean", "payload_size": "payload_size_mean", "retransmission": "retransmission_rate", "failed_auth": "failed_auth_count", "dport": "dst_port_count"}
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f).cast("double").alias("value")) for f, n in names.items()])
    long = events(spark, sf_dir).select("scenario", F.explode(each).alias("x")).where("x.value IS NOT NULL")
    return long.groupBy("scenario", tier(F.col("x.name")).alias("tier")).agg(F.count_distinct("x.name").alias("features"), F.count("*").alias("values"))


@query("a22_alert_payloads", f"""WITH {exact(FOUND)} SELECT scenario || ':' || k || ':' || detector AS key, '{{"scenario":' || scenario || ',"k":' || k || ',"detector":"' || detector || '","attack_type":"' || attack_type || '","probability":' || probability || ',"severity":"' || severity || '"}}' AS payload FROM fd WHERE is_alert AND severity IN ('high', 'critical')""")
def a22(spark, sf_dir):
    return alert_payloads(found(spark, sf_dir)).select("key", "payload")


@query("a15_retransmissions", EV + " SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY src, dst, dport, protocol ORDER BY event_id) > 1 THEN 1.0E0 ELSE 0.0E0 END AS retransmission FROM ev")
def a15(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.col("event_id").alias("packet_no"), "src", "dst", F.lit(0).alias("sport"), "dport", F.col("protocol").alias("seq"))
    return R.mark_retransmissions(rows).select("event_id", "retransmission")


@query("a16_assembled_flows", EV + """, k AS (SELECT *, least(src || ':0', dst || ':' || dport) AS lo, greatest(src || ':0', dst || ':' || dport) AS hi FROM ev),
n AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR ((tcp_flags & 2) <> 0 AND (tcp_flags & 16) = 0) OR (lag(tcp_flags) OVER w & 5) <> 0 OR us - lag(us) OVER w > 86400000000 THEN 1 ELSE 0 END AS isnew FROM k WINDOW w AS (PARTITION BY lo, hi, protocol ORDER BY us, event_id)),
f AS (SELECT *, sum(isnew) OVER (PARTITION BY lo, hi, protocol ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flow FROM n)
SELECT lo, hi, protocol, CAST(flow AS BIGINT) AS flow, min(us) AS "start", max(us) AS "end", count(*) AS packets, round(sum(bytes), 6) AS bytes, bit_or(tcp_flags) AS tcp_flags FROM f GROUP BY lo, hi, protocol, flow""")
def a16(spark, sf_dir):
    rows = events(spark, sf_dir).select("us", "src", "dst", F.lit(0).alias("sport"), "dport", "protocol", "bytes", "tcp_flags", F.col("event_id").alias("packet_no"))
    return rounded(R.assemble_flows(rows, 86_400_000_000, None).select("lo", "hi", "protocol", "flow", "start", "end", "packets", "bytes", "tcp_flags"))


@query("a16_age_limited_flows", "WITH RECURSIVE" + EV.removeprefix("WITH") + """, n AS (SELECT scenario, protocol, us, bytes, row_number() OVER w AS r, CASE WHEN lag(us) OVER w IS NULL OR ((tcp_flags & 2) <> 0 AND (tcp_flags & 16) = 0) OR (lag(tcp_flags) OVER w & 5) <> 0 OR us - lag(us) OVER w > 7200000000 THEN 1 ELSE 0 END AS isnew FROM ev WINDOW w AS (PARTITION BY scenario, protocol ORDER BY us, event_id)),
f AS (SELECT scenario, protocol, r, us, bytes, 1 AS flow, us AS began FROM n WHERE r = 1
 UNION ALL SELECT n.scenario, n.protocol, n.r, n.us, n.bytes, f.flow + CASE WHEN isnew = 1 OR n.us - began > 10800000000 THEN 1 ELSE 0 END, CASE WHEN isnew = 1 OR n.us - began > 10800000000 THEN n.us ELSE began END FROM f JOIN n ON n.scenario = f.scenario AND n.protocol = f.protocol AND n.r = f.r + 1)
SELECT 'd:0' AS lo, 's' || scenario || ':0' AS hi, protocol, CAST(flow AS BIGINT) AS flow, min(us) AS "start", max(us) AS "end", count(*) AS packets, round(sum(bytes), 6) AS bytes FROM f GROUP BY scenario, protocol, flow""")
def a16_age(spark, sf_dir):
    """All events of a scenario and protocol as one flow key: two silent hours end a flow, and three hours of age."""
    rows = events(spark, sf_dir).select("us", F.concat(F.lit("s"), "scenario").alias("src"), F.lit("d").alias("dst"), F.lit(0).alias("sport"), F.lit(0).alias("dport"), "protocol", "bytes", "tcp_flags", F.col("event_id").alias("packet_no"))
    return rounded(R.assemble_flows(rows, 7_200_000_000, 10_800_000_000).select("lo", "hi", "protocol", "flow", "start", "end", "packets", "bytes"))


@query("f2_supporting_entities", f"""WITH {EDGES}, en AS (SELECT DISTINCT scenario, k, unnest([src, dst]) AS entity FROM edge), ix AS (SELECT scenario, k, row_number() OVER (PARTITION BY scenario ORDER BY k) - 1 AS idx FROM (SELECT DISTINCT scenario, k FROM mem)),
e AS (SELECT scenario, idx, entity FROM en JOIN ix USING (scenario, k)), p AS (SELECT a.scenario, a.idx, e.entity, min(e.idx) AS seen FROM ix a JOIN e ON e.scenario = a.scenario AND e.idx BETWEEN a.idx - 2 AND a.idx GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY scenario, idx ORDER BY seen, entity) AS rn FROM p) SELECT scenario, idx, string_agg(entity, ',' ORDER BY seen, entity) AS entities FROM r WHERE rn <= 10 GROUP BY scenario, idx""")
def f2(spark, sf_dir):
    """The first ten entities of each state's last three states."""
    states = W.state_index(members(spark, sf_dir).select("scenario", "k").distinct())
    entities = W.entities(edge_table(spark, sf_dir)).join(states, ["scenario", "k"]).select("scenario", "idx", "entity")
    return R2.supporting(states.select("scenario", "idx"), entities).select("scenario", "idx", F.array_join("entities", ",").alias("entities"))


@query("k44_scaling_exponent", "WITH t AS (SELECT l_linenumber AS n, ln(l_linenumber) AS x, ln(sum(l_quantity)) AS y FROM lineitem GROUP BY l_linenumber) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_r2(y, x), 6) AS r2 FROM t")
def k44(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_linenumber").agg(F.sum("l_quantity").alias("s"))
    return rounded(rows.select(F.log("l_linenumber").alias("x"), F.log("s").alias("y")).agg(F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2")))
