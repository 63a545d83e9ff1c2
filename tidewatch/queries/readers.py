"""Readers over files that Spark writes from the tables: A1 to A7, A9 to A14, A17 to A21, A23, C8, H11, J6, M7, M8, M10."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..events import EVENTS_SQL, events
from ..functions.scalars import FLAG_BITS
from ..operators import correlate as C
from ..plans.tables import shared_folder
from ..sources import readers as R
from ..streaming import live
from .detect import FOUND, WORST, alerts, state_table
from .detect import STATES as STATES_SQL
from .windows import EDGES, edge_table, rounded

QUERIES, ORACLE_SQL = {}, {}
EV = f"WITH {EVENTS_SQL}"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def lines_of(rows, name: str, *cells):
    """The rows as text files of one line each, cells by blanks, and the lines read again."""
    path = shared_folder(rows.sparkSession, name)
    rows.select(F.concat_ws(" ", *cells).alias("value")).write.text(path)
    return R.text_lines(rows.sparkSession, path)


def clock(column: str = "ts"):
    return F.date_format(F.col(column), ISO)


def micros(rows):
    return rows.withColumn("us", F.unix_micros("ts")).drop("ts", "event_id")


def flow_files(spark, sf_dir):
    """Events as canonical flow files; every 97th has bytes that are no number."""
    flags = F.array_join(F.filter(F.array(*[F.when(F.col("tcp_flags").bitwiseAND(F.lit(b)) != 0, n) for n, b in FLAG_BITS.items()]), lambda x: x.isNotNull()), " ")
    name = F.when(F.col("protocol") == 6, "TCP").when(F.col("protocol") == 17, "udp").otherwise(F.col("protocol").cast("string"))
    size = F.when(F.col("event_id") % 97 == 0, "oops").otherwise(F.col("bytes").cast("string"))
    rows = events(spark, sf_dir).select(clock().alias("timestamp"), F.col("src").alias("source_entity"), F.col("dst").alias("destination_entity"), F.col("sport").alias("source_port"), F.col("dport").alias("destination_port"), name.alias("protocol"), size.alias("bytes"), "packets", "duration", flags.alias("tcp_flags"), "ttl")
    path = shared_folder(spark, "flow-csv")
    rows.write.csv(path, header=True)
    return path


FLOW_ROWS = "SELECT us, src, dst, CAST(sport AS DOUBLE) AS sport, CAST(dport AS DOUBLE) AS dport, protocol, tcp_flags, round(bytes, 6) AS bytes, round(duration, 6) AS duration FROM ev WHERE event_id % 97 <> 0"


@query("a1_flow_csv", f"{EV} {FLOW_ROWS}")
def a1(spark, sf_dir):
    rows, _ = R.read_flow_csv(spark, flow_files(spark, sf_dir))
    return rounded(micros(rows).select("us", "src", "dst", "sport", "dport", "protocol", "tcp_flags", "bytes", "duration"))


@query("a2_protocols_a3_flags", f"{EV}, f AS ({FLOW_ROWS}) SELECT protocol, tcp_flags, count(*) AS n FROM f GROUP BY ALL")
def a2(spark, sf_dir):
    """Protocol names and flag texts of the files, as numbers and masks."""
    return R.read_flow_csv(spark, flow_files(spark, sf_dir))[0].groupBy("protocol", "tcp_flags").agg(F.count("*").alias("n"))


@query("a4_coverage_report", f"{EV} SELECT count(*) FILTER (event_id % 97 <> 0) AS rows, count(*) FILTER (event_id % 97 = 0) AS rejected, 'tcp_flags,ttl' AS present FROM ev")
def a4(spark, sf_dir):
    path = flow_files(spark, sf_dir)
    rows, rejects = R.read_flow_csv(spark, path)
    report = R.coverage(spark.read.csv(path, header=True).columns, rows).select("rows", "present")
    return report.join(rejects.agg(F.count("*").alias("rejected")))


def labelled_files(spark, sf_dir):
    """Events as labelled flow exports: day-first times on a 12-hour clock, padded headers, blank rows and unreadable times."""
    n = F.col("event_id")
    blank = n % 31 == 0
    ts = F.when(n % 37 == 0, F.lit("nonsense")).otherwise(F.date_format("ts", "d/M/yyyy H:mm:ss"))
    label = F.when(F.col("level") == 9, "Web Attack – XSS").otherwise("BENIGN")
    cells = {
        "Flow ID": n.cast("string"), " Source IP": F.col("src"), " Destination IP": F.col("dst"), " Source Port": F.col("sport").cast("string"), " Destination Port": F.col("dport").cast("string"), " Protocol": F.col("protocol").cast("string"),
        " Timestamp": ts, " Flow Duration": (F.col("duration") * 1e6).cast("long").cast("string"), " Total Fwd Packets": F.col("packets").cast("string"), " Total Backward Packets": F.lit("1"),
        "Total Length of Fwd Packets": F.when(n % 41 == 0, "Infinity").otherwise(F.col("bytes").cast("string")), " Total Length of Bwd Packets": F.lit("2.5"),
        **{f" {f} Flag Count": F.when(F.col("tcp_flags").bitwiseAND(F.lit(b)) != 0, "1").otherwise("0") for f, b in (("FIN", 1), ("SYN", 2), ("RST", 4), ("PSH", 8), ("ACK", 16))},
        " Flow IAT Mean": F.col("iat_mean").cast("string"), " Label": label,
    }
    path = shared_folder(spark, "labelled-csv")
    events(spark, sf_dir).select(*[F.when(~blank, c).alias(name) for name, c in cells.items()]).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


LABELLED = """l AS (SELECT *, CASE WHEN event_id % 37 = 0 THEN 'rejected' ELSE 'converted' END AS status, epoch_us(date_trunc('second', ts)) + CASE WHEN hour(ts) < 8 THEN 43200000000 ELSE 0 END AS fixed FROM ev WHERE event_id % 31 <> 0)"""


@query("a5_labelled_flows", f"{EV}, {LABELLED} SELECT CAST(event_id AS VARCHAR) AS flow, status, CASE WHEN status = 'converted' THEN fixed END AS us, round(packets + 1, 6) AS packets, round(CASE WHEN event_id % 41 = 0 THEN 0 ELSE bytes END + 2.5, 6) AS bytes, round(duration, 4) AS duration, tcp_flags & 31 AS tcp_flags, CASE WHEN level = 9 THEN 'web attack - xss' ELSE 'benign' END AS label FROM l")
def a5(spark, sf_dir):
    rows = R.read_labelled_flows(spark, labelled_files(spark, sf_dir)).where("status <> 'void'")
    return rows.select(F.col("event_id").alias("flow"), "status", F.unix_micros("ts").alias("us"), F.round("packets", 6).alias("packets"), F.round("bytes", 6).alias("bytes"), F.round("duration", 4).alias("duration"), "tcp_flags", "label")


@query("a6_clock_repair", f"{EV}, {LABELLED} SELECT hour(make_timestamp(fixed)) AS hour, count(*) AS n FROM l WHERE status = 'converted' GROUP BY ALL")
def a6(spark, sf_dir):
    rows = R.read_labelled_flows(spark, labelled_files(spark, sf_dir)).where("status = 'converted'")
    return rows.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))


@query("a7_conversion_counts", f"{EV}, {LABELLED}, s AS (SELECT CASE WHEN status = 'converted' AND fixed < epoch_us(TIMESTAMP '2024-01-10') THEN 'outside' ELSE status END AS s FROM l) SELECT (SELECT count(*) FROM ev) AS read, count(*) FILTER (s = 'converted') AS converted, count(*) FILTER (s = 'rejected') AS rejected, (SELECT count(*) FROM ev WHERE event_id % 31 = 0) AS void, count(*) FILTER (s = 'outside') AS outside FROM s")
def a7(spark, sf_dir):
    return R.conversion_counts(R.read_labelled_flows(spark, labelled_files(spark, sf_dir), start="2024-01-10"))


@query("a9_dns_log", EV + " SELECT us, src, dst, domain_length, tunnel FROM ev WHERE event_type = 'view'")
def a9(spark, sf_dir):
    rows = events(spark, sf_dir).where("event_type = 'view'")
    found = R.parse_dns(lines_of(rows, "dns", clock(), "src", "dst", F.repeat(F.lit("d"), F.col("domain_length").cast("int")), F.when(F.col("tunnel") == 1, "tunnel")))
    return micros(found).select("us", "src", "dst", "domain_length", "tunnel")


@query("a10_auth_log", EV + " SELECT us, src, dst, failed_auth, CAST(88 AS INT) AS protocol FROM ev")
def a10(spark, sf_dir):
    found = R.parse_auth(lines_of(events(spark, sf_dir), "auth", clock(), "src", "dst", F.when(F.col("failed_auth") == 1, "FAILED").otherwise("OK"), F.lit("account")))
    return micros(found).select("us", "src", "dst", "failed_auth", "protocol")


@query("a11_syslog", EV + " SELECT us, src, dst, CASE WHEN level % 2 = 0 THEN failed_auth END AS failed_auth, CAST(level AS DOUBLE) AS level FROM ev WHERE event_id % 5 <> 0")
def a11(spark, sf_dir):
    rows = events(spark, sf_dir)
    failed = F.when(F.col("level") % 2 == 0, F.concat(F.lit("failed_auth="), F.when(F.col("failed_auth") == 1, "yes").otherwise("no")))
    source = F.concat(F.when(F.col("event_id") % 2 == 0, "src=").otherwise("source="), "src")
    body = F.when(F.col("event_id") % 5 == 0, F.lit("noise without pairs")).otherwise(F.concat_ws(" ", source, F.concat(F.lit("destination="), "dst"), failed, F.concat(F.lit("level="), "level"), F.lit("note=x")))
    found = R.parse_syslog(lines_of(rows, "syslog", clock(), F.lit("host app"), body))
    return micros(found).select("us", "src", "dst", "failed_auth", F.col("features")["level"].alias("level"))


STATUS = "CASE level % 4 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 404 ELSE 500 END"


@query("a12_http_log", EV + f" SELECT us, src, dst || ':/' || CASE WHEN level % 2 = 0 THEN 'login' ELSE 'home' END AS dst, CAST(dport AS DOUBLE) AS dport, CAST(event_id % 3 = 0 AND level % 2 = 0 AS DOUBLE) AS auth_attempt, CAST({STATUS} IN (401, 403, 500) OR event_id % 7 = 0 AS DOUBLE) AS failed_auth, CAST({STATUS} >= 400 AS DOUBLE) AS rst_count FROM ev")
def a12(spark, sf_dir):
    pair = lambda name, value: F.concat(F.lit(f"{name}="), value)
    path = F.when(F.col("level") % 2 == 0, "/login").otherwise("/home")
    rows = lines_of(events(spark, sf_dir), "http", clock(), pair("src", F.col("src")), pair("dst", F.col("dst")), pair("dport", F.col("dport")), pair("method", F.when(F.col("event_id") % 3 == 0, "POST").otherwise("GET")), pair("path", path), pair("status", F.expr(STATUS)), F.when(F.col("event_id") % 7 == 0, "auth=failure"))
    return micros(R.parse_http(rows)).select("us", "src", "dst", "dport", "auth_attempt", "failed_auth", "rst_count")


@query("a13_packet_lines", EV + " SELECT us, src, sport, dst, dport, tcp_flags, CAST(CAST(packets AS BIGINT) AS DOUBLE) AS bytes FROM ev")
def a13(spark, sf_dir):
    letters = F.concat(*[F.when(F.col("tcp_flags").bitwiseAND(F.lit(b)) != 0, c).otherwise("") for c, b in (("F", 1), ("S", 2), ("R", 4), ("P", 8), (".", 16), ("U", 32))])
    rows = lines_of(events(spark, sf_dir), "packets", clock(), F.lit("IP"), F.concat_ws(".", "src", "sport"), F.lit(">"), F.concat(F.concat_ws(".", "dst", "dport"), F.lit(":")), F.concat(F.lit("Flags ["), letters, F.lit("], seq 1,")), F.lit("length"), F.col("packets").cast("long"))
    return R.parse_packets(rows).select(F.unix_micros("ts").alias("us"), "src", "sport", "dst", "dport", "tcp_flags", "bytes")


def sensor_files(spark, sf_dir):
    """Events as JSON sensor lines; every 50th has no readable time and every 49th no destination."""
    n = F.col("event_id")
    rows = events(spark, sf_dir).select(F.when(n % 50 == 0, "soon").otherwise(clock()).alias("timestamp"), "src", F.when(n % 49 != 0, F.col("dst")).alias("dst"), F.when(F.col("level") < 5, "dns").alias("event_type"), F.create_map(F.lit("bytes"), F.col("bytes"), F.lit("failed_auth"), F.col("failed_auth")).alias("features"))
    path = shared_folder(spark, "sensor")
    rows.write.json(path)
    return path


SENSED = " SELECT us, src, CASE WHEN event_id % 49 <> 0 THEN dst END AS dst, CASE WHEN level < 5 THEN 'dns' ELSE 'flow' END AS event_type, round(bytes, 6) AS bytes, failed_auth FROM ev WHERE event_id % 50 <> 0"


@query("a14_sensor_lines", EV + SENSED)
def a14(spark, sf_dir):
    rows = R.sensor_rows(spark.read.schema(R.SENSOR).json(sensor_files(spark, sf_dir)))
    return rounded(rows.select(F.unix_micros("ts").alias("us"), "src", "dst", "event_type", "bytes", "failed_auth"))


@query("a21_replayed_stream", EV + SENSED)
def a21(spark, sf_dir):
    """The stored sensor folder replayed as a stream, one file a trigger."""
    stream = live.sensor_stream(spark, sensor_files(spark, sf_dir), 1).select(F.unix_micros("ts").alias("us"), "src", "dst", "event_type", F.round("bytes", 6).alias("bytes"), "failed_auth")
    return live.drain(stream, "replay", shared_folder(spark, "replay"))


@query("m10_several_sources", EV + ", s AS (" + SENSED + ") SELECT dst IS NOT NULL AS good, event_type, 2 * count(*) AS n FROM s GROUP BY ALL")
def m10(spark, sf_dir):
    """Two sensor folders as one stream; rows without a destination go to the dead letters."""
    out = None
    streams = [live.sensor_stream(spark, sensor_files(spark, sf_dir)) for _ in range(2)]
    for good, part in zip((True, False), live.several(*streams), strict=True):
        rows = live.drain(part.select("event_type"), "part", shared_folder(spark, "several")).groupBy("event_type").agg(F.count("*").alias("n")).select(F.lit(good).alias("good"), "event_type", "n")
        out = rows if out is None else out.union(rows)
    return out


@query("m7_running_incidents", f"WITH {FOUND}, {WORST}, al AS (SELECT scenario, origin + k * 10800000000 AS s, probability FROM fd WHERE is_alert), n AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY scenario ORDER BY s) > 21600000000 THEN 1 ELSE 0 END AS isnew FROM al), c AS (SELECT *, sum(isnew) OVER (PARTITION BY scenario ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chain FROM n) SELECT scenario, min(s) AS first_seen, count(*) AS findings, max(probability) AS peak FROM c GROUP BY scenario, chain")
def m7(spark, sf_dir):
    """All alerts as a stream, in sessions of up to six hours between two."""
    path = shared_folder(spark, "alerts")
    alerts(spark, sf_dir).select(F.timestamp_micros("start").alias("ts"), "scenario", "probability").write.parquet(f"{path}/in")
    schema = spark.read.parquet(f"{path}/in").schema
    stream = live.closable(spark.readStream.schema(schema).parquet(f"{path}/in"), f"{path}/end")
    out = live.drain(live.incidents(stream.withColumnRenamed("ts", "start"), "6 hours"), "incidents", f"{path}/c", (schema, f"{path}/end"))
    return out.where("scenario is not null").select("scenario", F.unix_micros("first_seen").alias("first_seen"), "findings", "peak")


HOST = "nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '')"


def feed_files(spark, sf_dir):
    """Pages as a host list with a banner line, the list type by host."""
    host = F.expr("nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '')")
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", host.alias("host")).where("host is not null and url not like '%\"%' and url not like '%,%'")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    lines = rows.select(F.concat_ws(",", *[quoted(c) for c in (F.col("page_id").cast("string"), F.lit("2026"), F.col("url"), F.lit("online"), F.lit("t"), F.concat(F.lit("list-"), F.length("host").cast("string")))]).alias("value"))
    path = shared_folder(spark, "feed")
    lines.union(spark.range(1).select(F.lit("# banner").alias("value"))).write.text(path)
    return path


@query("a17_threat_feed", f"""SELECT DISTINCT {HOST} AS indicator, '2026' AS seen, 'list-' || length({HOST}) AS list_type FROM pages WHERE {HOST} IS NOT NULL AND url NOT LIKE '%"%' AND url NOT LIKE '%,%'""")
def a17(spark, sf_dir):
    return R.read_threat_feed(spark, feed_files(spark, sf_dir)).select("indicator", "seen", "list_type")


@query("a23_feed_snapshot", f"WITH h AS (SELECT {HOST} AS indicator, page_id FROM pages), g AS (SELECT indicator, min(page_id) AS a, max(page_id) AS b FROM h WHERE indicator IS NOT NULL GROUP BY indicator), m AS (SELECT max(page_id) // 2 AS half FROM pages) SELECT indicator, CASE WHEN b > half THEN 2 ELSE 1 END AS loaded_at FROM g, m")
def a23(spark, sf_dir):
    """Two loads, each persisted: the second replaces the indicators it has and keeps the others."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.expr(HOST).alias("indicator")).where("indicator is not null")
    half, path = rows.sparkSession.read.parquet(f"{sf_dir}/pages.parquet").agg(F.floor(F.max("page_id") / 2).alias("half")), shared_folder(spark, "snapshot")
    halves = rows.join(half)
    R.save_feed(halves.where("page_id <= half").select("indicator"), None, f"{path}/1", F.lit(1))
    R.save_feed(halves.where("page_id > half").select("indicator"), spark.read.parquet(f"{path}/1"), f"{path}/2", F.lit(2))
    return spark.read.parquet(f"{path}/2").select("indicator", "loaded_at")


@query("c8_feed_staleness", EV + ", f AS (SELECT scenario, src, max(us) AS loaded_at FROM ev WHERE level = 9 GROUP BY ALL), n AS (SELECT max(us) AS now FROM ev) SELECT scenario, count(*) AS indicators, max(loaded_at) AS loaded_at, round((any_value(now) - max(loaded_at)) / 3600000000.0E0, 6) AS age_hours, (any_value(now) - max(loaded_at)) / 3600000000.0E0 > 24 AS stale FROM f, n GROUP BY scenario")
def c8_stale(spark, sf_dir):
    """Each scenario's own feed against the time of the last event."""
    rows = events(spark, sf_dir)
    feed = rows.where("level = 9").groupBy("scenario", "src").agg(F.max("us").alias("loaded_at"))
    return rounded(R.stale(feed.join(rows.agg(F.max("us").alias("now"))).groupBy("scenario"), F.max("now")))


@query("a18_a19_stored_states", f"WITH {STATES_SQL} SELECT CAST(scenario AS INT) AS scenario, k, idx, round(bytes, 6) AS bytes, round(coalesce(domain_length, 0), 6) AS domain_length, round(coalesce(edge_entropy, 0), 6) AS edge_entropy FROM st")
def a18(spark, sf_dir):
    """States written as derived windows and read again; missing features are 0."""
    path = shared_folder(spark, "derived")
    states = state_table(spark, sf_dir).select("scenario", "k", "idx", "bytes", "domain_length", "edge_entropy").withColumn("stage", F.lit("Benign"))
    R.write_states(states, ["bytes", "domain_length", "edge_entropy"], path, {"width": "6h"})
    rows, meta = R.read_states(spark, path)
    return rounded(rows.join(meta.select("width").distinct()).select("scenario", "k", "idx", "bytes", "domain_length", "edge_entropy"))


@query("a20_file_router", EV + " SELECT kind, count(*) AS files FROM (SELECT DISTINCT event_type, level, CASE level % 5 WHEN 0 THEN 'flow_csv' WHEN 1 THEN 'packets' WHEN 2 THEN 'sensor' WHEN 3 THEN 'text' END AS kind FROM ev) GROUP BY kind")
def a20(spark, sf_dir):
    ends = F.element_at(F.array(*[F.lit(x) for x in ("CSV", "pcapng", "jsonl", "log", "exe")]), (F.col("level") % 5 + 1).cast("int"))
    files = events(spark, sf_dir).select("event_type", "level").distinct().select(F.concat(F.lit("/in/"), "event_type", F.lit("."), "level", F.lit("."), ends).alias("path"))
    return R.route_files(files).groupBy("kind").agg(F.count("*").alias("files"))


@query("h11_edge_json", f"WITH {EDGES} SELECT scenario, k, src, dst, events, round(bytes, 6) AS bytes FROM edge")
def h11(spark, sf_dir):
    return rounded(R.edges_from_json(R.edges_json(edge_table(spark, sf_dir))))


@query("j6_technique_paths", """WITH RECURSIVE n AS (SELECT DISTINCT l_orderkey AS bundle, l_linenumber AS id, max(CAST(l_returnflag = 'R' AS INT)) OVER (PARTITION BY l_orderkey, l_linenumber) AS skips FROM lineitem),
l AS (SELECT a.bundle, a.id AS src, b.id AS dst FROM n AS a JOIN n AS b ON a.bundle = b.bundle AND (b.id = a.id + 1 OR (a.skips = 1 AND b.id = a.id + 2))),
w AS (SELECT bundle, id AS spot, CAST(id AS VARCHAR) AS path FROM n WHERE id = 1 UNION ALL SELECT w.bundle, l.dst, w.path || '>' || l.dst FROM w JOIN l ON w.bundle = l.bundle AND w.spot = l.src)
SELECT bundle, path FROM w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.bundle = w.bundle AND l.src = w.spot)""")
def j6(spark, sf_dir):
    """Paths through the lines of each order: to the next line, and past one after a returned line."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("bundle"), F.col("l_linenumber").alias("n")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("skips"))
    nodes = rows.select("bundle", F.col("n").cast("string").alias("id"))
    steps = rows.select("bundle", F.col("n").cast("string").alias("src"), F.explode(F.when(F.col("skips") == 1, F.array(F.col("n") + 1, F.col("n") + 2)).otherwise(F.array(F.col("n") + 1))).alias("to")).select("bundle", "src", F.col("to").cast("string").alias("dst"))
    links = steps.join(nodes.select("bundle", F.col("id").alias("dst")), ["bundle", "dst"], "left_semi").select("bundle", "src", "dst")
    return C.paths(nodes, links, nodes.where("id = '1'")).select("bundle", F.array_join("path", ">").alias("path"))


@query("j6_bundle_paths", """WITH RECURSIVE n AS (SELECT l_orderkey AS bundle, l_linenumber AS id, max(CASE WHEN l_returnflag <> 'R' THEN 'T' || l_partkey % 50 END) AS technique, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem GROUP BY l_orderkey, l_linenumber),
w AS (SELECT bundle, id, m, coalesce(technique, '') AS path FROM n WHERE id = 1 UNION ALL SELECT w.bundle, n.id, n.m, w.path || CASE WHEN w.path <> '' AND n.technique IS NOT NULL THEN '>' ELSE '' END || coalesce(n.technique, '') FROM w JOIN n ON n.bundle = w.bundle AND n.id IN (w.id + 1, w.id + 2))
SELECT bundle, path, count(*) AS ways FROM w WHERE id = m AND path <> '' GROUP BY bundle, path""")
def j6_bundles(spark, sf_dir):
    """Orders as flow bundles: a line is an action (returned ones without a technique), behind it a condition that leads to the next line or past it, or back to the first."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("bundle"), F.col("l_linenumber").alias("n")).agg(F.max(F.when(F.col("l_returnflag") != "R", F.concat(F.lit("T"), F.col("l_partkey") % 50))).alias("technique"))
    lines = lines.withColumn("m", F.max("n").over(Window.partitionBy("bundle")))
    name = lambda kind, k: F.concat(F.lit(kind), k.cast("string"))
    n, none = F.col("n"), F.array().cast("array<string>")
    refs = lambda **r: [r.get(k, F.lit(None).cast("array<string>")).alias(k) for k in C.REFS]
    node = lambda i, kind, technique, **r: F.struct(i.alias("id"), F.lit(kind).alias("type"), technique.alias("technique_id"), *refs(**r))
    empty = F.lit(None).cast("string")
    last = n >= F.col("m")
    action = node(name("a", n), "attack-action", F.col("technique"), effect_refs=F.when(last, none).otherwise(F.array(name("c", n))))
    condition = node(name("c", n), "attack-condition", empty, on_true_refs=F.array(name("a", n + 1)), on_false_refs=F.array(name("a", n + 2), F.lit("a1")))
    flow = node(F.lit("f"), "attack-flow", empty, start_refs=F.array(F.lit("a1")))
    objects = lines.groupBy("bundle").agg(F.flatten(F.collect_list(F.array(action, condition))).alias("o"))
    bundles = objects.select("bundle", F.to_json(F.struct(F.concat(F.array(flow), "o").alias("objects"))).alias("json"))
    return C.technique_paths(bundles).groupBy("bundle", F.array_join("techniques", ">").alias("path")).agg(F.count("*").alias("ways"))


@query("m8_flow_stream", EV + """, k AS (SELECT *, least(src || ':0', dst || ':' || dport) AS lo, greatest(src || ':0', dst || ':' || dport) AS hi FROM ev),
n AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR ((tcp_flags & 2) <> 0 AND (tcp_flags & 16) = 0) OR (lag(tcp_flags) OVER w & 5) <> 0 OR us - lag(us) OVER w > 86400000000 THEN 1 ELSE 0 END AS isnew FROM k WINDOW w AS (PARTITION BY lo, hi, protocol ORDER BY us)),
f AS (SELECT *, sum(isnew) OVER (PARTITION BY lo, hi, protocol ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flow FROM n)
SELECT lo, hi, protocol, min(us) AS "start", max(us) AS "end", count(*) AS packets, round(sum(bytes), 6) AS bytes FROM f GROUP BY lo, hi, protocol, flow""")
def m8(spark, sf_dir):
    """Events as packets of one stream, flows still open at its end too; no flow is as old as the age limit given here."""
    path = shared_folder(spark, "packets")
    rows = events(spark, sf_dir).select(F.timestamp_micros("us").alias("ts"), "us", "src", "dst", F.lit(0).alias("sport"), "dport", "protocol", "bytes", "tcp_flags")
    rows.write.parquet(f"{path}/in")
    schema = spark.read.parquet(f"{path}/in").schema
    stream = live.closable(spark.readStream.schema(schema).parquet(f"{path}/in"), f"{path}/end")
    out = live.drain(live.flow_stream(stream, 86_400_000_000, 1 << 62), "flows", f"{path}/c", (schema, f"{path}/end"))
    return rounded(out.where("lo <> ''"))
