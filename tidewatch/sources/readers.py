"""Readers from logs and feeds to the event contract. Rows that cannot be read go to a reject frame, never away."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import any_timestamp, bit, day_first_timestamp, flag_mask, label_text, protocol_number, url_host

# Columns of the canonical flow file, and the label map of labelled flow exports.
REQUIRED = ["timestamp", "source_entity", "destination_entity", "source_port", "destination_port", "protocol", "bytes", "packets", "duration"]
OPTIONAL = [
    "tcp_flags", "syn_count", "ack_count", "fin_count", "rst_count", "iat_mean", "iat_variance", "iat_max", "bidirectional_ratio", "failed_auth",
    "auth_attempt", "ttl", "tcp_window_size", "fragment_flags", "frag_offset", "retransmission", "payload_size",
]
PLURALS = {"total fwd packets": "total fwd packet", "total backward packets": "total bwd packets", "total length of fwd packets": "total length of fwd packet", "total length of bwd packets": "total length of bwd packet"}
FORBIDDEN = {"label", "infiltration", "attack_stage", "scenario_id", "label_source"}


def numbered(rows: DataFrame) -> DataFrame:
    """rows (file, at: monotonically_increasing_id of the scan) with line_no, from 1 inside each file.

    A file's splits count their own rows; running sums over the splits give their first numbers, so no file meets in a task.
    """
    part = F.shiftright("at", 33)
    counts = rows.groupBy(F.col("file").alias("f"), part.alias("part")).agg(F.min("at").alias("begin"), F.count("*").alias("n"))
    before = Window.partitionBy("f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("f", "part", "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    out = rows.join(offsets, (F.col("file") == F.col("f")) & (part == F.col("part")))
    return out.withColumn("line_no", F.col("at") - F.col("begin") + F.col("earlier") + 1).drop("f", "part", "begin", "earlier", "at")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): numbered inside each file by offset order."""
    return numbered(spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at")))


def read_flow_csv(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Canonical flow CSV: (events, rejects). A row with a bad timestamp or number is rejected with its line number; strict: any such row raises."""
    raw = spark.read.csv(path, header=True)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    raw = numbered(raw.withColumns({"file": F.input_file_name(), "at": F.monotonically_increasing_id()})).withColumn("line_no", F.col("line_no") + 1)
    numbers = [c for c in [*REQUIRED[3:5], *REQUIRED[6:], *OPTIONAL[1:]] if c in raw.columns]
    read = {c: F.col(c).try_cast("double") for c in numbers}
    flags = flag_mask(F.col("tcp_flags")) if "tcp_flags" in raw.columns else F.lit(None).cast("int")
    bad = F.lit(False)
    for c in numbers:
        bad = bad | (F.col(c).isNotNull() & (F.trim(c) != "") & read[c].isNull())
    for c in REQUIRED:
        bad = bad | F.col(c).isNull()
    bad = bad | any_timestamp(F.col("timestamp")).isNull() | protocol_number(F.col("protocol")).isNull() | flags.isNull() & F.lit("tcp_flags" in raw.columns)
    marked = raw.withColumn("bad", F.coalesce(bad, F.lit(True)))
    rejects = marked.where("bad").select("file", "line_no")
    if strict and (first := rejects.head(1)):
        raise ValueError(f"line {first[0]['line_no']} of {first[0]['file']} can't be read")
    events = marked.where("not bad").select(
        F.concat_ws(":", F.element_at(F.split("file", "/"), -1), "line_no").alias("event_id"), any_timestamp(F.col("timestamp")).alias("ts"), F.col("source_entity").alias("src"), F.col("destination_entity").alias("dst"),
        F.lit("flow").alias("event_type"), protocol_number(F.col("protocol")).alias("protocol"), flags.alias("tcp_flags"), *[read[c].alias({"source_port": "sport", "destination_port": "dport"}.get(c, c)) for c in numbers],
        F.lit("flow_csv").alias("source_format"), F.col("file").alias("provenance"),
    )
    return events, rejects


def coverage(columns: list[str], rows: DataFrame) -> DataFrame:
    """One row: rows, and which optional columns are present and missing."""
    there = [c for c in OPTIONAL if c in columns]
    return rows.agg(F.count("*").alias("rows")).withColumns({"present": F.lit(",".join(there)), "missing": F.lit(",".join(c for c in OPTIONAL if c not in there))})


def read_labelled_flows(spark: SparkSession, path: str, encoding: str = "utf-8", start: str | None = None, end: str | None = None) -> DataFrame:
    """Labelled flow export: headers stripped and made singular, infinities to 0, microseconds to seconds, both directions summed.

    status is 'void' for rows with neither label nor timestamp, 'rejected' where the timestamp can't be read,
    'outside' the asked range, else 'converted'.
    """
    raw = spark.read.csv(path, header=True, encoding=encoding)
    names = {c: PLURALS.get(c.strip().lower(), c.strip().lower()) for c in raw.columns}
    raw = raw.withColumnsRenamed(names)

    def number(name: str) -> Column:
        v = F.col(f"`{name}`").try_cast("double")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(F.greatest(v, F.lit(0.0)))

    ts = day_first_timestamp(F.col("timestamp"))
    void = (F.coalesce(F.trim("label"), F.lit("")) == "") & (F.coalesce(F.trim("timestamp"), F.lit("")) == "")
    inside = F.lit(True)
    if start:
        inside = inside & (ts >= F.lit(start).cast("timestamp"))
    if end:
        inside = inside & (ts <= F.lit(end).cast("timestamp"))
    status = F.when(void, "void").when(ts.isNull(), "rejected").when(~inside, "outside").otherwise("converted")
    flags = sum((F.when(number(f"{n} flag count") > 0, F.lit(b)).otherwise(F.lit(0)) for n, b in (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16))), F.lit(0))
    return raw.select(
        status.alias("status"), F.coalesce(F.nullif(F.trim("flow id"), F.lit("")), F.concat_ws("-", "source ip", "destination ip", "timestamp")).alias("event_id"), ts.alias("ts"), F.col("source ip").alias("src"), F.col("destination ip").alias("dst"),
        number("source port").alias("sport"), number("destination port").alias("dport"), number("protocol").cast("int").alias("protocol"), (number("flow duration") / 1e6).alias("duration"),
        (number("total fwd packet") + number("total bwd packets")).alias("packets"), (number("total length of fwd packet") + number("total length of bwd packet")).alias("bytes"),
        flags.alias("tcp_flags"), number("flow iat mean").alias("iat_mean"), label_text(F.col("label")).alias("label"),
    )


def conversion_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("read"), *[F.count_if(F.col("status") == s).alias(s) for s in ("converted", "rejected", "void", "outside")])


def map_labels(rows: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with stage and infiltration, distinct labels without a rule); rules: label, stage, infiltration."""
    keyed = rules.select(label_text(F.col("label")).alias("rule"), "stage", "infiltration")
    return rows.join(keyed, F.col("label") == F.col("rule")).drop("rule"), rows.join(keyed, F.col("label") == F.col("rule"), "left_anti").select("label").distinct()


def parse_dns(lines: DataFrame, origin: Column | None = None) -> DataFrame:
    """Lines of ``ts client resolver domain [tunnel]``; lines of fewer columns are skipped; a bad time counts seconds from origin."""
    p = F.split(F.trim("line"), r"\s+")
    base = origin if origin is not None else F.timestamp_seconds(F.lit(0))
    ts = F.coalesce(any_timestamp(p[0]), F.timestamp_seconds(F.unix_timestamp(base) + F.col("line_no") - 1))
    return lines.where(F.size(p) >= 4).select(F.concat_ws(":", F.lit("dns"), "line_no").alias("event_id"), ts.alias("ts"), p[1].alias("src"), p[2].alias("dst"), F.lit("dns").alias("event_type"), F.length(p[3]).cast("double").alias("domain_length"), F.coalesce((F.get(p, 4) == "tunnel").cast("double"), F.lit(0.0)).alias("tunnel"))


def parse_auth(lines: DataFrame) -> DataFrame:
    """Lines of ``ts host target FAILED|OK account``."""
    p = F.split(F.trim("line"), r"\s+")
    return lines.where((F.size(p) >= 4) & any_timestamp(p[0]).isNotNull()).select(F.concat_ws(":", F.lit("auth"), "line_no").alias("event_id"), any_timestamp(p[0]).alias("ts"), p[1].alias("src"), p[2].alias("dst"), F.lit("auth").alias("event_type"), (F.upper(p[3]) == "FAILED").cast("double").alias("failed_auth"), F.lit(88).alias("protocol"))


def parse_syslog(lines: DataFrame) -> DataFrame:
    """``ts host app k=v ...``: source and destination by either name, failed_auth by word or 1, numeric values kept; noise is left out."""
    p = F.split(F.trim("line"), r"\s+")
    pairs = F.filter(p, lambda x: x.rlike(r"^[^=]+=.+$"))
    m = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.lower(F.substring_index(x, "=", 1)).alias("key"), F.substring_index(x, "=", -1).alias("value")))))
    src, dst = F.coalesce(m["src"], m["source"]), F.coalesce(m["dst"], m["destination"])
    numbers = F.map_filter(F.transform_values(m, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
    failed = F.when(F.lower(m["failed_auth"]).isin("yes", "true", "1"), 1.0).when(m["failed_auth"].isNotNull(), 0.0)
    rows = lines.select(F.concat_ws(":", F.lit("syslog"), "line_no").alias("event_id"), any_timestamp(p[0]).alias("ts"), src.alias("src"), dst.alias("dst"), F.lit("syslog").alias("event_type"), failed.alias("failed_auth"), numbers.alias("features"))
    return rows.where("ts is not null and src is not null and dst is not null")


def parse_http(lines: DataFrame) -> DataFrame:
    """Access-log lines with src= dst= dport= method= path= status= [auth=]."""
    field = lambda n: F.nullif(F.regexp_extract("line", rf"\b{n}=(\S+)", 1), F.lit(""))
    status, path = field("status").try_cast("int"), field("path")
    failed = status.isin(401, 403, 500) | (F.coalesce(field("auth"), F.lit("")) == "failure")
    return lines.where(field("src").isNotNull() & path.isNotNull()).select(
        F.concat_ws(":", F.lit("http"), "line_no").alias("event_id"), any_timestamp(F.split(F.trim("line"), r"\s+")[0]).alias("ts"), field("src").alias("src"), F.concat_ws(":", field("dst"), path).alias("dst"), F.lit("http").alias("event_type"), field("dport").try_cast("double").alias("dport"),
        ((field("method") == "POST") & path.contains("login")).cast("double").alias("auth_attempt"), F.coalesce(failed, F.lit(False)).cast("double").alias("failed_auth"), F.coalesce(status >= 400, F.lit(False)).cast("double").alias("rst_count"),
    )


PACKET = r"^(\S+(?: \S+)?) IP (\S+)\.(\d+) > (\S+)\.(\d+): Flags \[([^\]]*)\].*length (\d+)"


def parse_packets(lines: DataFrame) -> DataFrame:
    """Packet text lines: ``ts IP a.port > b.port: Flags [..], ... length n``."""
    g = lambda i: F.regexp_extract("line", PACKET, i)
    mask = sum((F.when(g(6).contains(c), F.lit(b)).otherwise(F.lit(0)) for c, b in (("F", 1), ("S", 2), ("R", 4), ("P", 8), (".", 16), ("U", 32))), F.lit(0))
    return lines.where(F.col("line").rlike(PACKET)).select(F.col("line_no").alias("packet_no"), any_timestamp(g(1)).alias("ts"), g(2).alias("src"), g(3).cast("int").alias("sport"), g(4).alias("dst"), g(5).cast("int").alias("dport"), mask.alias("tcp_flags"), g(7).cast("double").alias("bytes"))


def mark_retransmissions(packets: DataFrame) -> DataFrame:
    """1 where the same addresses, ports and sequence number came earlier in the capture."""
    order = Window.partitionBy("src", "dst", "sport", "dport", "seq").orderBy("packet_no")
    return packets.withColumn("retransmission", (F.row_number().over(order) > 1).cast("double"))


NUMBERED = "lo string, hi string, protocol int, us long, bytes double, tcp_flags int, forward boolean, gap long, new int, flow long"


def _numbered(age: int | None):
    """Flow numbers of packets that stream by sorted by key and time: a flow ends before a packet marked new, or at the age limit.

    Only the open flow's key, number and start are kept from batch to batch, so a key of any length needs no memory. Inside
    a batch each flow is one search for the first packet beyond its age, not a step for each packet.
    """

    def run(batches):
        key, flow, start = None, 0, 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            us, new = batch.column("us").to_numpy(), batch.column("new").to_numpy().astype(bool)
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "protocol")), strict=True))
            other = np.array([keys[0] != key, *(a != b for a, b in zip(keys[1:], keys[:-1], strict=True))])
            bounds = np.append(np.flatnonzero(new | other), n)
            flows, firsts = np.empty(n, np.int64), np.zeros(n, np.int32)
            i = 0
            while i < n:
                if other[i]:
                    flow = 0
                if other[i] or new[i] or age is not None and us[i] > start + age:
                    flow, start, firsts[i] = flow + 1, int(us[i]), 1
                end = int(bounds[np.searchsorted(bounds, i, side="right")])
                stop = end if age is None else i + max(1, int(np.searchsorted(us[i:end], start + age, side="right")))
                flows[i:stop] = flow
                i = stop
            key = keys[-1]
            columns = [batch.column(c) for c in batch.schema.names if c != "new"]
            names = [c for c in batch.schema.names if c != "new"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(firsts), pa.array(flows)], [*names, "new", "flow"])

    return run


def assemble_flows(packets: DataFrame, idle: int = 15_000_000, age: int | None = 60_000_000) -> DataFrame:
    """Packets (us, src, dst, sport, dport, protocol, bytes, tcp_flags, packet_no) to two-way flows.

    Both directions share one key. A flow begins at a SYN without ACK, after FIN or RST, after ``idle`` micros of silence,
    or with the first packet more than ``age`` micros after its start (no limit: None). Where a flow ends by age depends
    on where it began, so a key's packets stream by in order; nothing of them is held but the open flow's start.
    """
    a, b = F.concat_ws(":", "src", "sport"), F.concat_ws(":", "dst", "dport")
    keyed = packets.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.col("protocol").cast("int").alias("protocol"), F.col("us").cast("long").alias("us"), "packet_no", F.col("bytes").cast("double").alias("bytes"), F.col("tcp_flags").cast("int").alias("tcp_flags"), (a <= b).alias("forward"))
    order = Window.partitionBy("lo", "hi", "protocol").orderBy("us", "packet_no")
    last = F.lag(F.struct("us", "tcp_flags")).over(order)
    opens = bit("tcp_flags", 2) & ~bit("tcp_flags", 16)
    closed = last["tcp_flags"].bitwiseAND(F.lit(5)) != 0
    new = F.coalesce((opens | closed | (F.col("us") - last["us"] > idle)).cast("int"), F.lit(1))
    marked = keyed.withColumns({"gap": F.col("us") - last["us"], "new": new})
    # the frame above has the rows in this order already, so this sorts nothing again
    ordered = marked.sortWithinPartitions("lo", "hi", "protocol", "us", "packet_no").drop("packet_no")
    numbered = ordered.mapInArrow(_numbered(age), NUMBERED)
    gap = F.when(F.col("new") == 0, F.col("gap") / 1000)
    return numbered.groupBy("lo", "hi", "protocol", "flow").agg(F.min("us").alias("start"), F.max("us").alias("end"), F.count("*").alias("packets"), F.sum("bytes").alias("bytes"), F.sum(F.when(~F.col("forward"), F.col("bytes")).otherwise(0.0)).alias("reverse_bytes"), F.bit_or("tcp_flags").alias("tcp_flags"), F.avg(gap).alias("iat_mean"))


def read_threat_feed(spark: SparkSession, path: str, most: int = 50_000) -> DataFrame:
    """Indicators of a host list, with or without header: comments dropped, last row per host, the newest ``most`` of them."""
    rows = text_lines(spark, path).where(~F.col("line").startswith("#") & F.col("line").contains("://"))
    cells = F.from_csv("line", ", ".join(f"c{i} string" for i in range(9)))
    parsed = rows.select("line_no", cells.alias("c")).select("line_no", "c.*")
    url = F.coalesce(*[F.when(F.col(f"c{i}").contains("://"), F.col(f"c{i}")) for i in range(9)])
    found = parsed.select(url_host(url).alias("indicator"), F.col("c1").alias("seen"), F.coalesce("c5", F.lit("unknown")).alias("list_type"), "line_no").where("indicator is not null")
    return latest(found, ["indicator"], "line_no").orderBy(F.col("line_no").desc()).limit(most)


def save_feed(feed: DataFrame, previous: DataFrame | None, path: str, loaded_at: Column) -> None:
    """The indicator set after a load, as a table: new rows replace those of the same indicator, the others stay with their own time of loading."""
    now = feed.withColumn("loaded_at", loaded_at)
    merged = now if previous is None else now.unionByName(previous, allowMissingColumns=True)
    latest(merged, ["indicator"], "loaded_at").write.mode("overwrite").parquet(path)


def stale(feed, now: Column, hours: float = 24.0) -> DataFrame:
    """Of a feed, or of each group of a grouped one: indicators, when the feed was last loaded, its age in hours, and whether that is too old (never loaded is)."""
    age = (now - F.max("loaded_at")) / 3_600_000_000
    return feed.agg(F.count("*").alias("indicators"), F.max("loaded_at").alias("loaded_at"), age.alias("age_hours"), F.coalesce(age > hours, F.lit(True)).alias("stale"))


# Which reader a file's ending asks for.
ROUTES = {"csv": "flow_csv", "tsv": "flow_csv", "pcap": "packets", "pcapng": "packets", "cap": "packets", "jsonl": "sensor", "log": "text"}


def route_files(files: DataFrame) -> DataFrame:
    """(path, kind): the reader of each file by its ending; one without a reader has the kind null, which callers report."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lit(None).cast("string")
    for end, name in ROUTES.items():
        kind = F.when(ending == end, name).otherwise(kind)
    return files.withColumn("kind", kind)


def edges_json(edge_rows: DataFrame) -> DataFrame:
    """(scenario, k, edge_summary): each window's edges as one JSON text, by source and destination."""
    edge = F.struct("src", "dst", "events", "bytes")
    return edge_rows.groupBy("scenario", "k").agg(F.to_json(F.array_sort(F.collect_list(edge))).alias("edge_summary"))


def edges_from_json(rows: DataFrame) -> DataFrame:
    """The edges of edges_json(), a row each."""
    return rows.select("scenario", "k", F.explode(F.from_json("edge_summary", "array<struct<src: string, dst: string, events: long, bytes: double>>")).alias("e")).select("scenario", "k", "e.*")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by ``order``; keeps all columns."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(*keys, "x.*")


def validate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects with reason) of the event contract."""
    reason = F.when(F.coalesce(F.length("event_id"), F.lit(0)) == 0, "event_id").when(F.col("ts").isNull(), "ts").when(F.coalesce(F.length("src"), F.lit(0)) == 0, "src").when(F.coalesce(F.length("dst"), F.lit(0)) == 0, "dst").when(~F.coalesce(F.col("event_type").isin("flow", "packet", "dns", "auth", "syslog", "http"), F.lit(False)), "event_type")
    marked = events.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def union_events(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


SENSOR = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("features", T.MapType(T.StringType(), T.DoubleType()))])


def sensor_rows(raw: DataFrame) -> DataFrame:
    """JSON sensor lines, batch or stream, in the event contract."""
    return raw.select(any_timestamp(F.col("timestamp")).alias("ts"), "src", "dst", F.coalesce("event_type", F.lit("flow")).alias("event_type"), F.col("features")["bytes"].alias("bytes"), F.col("features")["failed_auth"].alias("failed_auth"), "features").where("ts is not null")


def write_states(states: DataFrame, features: list[str], path: str, facts: dict) -> None:
    """Derived windows: f_ columns with missing as 0, by scenario, and a sidecar of facts and stage counts."""
    rows = states.select(*[c for c in states.columns if c not in features], *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"f_{f}") for f in features])
    rows.write.mode("overwrite").partitionBy("scenario").parquet(f"{path}/windows")
    counts = states.groupBy("stage").agg(F.count("*").alias("n")).withColumns({k: F.lit(str(v)) for k, v in facts.items()})
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_states(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(windows with plain feature names, sidecar); the sidecar must be there; NaN counts as absent."""
    meta = spark.read.json(f"{path}/meta")
    rows = spark.read.parquet(f"{path}/windows")
    return rows.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c[2:]) if c.startswith("f_") else F.col(c) for c in rows.columns]), meta
