"""The event contract, and its stand-ins made from the driver's star-schema and stream tables.

An event: event_id, ts, us (micros since the epoch), scenario, src, dst, event_type and nullable feature columns.
``EVENTS_SQL`` is the same mapping for the SQL side of the registered queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000
WIDTH, STRIDE = 6 * HOUR, 3 * HOUR
SECONDS = WIDTH / 1_000_000

#: Feature columns as expressions that both engines read; ``k`` is the number in the props text.
FEATURES = {
    "bytes": "value",
    "packets": "CAST(k + 1 AS DOUBLE)",
    "duration": "CAST(event_id % 1000 AS DOUBLE) / 10",
    "protocol": "CASE WHEN event_id % 10 < 6 THEN 6 WHEN event_id % 10 < 9 THEN 17 ELSE 1 END",
    "tcp_flags": "CAST(event_id % 64 AS INT)",
    "sport": "CAST(1024 + (event_id * 31) % 60000 AS INT)",
    "dport": "CAST((k * 131 + event_id % 7) AS INT)",
    "ttl": "CAST(32 + 32 * (user_id % 4) + event_id % 3 AS INT)",
    "fragment_flags": "CASE event_id % 7 WHEN 0 THEN 16384 WHEN 1 THEN 8192 ELSE 0 END",
    "frag_offset": "CAST(event_id % 5 AS INT)",
    "retransmission": "CASE WHEN event_id % 11 = 0 THEN 1.0E0 ELSE 0.0E0 END",
    "iat_mean": "CAST(event_id % 97 AS DOUBLE) / 10",
    "payload_size": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / 2 END",
    "failed_auth": "CASE WHEN event_type = 'error' THEN 1.0E0 ELSE 0.0E0 END",
    "domain_length": "CASE WHEN event_type = 'view' THEN CAST(10 + event_id % 40 AS DOUBLE) END",
    "tunnel": "CASE WHEN event_type = 'view' AND event_id % 17 = 0 THEN 1.0E0 WHEN event_type = 'view' THEN 0.0E0 END",
    "beacon": "CASE WHEN event_type = 'click' THEN CAST(event_id % 100 AS DOUBLE) / 10000 END",
    "execs": "CASE WHEN event_type = 'signup' THEN CAST(event_id % 4 AS DOUBLE) / 100 END",
    "kind": "CASE event_type WHEN 'error' THEN 'auth' WHEN 'view' THEN 'dns' ELSE 'flow' END",
    "stage": "CASE WHEN event_type = 'error' AND k >= 8 THEN 'Lateral Movement' WHEN event_type = 'error' AND k >= 5 THEN 'Reconnaissance' WHEN event_type = 'purchase' AND k = 9 THEN 'Exfiltration' ELSE 'Benign' END",
}
#: Packet-level columns, added only where a query reads them; sensors of even scenarios write ip_flags instead of fragment_flags.
PACKET_FEATURES = {
    "tcp_window_size": "CASE WHEN event_id % 10 < 6 THEN CAST(1024 + (event_id * 37) % 4096 AS DOUBLE) END",
    "iat_variance": "CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 89 AS DOUBLE) / 4 END",
    "iat_max": "CAST(event_id % 97 AS DOUBLE) / 5",
    "bidirectional_ratio": "CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 21 AS DOUBLE) / 20 END",
    **{f"{n}_count": f"CASE WHEN (event_id & {b}) <> 0 THEN 1.0E0 ELSE 0.0E0 END" for n, b in (("syn", 2), ("ack", 16), ("fin", 1), ("rst", 4), ("urg", 32))},
    "auth_attempt": "CASE WHEN event_type IN ('error', 'signup') THEN 1.0E0 END",
    "header_flags": "CASE WHEN scenario % 2 = 1 THEN fragment_flags END",
    "ip_flags": "CASE event_id % 5 WHEN 0 THEN 16384 WHEN 1 THEN 8192 ELSE 0 END",
}
BASE = "event_id, ts, user_id % 5 AS scenario, concat('user-', user_id) AS src, concat('svc-', event_type) AS dst, event_type, user_id, k AS level"

_columns = ", ".join(f"{v} AS {k}" for k, v in FEATURES.items())
EVENTS_SQL = f"""raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
ev AS (SELECT {BASE}, epoch_us(ts) AS us, {_columns} FROM raw)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table in the event contract."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return raw.selectExpr(*[x.strip() for x in ("event_id", "ts", "user_id % 5 AS scenario", "concat('user-', user_id) AS src", "concat('svc-', event_type) AS dst", "event_type", "user_id", "k AS level")], "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS us", *[f"{v} AS {k}" for k, v in FEATURES.items()])


def with_packets(rows: DataFrame) -> DataFrame:
    """rows of the event contract with the packet-level columns."""
    return rows.selectExpr("*", *[f"{v} AS {k}" for k, v in PACKET_FEATURES.items()])


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as flows at scale: supplier to part, day-sized windows."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey * 10 + l_linenumber AS event_id", "l_shipdate AS ts", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate) AS us", "l_suppkey % 16 AS scenario", "l_suppkey AS src", "l_partkey AS dst",
        "l_extendedprice AS bytes", "l_quantity AS packets", "CASE WHEN l_returnflag = 'R' THEN 4 WHEN l_linestatus = 'O' THEN 2 ELSE 16 END AS tcp_flags",
    )


FLOWS_SQL = """ev AS (SELECT l_orderkey * 10 + l_linenumber AS event_id, l_shipdate AS ts, epoch_us(l_shipdate) AS us, l_suppkey % 16 AS scenario, l_suppkey AS src, l_partkey AS dst,
 l_extendedprice AS bytes, l_quantity AS packets, CASE WHEN l_returnflag = 'R' THEN 4 WHEN l_linestatus = 'O' THEN 2 ELSE 16 END AS tcp_flags FROM lineitem)"""
