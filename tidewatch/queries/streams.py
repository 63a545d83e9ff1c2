"""Streaming queries drained over the events table: M1 to M4, M6, M9, M10, A14, A21."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..events import FEATURES
from ..streaming import live
from ..plans.tables import shared_folder

QUERIES, ORACLE_SQL = {}, {}


def stream(spark, sf_dir):
    """The events table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("scenario"), F.col("value").alias("bytes"), F.expr(FEATURES["failed_auth"]).alias("failed_auth"))


def flushed(spark, sf_dir, width: str, stride: str | None = None):
    """All windows of the events table, the last open ones too."""
    path = shared_folder(spark, "stream")
    rows = stream(spark, sf_dir)
    return live.drain(live.windows(live.closable(rows, f"{path}/end"), width, stride), "windows", f"{path}/c", (rows.schema, f"{path}/end"))


E = "WITH e AS (SELECT user_id % 5 AS scenario, ts, value, CAST(event_type = 'error' AS INT) AS f FROM events)"


@(lambda f: QUERIES.setdefault("m1_tumbling_windows", f))
def m1(spark, sf_dir):
    out = flushed(spark, sf_dir, "3 hours")
    return out.select("scenario", F.unix_micros("start").alias("start_us"), "event_count", F.round("bytes", 6).alias("bytes"), F.round("failed_auth", 6).alias("failed_auth"))


ORACLE_SQL["m1_tumbling_windows"] = E + ", w AS (SELECT scenario, epoch_us(time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01')) AS start_us, count(*) AS event_count, round(sum(value), 6) AS bytes, round(CAST(sum(f) AS DOUBLE), 6) AS failed_auth FROM e GROUP BY ALL) SELECT * FROM w"


@(lambda f: QUERIES.setdefault("m2_sliding_windows", f))
def m2(spark, sf_dir):
    out = flushed(spark, sf_dir, "6 hours", "3 hours")
    return out.select("scenario", F.unix_micros("start").alias("start_us"), "event_count", F.round("bytes", 6).alias("bytes"))


ORACLE_SQL["m2_sliding_windows"] = E + ", s AS (SELECT scenario, value, ts, epoch_us(time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01')) AS b FROM e), x AS (SELECT scenario, value, unnest([b, b - 10800000000]) AS start_us FROM s), w AS (SELECT scenario, start_us, count(*) AS event_count, round(sum(value), 6) AS bytes FROM x GROUP BY ALL) SELECT * FROM w"


@(lambda f: QUERIES.setdefault("m6_history_scoring", f))
def m6(spark, sf_dir):
    """Tumbling windows written by one stream, scored by another that keeps the last three of each scenario."""
    path = shared_folder(spark, "stream")
    rows = stream(spark, sf_dir)
    states = live.windows(live.closable(rows, f"{path}/end"), "3 hours")
    start = lambda: states.writeStream.format("parquet").option("path", f"{path}/states").option("checkpointLocation", f"{path}/c1").trigger(availableNow=True).start()
    live.finish(start, (rows.schema, f"{path}/end"))
    held = spark.readStream.schema("scenario long, start timestamp, end timestamp, event_count long, bytes double, failed_auth double").parquet(f"{path}/states")
    return live.drain(live.score_history(held), "scores", f"{path}/c2").select("scenario", F.unix_micros("start").alias("start_us"), F.round("z", 6).alias("z"), "held")


ORACLE_SQL["m6_history_scoring"] = ORACLE_SQL["m1_tumbling_windows"].replace(" SELECT * FROM w", ", c AS (SELECT * FROM w") + "), h AS (SELECT *, avg(bytes) OVER p AS mu, stddev_pop(bytes) OVER p AS sd, count(*) OVER p AS held FROM c WINDOW p AS (PARTITION BY scenario ORDER BY start_us ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) SELECT scenario, start_us, round(CASE WHEN held < 3 THEN 0 WHEN sd = 0 THEN 6 ELSE (bytes - mu) / sd END, 6) AS z, CAST(held AS INT) AS held FROM h"


@(lambda f: QUERIES.setdefault("m9_live_status", f))
def m9(spark, sf_dir):
    """Windows, peak and alert of each scenario, those beyond the newest 100, and the rows that the streams read and dropped as late."""
    with live.counting(spark) as counts:
        scored = m6(spark, sf_dir)
    markers, windows = 1, scored.count()  # the closing row, and the second stream's input
    seen, dropped = sum(counts.seen.values()) - markers - windows, sum(counts.dropped.values())
    out = live.status(scored, 6.0, 100).select("scenario", "windows", F.round("peak", 6).alias("peak"), "alert", "evicted")
    return out.withColumns({"events_seen": F.lit(seen).cast("long"), "late_dropped": F.lit(dropped).cast("long")})


ORACLE_SQL["m9_live_status"] = "SELECT scenario, count(*) AS windows, max(z) AS peak, max(z) >= 6 AS alert, greatest(count(*) - 100, 0) AS evicted, (SELECT count(*) FROM events) AS events_seen, CAST(0 AS BIGINT) AS late_dropped FROM (" + ORACLE_SQL["m6_history_scoring"] + ") GROUP BY scenario"
