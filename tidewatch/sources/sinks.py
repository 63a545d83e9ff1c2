"""Alert rows and the sink that writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import severity_rank


def alert_payloads(findings: DataFrame, least: str = "high") -> DataFrame:
    """Alerts of at least a severity, as (key, payload JSON): for files, foreachBatch or a message queue."""
    rows = findings.where(F.col("is_alert") & (severity_rank(F.col("severity")) >= severity_rank(F.lit(least))))
    return rows.select(F.concat_ws(":", "scenario", "k", "detector").alias("key"), F.to_json(F.struct("scenario", "k", "detector", "attack_type", "probability", "severity")).alias("payload"))


class AlertSink:
    """Writer of a stream's alerts for ``foreachBatch``: each batch has a folder of its own, named by its id.

    A batch that is run again after a failure replaces its folder, so no payload is written twice, and a payload's batch is
    its place in the order of delivery. ``write`` is the delivery itself (by default Parquet files); one that posts to a
    service can skip the batches that ``delivered`` names.
    """

    def __init__(self, path: str, least: str = "high") -> None:
        self.path, self.least = path.rstrip("/"), least

    def __call__(self, findings: DataFrame, batch_id: int) -> None:
        alert_payloads(findings, self.least).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """(key, payload, batch) of all batches that a sink has written."""
    return spark.read.option("basePath", path).schema("key string, payload string, batch long").parquet(f"{path.rstrip('/')}/batch=*")
