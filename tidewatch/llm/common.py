"""Shared helpers: stored intermediate tables, distributed ranks, Arrow column access."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from spark.checkpoint.dir; one of its own only where that is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hold Arrow batches to so many rows: several batches are in memory at once, in the JVM and in Python, for each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def with_rank(df: DataFrame, group: list[str], order: list, name: str, hash_of: list, bucket_rows: int = 20_000, along: Column | None = None) -> DataFrame:
    """Gapless 0-based position inside each group, without one task per group.

    Rows are ordered by a 64-bit hash of ``hash_of`` and then by ``order``; with ``along``, a column of distinct values
    from 0 to about the number of rows, by it instead. Its range is cut into equal buckets, each bucket is numbered by
    itself, and running sums over the bucket counts (groups x buckets rows) give the offsets. A group of any size is
    spread over its buckets. df is read twice, so it should be stored or cheap.
    """
    n, tasks = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(n / bucket_rows, min(4 * tasks, n / 500), 1)
    bits = max(0, int(np.ceil(np.log2(buckets))))
    if along is None:
        hashed = df.withColumn("__h", F.xxhash64(*hash_of))
        hashed = hashed.withColumn("__b", F.shiftright(F.col("__h"), 64 - bits) if bits else F.lit(0).cast("long"))
    else:
        hashed = df.withColumn("__h", along.cast("long")).withColumn("__b", F.floor(F.col("__h") / max(1.0, n / buckets)))
    counts = hashed.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    names = [F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]
    offsets = counts.select(*names, F.col("__b").alias("__gb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*group, "__b").orderBy("__h", *order)
    ranked = hashed.withColumn("__r", F.row_number().over(inside) - 1)
    on = F.col("__b").eqNullSafe(F.col("__gb"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = ranked.join(offsets, on).withColumn(name, F.col("__off") + F.col("__r"))
    return out.drop("__h", "__b", "__r", "__off", "__gb", *[f"__g{i}" for i in range(len(group))])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after the other, and len+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20):
    """Ranges of documents of about ``limit`` bytes each; a longer document stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)
