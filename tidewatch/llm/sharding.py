"""Sharding by longest processing time.

Groups of equal texts stay together. Groups are taken by size, the largest first, and each goes to the least-loaded
shard through a heap. Equal groups that follow each other go to the shards in turns, so the heap's choices for one size
are a few runs (a first rank, and the shards in turn), and a group finds its shard by its rank inside its size. The distinct
sizes, with the number of groups of each, pass the driver in order, a part at a time; it holds the loads of the shards and
at most PIECE sizes, whose runs it appends to a table.

Sizes are UTF-8 bytes plus 8. Defined results: a null text counts as an empty one and groups with it; repeated rows are
kept and stay together; null doc_ids are kept; extra columns stay unless they bear an output name, which is replaced;
an empty table gives an empty result. Ties in size fall in the order of a hash of the text, and to the smaller shard number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, stored, with_rank

OVERHEAD = 8
#: Rows of a lookup table that may be broadcast; groups of more than 1/HOT of all rows are looked up by broadcast.
SMALL, HOT = 100_000, 1000
#: Distinct sizes whose runs are written at a time.
PIECE = 20_000


def lpt_runs(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[tuple[int, list[int]]]]]:
    """(size, runs) for (size, groups) pairs, the largest first: a run is the rank it begins at and the shards that take the groups from there in turn.

    Each group goes to the least-loaded shard, the smaller number on ties. The heap gives the shards in
    the order of their loads; those that come before the first one's next turn take turns until a further shard's load
    is reached, and all these turns are one run.
    """
    loads = [0] * shards
    for size, groups in sizes:
        rank, runs = 0, []
        while rank < groups:
            heap = [(load, s) for s, load in enumerate(loads)]
            heapq.heapify(heap)
            turn = [heapq.heappop(heap)]
            while heap and heap[0] < (turn[0][0] + size, turn[0][1]):
                turn.append(heapq.heappop(heap))
            rounds = groups
            if heap:
                (load, s), (last, t) = heap[0], turn[-1]
                rounds = (load - last - (t > s)) // size + 1
            picks = min(rounds * len(turn), groups - rank)
            whole, rest = divmod(picks, len(turn))
            runs.append((rank, [s for _, s in turn]))
            for i, (_, s) in enumerate(turn):
                loads[s] += (whole + (i < rest)) * size
            rank += picks
        yield size, runs


def shard_documents(docs: DataFrame, shards: int = 24, order_by: str | None = None) -> DataFrame:
    """docs without text, with size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in a shard) and grown_shard (null).

    order_by: a column of places from 0, distinct but for equal rows, which slots follow and which isn't returned; without
    it they follow a hash.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    sized = docs.withColumn("__size", F.octet_length(text).cast("long") + OVERHEAD).withColumn("__crc", F.crc32(text)).withColumn("__d", F.md5(text))
    sized = stored(sized.drop("text", *made).withColumnsRenamed({"__size": "size", "__crc": "text_crc32"}), "shard-sizes")
    groups = stored(sized.groupBy("__d").agg(F.sum("size").alias("__s"), F.count("*").alias("__n")), "shard-groups")
    counts = stored(groups.groupBy("__s").agg(F.count("*").alias("n")), "shard-counts")
    n_sizes, path = counts.count(), scratch_path(spark, "shard-runs")
    ordered = ((r["__s"], r["n"]) for r in counts.orderBy(F.desc("__s")).toLocalIterator())  # one partition of them at a time
    runs, schema = lpt_runs(ordered, shards), "__of long, __runs array<struct<start: long, turn: array<int>>>"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    while piece := list(islice(runs, PIECE)):
        spark.createDataFrame(piece, schema).write.mode("append").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    ranked = with_rank(groups, ["__s"], ["__d"], "__rank", ["__d"]).join(F.broadcast(table) if n_sizes <= SMALL else table, F.col("__s") == F.col("__of"))
    run = F.element_at(F.filter("__runs", lambda x: x["start"] <= F.col("__rank")), -1)
    placed = ranked.withColumn("__run", run).select(F.col("__d").alias("__g"), "__n", F.get(F.col("__run.turn"), ((F.col("__rank") - F.col("__run.start")) % F.size("__run.turn")).cast("int")).alias("shard"))
    placed = stored(placed, "shard-places")
    hot = sized.count() // HOT + 1
    large = placed.where(F.col("__n") > hot).select(F.col("__g").alias("__lg"), F.col("shard").alias("__ls"))  # fewer than HOT rows
    out = sized.join(F.broadcast(large), F.col("__d") == F.col("__lg"), "left")
    rest = out.where("__lg is null").drop("__lg", "__ls").join(placed.drop("__n"), F.col("__d") == F.col("__g")).drop("__g")
    out = rest.unionByName(out.where("__lg is not null").withColumn("shard", F.col("__ls")).drop("__lg", "__ls"))
    out = stored(out.withColumn("law", F.lit("bytes")), "shard-rows")
    order = ["doc_id", "__d"]
    slotted = with_rank(out, ["shard"], order, "slot", order, along=F.col(order_by) if order_by else None)
    return slotted.drop("__d", *([order_by] if order_by else [])).withColumn("grown_shard", F.lit(None).cast("int"))
