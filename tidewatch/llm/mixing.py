"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in an order drawn by hash, form blocks of BLOCK documents. With whole-number weights that add up
to W among the sources that still have blocks, block j (from 1) of a source of weight w is released at slot
floor((j-1) W / w) and is due by slot ceil(j W / w); each slot takes the released block with the earliest deadline
(ties by source name). No source is ever a whole block away from its share. The pattern repeats after W slots, so it is
made once for W slots and joined to the blocks: a table of at most sources x W rows, whatever the corpus. When a source
runs out, the others go on with their own weights as the next phase, so every document has a place.

The driver holds the schedule, a row for each source of each phase: quadratic in the number of sources, which is
therefore bounded by MOST_SOURCES; a corpus with more of them raises, and its rare sources have to be named alike first.
A period has as many slots as the weights add up to; MOST_SLOTS bounds them, and weights are whole numbers from 1 on.

mixed_order() places narrow rows (source and a 64-bit key) and finds the first key of each source in each output part;
these cuts say for every document which part it goes to, so its text is shuffled once, and is numbered inside the part. stored_places() gives this order back to whoever reads its files.

Defined results: a null source is a source of its own (its target has the key None), beside the empty one; a null or empty text is placed like any other;
repeated rows each have a place; null doc_ids are kept; extra columns stay (mix_sources replaces those that bear an output
name, mixed_order keeps all); an empty table gives an empty result. A source without a target has the weight 1. Rows equal
in doc_id and text can't be cut, so they stay in one part of mixed_order, where they follow each other in slot order.
"""

from __future__ import annotations

import heapq
from functools import reduce
from math import gcd

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, with_rank

BLOCK = 16
MOST_SOURCES, MOST_CUTS, MOST_SLOTS = 512, 1 << 17, 1 << 16
#: Production targets: the share of each source, all others 1.
TARGETS = {"src0": 4, "src1": 3, "src2": 2, "src3": 2}


def pattern(weights: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of one period, block and slot from 0."""
    total = sum(weights.values())
    waiting = {0: [(-(-total // w), s, 0) for s, w in weights.items()]}
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total):
        for x in waiting.pop(slot, ()):
            heapq.heappush(ready, x)
        due, source, j = heapq.heappop(ready)
        w = weights[source]
        out.append((source, j, slot, j * total // w, due))
        if j + 1 < w:
            release = (j + 1) * total // w
            if release <= slot + 1:
                waiting.setdefault(slot + 1, []).append((-(-(j + 2) * total // w), source, j + 1))
            else:
                waiting.setdefault(release, []).append((-(-(j + 2) * total // w), source, j + 1))
    return out


def source_name(column: str = "source") -> Column:
    """A source's name after '=', so that a null source (an empty string) differs from an empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def target(targets: dict, name: str) -> int:
    """The weight of a source by its source_name()."""
    weight = targets.get(name[1:] if name else None, 1)
    if not isinstance(weight, int) or isinstance(weight, bool) or weight < 1:
        raise ValueError(f"the weight of source {name[1:] if name else None!r} is {weight!r}; weights are whole numbers from 1 on")
    return weight


def phases(blocks: dict[str, int], targets: dict[str, int]) -> list[tuple]:
    """(source, from block, to block, weight, first slot, period, phase): the stretch of blocks that each source has in each phase.

    A phase ends after the slot in which one of its sources has taken its last block. It begins a new pattern.
    """
    left, done, slot, out, phase = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, [], 0
    while left:
        raw = {s: target(targets, s) for s in left}
        g = reduce(gcd, raw.values())
        weights = {s: w // g for s, w in raw.items()}
        total = sum(weights.values())
        if total > MOST_SLOTS:
            raise ValueError(f"the weights add up to {total} slots, more than {MOST_SLOTS}: give smaller whole numbers")
        table = pattern(weights)
        at = {(s, j): k for s, j, k, _, _ in table}
        end = min((left[s] - 1) // weights[s] * total + at[s, (left[s] - 1) % weights[s]] for s in left) + 1
        rounds, rest = divmod(end, total)
        inside = dict.fromkeys(left, 0)
        for s, _, k, _, _ in table:
            inside[s] += k < rest
        for s in sorted(left):
            n = rounds * weights[s] + inside[s]
            out.append((s, done[s], done[s] + n, weights[s], slot, total, phase))
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        slot, phase = slot + end, phase + 1
    return out


def content_key(docs: DataFrame) -> Column:
    """A 64-bit key of a row's doc_id and text (of its doc_id alone where there is no text column)."""
    return F.xxhash64("doc_id", *([F.xxhash64("text")] if "text" in docs.columns else []))


def counted(docs: DataFrame, block: int) -> dict[str, int]:
    """Blocks of each source; raises beyond MOST_SOURCES."""
    rows = docs.groupBy(source_name().alias("s")).agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: give rare ones a common name first")
    return {r["s"]: -(-r["n"] // block) for r in rows}


def scheduled(ranked: DataFrame, blocks: dict[str, int], targets: dict[str, int] | None, block: int) -> DataFrame:
    """ranked (__s, and __pos in its source) with block, phase, release, deadline, slot and place; blocks: those of each source."""
    spark, targets = ranked.sparkSession, TARGETS if targets is None else targets
    stretches = phases(blocks, targets)
    table = spark.createDataFrame(stretches, "__ps string, __from long, __to long, __w long, __base long, __period long, phase int")
    slots = [(phase, s, j, k, release, due) for phase in sorted({x[6] for x in stretches}) for s, j, k, release, due in pattern({x[0]: x[3] for x in stretches if x[6] == phase})]
    pieces = spark.createDataFrame(slots, "__phase int, __qs string, __j long, __k long, __release long, __due long")
    ranked = ranked.withColumn("block", F.floor(F.col("__pos") / block)).withColumn("place", F.col("__pos") % block)
    # both tables are bounded: MOST_SOURCES x phases, and phases x MOST_SLOTS rows
    out = ranked.join(F.broadcast(table), (F.col("__s") == F.col("__ps")) & (F.col("block") >= F.col("__from")) & (F.col("block") < F.col("__to")))
    out = out.withColumn("__o", F.col("block") - F.col("__from")).withColumn("__m", F.col("__o") % F.col("__w")).withColumn("__t", F.floor(F.col("__o") / F.col("__w")) * F.col("__period") + F.col("__base"))
    out = out.join(F.broadcast(pieces), (F.col("phase") == F.col("__phase")) & (F.col("__s") == F.col("__qs")) & (F.col("__m") == F.col("__j")))
    out = out.withColumn("slot", F.col("__t") + F.col("__k")).withColumn("release", F.col("__t") + F.col("__release")).withColumn("deadline", F.col("__t") + F.col("__due"))
    return out.drop("__o", "__m", "__t", *table.drop("phase").columns, *pieces.columns)


def mix_sources(docs: DataFrame, targets: dict[str, int] | None = None, block: int = BLOCK, key: Column | None = None) -> DataFrame:
    """docs with block (in its source), phase, release, deadline, slot (place of the block in the whole) and place (of the document in it).

    key: what a source's documents are ordered by, content_key() if it isn't given.
    """
    made = ["block", "phase", "release", "deadline", "slot", "place"]
    kept = [c for c in docs.columns if c not in made]
    keyed = docs.select(*own_names(kept), source_name().alias("__s"), (content_key(docs) if key is None else key).alias("__key"))
    ranked = with_rank(keyed, ["__s"], ["__key"], "__pos", ["__key"])
    out = scheduled(ranked, counted(docs, block), targets, block)
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)], *made)


def own_names(columns: list[str]) -> list[Column]:
    """The columns under names that nothing here uses."""
    return [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)]


def cell(h: Column, parts: int) -> Column:
    """The cell of a hash: its leading bits, about four cells a part or more."""
    return F.shiftright(h, 64 - max(1, (4 * parts - 1).bit_length()))


def cuts(docs: DataFrame, blocks: dict[str, int], targets: dict[str, int] | None, block: int, parts: int) -> DataFrame:
    """(__cs, __cell, __cut): for each source and cell of the hash range the cuts (first hash, part, rank) that reach into it."""
    source = source_name().alias("__s")
    narrow = stored(docs.select(source, content_key(docs).alias("__key")), "mix-keys")
    ranked = with_rank(narrow, ["__s"], ["__key"], "__pos", ["__key"])
    placed = stored(scheduled(ranked, blocks, targets, block).select("__s", F.xxhash64("__key").alias("h"), "__pos", "slot"), "mix-slots")
    total = (placed.agg(F.max("slot")).first()[0] or 0) + 1
    equal = placed.groupBy("__s", "h").agg(F.min("__pos").alias("first"), F.min(F.floor(F.col("slot") * parts / F.lit(total))).cast("int").alias("part"))
    found = equal.groupBy("__s", "part").agg(F.min("h").alias("h"), F.min("first").alias("first"))  # sources x parts rows, MOST_CUTS at most
    following = F.coalesce(F.lead("h").over(Window.partitionBy("__s").orderBy("h")), F.lit((1 << 63) - 1))
    reach = F.sequence(cell(F.col("h"), parts), cell(following, parts))
    wide = found.select("__s", F.struct("h", "part", "first").alias("cut"), reach.alias("cells")).select("__s", "cut", F.explode("cells").alias("cell"))
    return wide.groupBy(F.col("__s").alias("__cs"), F.col("cell").alias("__cell")).agg(F.array_sort(F.collect_list("cut")).alias("__cut"))


def stored_places(docs: DataFrame, name: str) -> DataFrame | None:
    """docs with the places of its rows in the files it is read from, in the order in which a job wrote them, from 0; None if it isn't read from files.

    The files' counts are a table of one row a file; what is filtered out of docs leaves gaps at most.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        at = docs.select("*", meta["file_path"].alias("__file"), meta["row_index"].alias("__row"))
    except AnalysisException:
        return None
    part = F.regexp_extract("__file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    files = stored(at.groupBy("__file").agg(F.max("__row").alias("__last")), "file-rows")
    before = F.sum(F.col("__last") + 1).over(Window.orderBy(part, "__file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select(F.col("__file").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    return at.join(F.broadcast(files), F.col("__file") == F.col("__of")).withColumn(name, F.col("__before") + F.col("__row")).drop("__file", "__row", "__of", "__before")


def mixed_order(docs: DataFrame, targets: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """The columns of docs, its rows in the mixed order: part by part, sorted inside. The rows with their text meet one shuffle."""
    blocks = counted(docs, block)
    parts = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_CUTS // max(1, len(blocks))))
    table = cuts(docs, blocks, targets, block, parts)
    keyed = docs.select(*own_names(docs.columns), source_name().alias("__s"), F.xxhash64(content_key(docs)).alias("__h"))
    # MOST_CUTS times about five rows at most
    on = (F.col("__s") == F.col("__cs")) & (cell(F.col("__h"), parts) == F.col("__cell"))
    placed = keyed.join(F.broadcast(table), on).withColumn("__at", F.element_at(F.filter("__cut", lambda x: x["h"] <= F.col("__h")), -1)).drop("__cut", "__cs", "__cell")
    placed = placed.select("*", F.col("__at.part").alias("__part"), F.col("__at.first").alias("__first")).drop("__at").repartitionById(parts, F.col("__part"))
    order = Window.partitionBy("__part", "__s").orderBy("__h")
    ranked = placed.withColumn("__pos", F.col("__first") + F.row_number().over(order) - 1)
    out = scheduled(ranked, blocks, targets, block).sortWithinPartitions("slot", "place")
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])
