"""Near-duplicate detection by HyperMinHash.

A document's set holds its distinct n-word shingles (ASCII lower-cased words). Its sketch has 256 registers: the top
eight bits of a shingle's hash choose the register, which stores the leading-zero count of the rest and ten mantissa
bits of the smallest hash that falls into it, two bytes in all. Bands of six registers are the search keys; an empty
register borrows, for banding only, the one that a fixed random ranking of registers puts first among the filled ones,
so short texts are found as surely as long ones. At a similarity of 0.8 a pair shares no band with a chance of 3e-6.

How links are found without all pairs of a bucket:
1. Documents with equal sets form a class (a 64-bit key of the set), and only classes go on.
2. Keys that hold one class are dropped by a partial minimum and maximum. In the others every class is paired with the
   bucket's smallest class. The collision-corrected Jaccard estimate of the sketches drops pairs five standard errors
   below the limit; for each class the remaining partner of the highest estimate is verified on full sets.
3. Buckets whose classes are still in different components go through hub rounds: FIRST_HUBS classes of each bucket, half
   of them from its first component, are paired with all of its classes of other components. Rounds go on while each
   halves the classes outside their buckets' first components ("outsiders"), so there are at most log2 of them.
4. One exact pass then pairs the outsiders that are left with classes of other components in their buckets. Before it,
   shingles that a single remaining class holds are counted: a class can share at most its other ones with any
   partner, which rules most classes out by numbers alone.
   In a bucket of at most FEW classes an outsider meets all others; a pair has to pass that bound and the one of
   2048 marks, one for each shingle's place: marks of one class that another lacks are shingles it lacks.
   In a larger bucket prefix filtering decides who meets: a set's shingles are put in order from the rarest among these
   classes, and two sets that reach the limit have their first common shingle so early in both that what follows it
   can still hold the shingles they must share. So only such early shingles are join keys, and only pairs that pass
   this at a common one, and share a bucket, are rows: the pages of one template meet by what few of them share. A class
   has one row for a shingle, with the hashes of its buckets (BANDS at most), not one for each bucket too.
   Hot keys are cut into blocks on both sides, so no key meets in one task.
   Of two classes of one bucket in different components at least one is an outsider, so no candidate is left out.
Full sets are made in a second pass over the texts, only for the classes left in step 2: a bitmap lets their documents pass
(and a few others, which a join removes), so that texts are never shuffled. A hub's sketch or set is sent once for each
block of BLOCK partners and held while they stream by, never repeated in each pair's row.
Components come from repeated minimum-neighbour steps with shortcuts over stored tables.

Shingles and sets are compared by 64-bit hashes. Defined results: a null, empty or word-less text has an empty set and is
linked with nothing; a text of fewer words than a shingle has its whole sequence as its set; repeated rows and ties form
one class; a component is named by its smallest doc_id (null if it has none); rows of one doc_id with different texts are
told apart by their texts; a row with a null doc_id takes part like any other; other columns aren't read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, slices, stored, utf8
from .wordhash import U, mix, owner, shingle_sets, word_bounds, word_hashes

REGISTERS, MANTISSA, BAND_ROWS = 256, 10, 6
BANDS = REGISTERS // BAND_ROWS
#: Hubs of a bucket in a hub round, and the greatest number of rows of a bucket, or partners of a hub, in one block.
FIRST_HUBS, BLOCK = 16, 4096
#: Classes of a bucket that the exact pass compares without prefix filtering: at most so many rows for each.
FEW = 64
#: Places of the bitmaps, by the number of rows they stand for: at least eight each up to 2**MOST_BITS places (32 MB).
LEAST_BITS, MOST_BITS = 20, 28
MARK_BITS = 11
MARKS = (1 << MARK_BITS) // 64
MARK_COLUMNS = [f"m{i}" for i in range(MARKS)]
RANKING = np.random.default_rng(977).permuted(np.tile(np.arange(REGISTERS, dtype=np.int32), (REGISTERS, 1)), axis=1)
FACTORS = np.random.default_rng(978).integers(1, 2**64, (BANDS, BAND_ROWS), dtype=np.uint64) | U(1)
SIGNATURE = "doc_id long, key long, n_shingles long, cls long, sketch binary"


def registers(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Documents x 256 registers (uint16) from sorted shingle hashes; 0 is empty."""
    out = np.zeros((len(first) - 1, REGISTERS), np.uint16)
    place = owner(first) * REGISTERS + (sets >> U(56)).astype(np.int64)
    least = np.ones(len(sets), bool)
    least[1:] = place[1:] != place[:-1]
    rest = sets[least] << U(8)
    _, exponent = np.frexp((rest >> U(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 53)
    bits = (rest << (zeros + 1).astype(U)) >> U(64 - MANTISSA)
    out.reshape(-1)[place[least]] = (zeros.astype(np.int64) << MANTISSA | bits.astype(np.int64)) + 1
    return out


def filled(sketches: np.ndarray) -> np.ndarray:
    """Sketches in which empty registers borrow."""
    out = sketches.copy()
    for d in np.flatnonzero((sketches == 0).any(axis=1) & (sketches != 0).any(axis=1)):
        row = sketches[d]
        full, empty = np.flatnonzero(row), np.flatnonzero(row == 0)
        out[d, empty] = row[full[RANKING[empty][:, full].argmin(axis=1)]]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """Documents x bands, 64-bit keys of the filled registers."""
    used = filled(sketches)[:, : BANDS * BAND_ROWS].reshape(len(sketches), BANDS, BAND_ROWS).astype(U)
    return mix((mix(used + U(0x2545F4914F6CDD1D)) * FACTORS[None]).sum(axis=2, dtype=U)).astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of sketch pairs without the collisions expected of two unrelated sets, and registers in use."""
    union = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    ratio = n / np.maximum(m, 1)
    # Fixed value: the constant of the approximate expected collisions of this sketch.
    chance = 0.169919487159739093975315012348 * 2.0 ** (np.log2(REGISTERS) - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0, same - chance) / np.maximum(union, 1), union


def class_keys(sets: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, from two sums over its shingles."""
    one, two = (np.diff(np.concatenate((np.zeros(1, U), np.cumsum(mix(sets ^ U(seed)), dtype=U)))[to]) for seed in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179))
    return mix(one ^ mix(two + U(0x9B05688C2B3E6C1F))).astype(np.int64)


def _signatures(size: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                x, places = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, _, first = word_bounds(x, places)
                sets, to = shingle_sets(word_hashes(x, starts, lower=True), first, size)
                rows = registers(sets, to)
                own = [batch.column(c)[a:b] for c in ("doc_id", "key")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(np.diff(to).astype(np.int64)), pa.array(class_keys(sets, to)), pa.array([r.tobytes() for r in rows], pa.binary())],
                    ["doc_id", "key", "n_shingles", "cls", "sketch"],
                )

    return run


class Places:
    """A bitmap of row keys, as an expression for a key's place and a broadcast of the places that are set."""

    def __init__(self, keys: DataFrame, column: str) -> None:
        n = keys.count()
        self.bits = max(LEAST_BITS, min(MOST_BITS, int(n * 8).bit_length()))
        place = self.place(F.col(column))
        words = keys.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("v"))
        found = words.groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()  # 2**(MOST_BITS - 6) rows at most
        out = np.zeros(1 << (self.bits - 6), np.int64)
        out[found["w"].to_numpy()] = found["v"].to_numpy()
        self.shared = keys.sparkSession.sparkContext.broadcast(out.view(U))

    def place(self, key):
        return F.pmod(F.xxhash64(key), F.lit(1 << self.bits))

    def flagged(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with whether a row's key may be one of the bitmap's; only the key's place goes to Python."""
        shared = self.shared
        hit = F.pandas_udf(lambda place: pd.Series(seen(shared.value, place.to_numpy(np.int64))), "boolean")
        return df.withColumn(name, hit(self.place(F.col(key))))


def seen(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[place >> 6] >> (place & 63).astype(U)) & U(1) == 1


def _flag(shared):
    def run(batches):
        for batch in batches:
            hit = seen(shared.value, batch.column("__place").to_numpy(zero_copy_only=False))
            yield batch.set_column(batch.schema.get_field_index("__place"), "__place", pa.array(hit.astype(np.int64)))

    return run


def row_key(id_column: str = "doc_id"):
    """A row's identity: equal for rows of the same doc_id and text."""
    return F.xxhash64(F.col(id_column).cast("long"), F.coalesce(F.col("text"), F.lit("")))


def _sets(size: int, shared):
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(seen(shared.value, batch.column("place").to_numpy(zero_copy_only=False))))
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                x, places = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, _, first = word_bounds(x, places)
                sets, to = shingle_sets(word_hashes(x, starts, lower=True), first, size)
                bits = np.zeros((b - a, MARKS * 64), np.uint8)
                bits[owner(to), (sets >> U(64 - MARK_BITS)).astype(np.int64)] = 1
                marks = np.packbits(bits, axis=1).view(np.int64)
                items = pa.array([sets[i:j].tobytes() for i, j in zip(to[:-1], to[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(class_keys(sets, to)), pa.array(np.diff(to).astype(np.int64)), items, *(pa.array(marks[:, i].copy()) for i in range(MARKS))],
                    ["cls", "n", "items", *MARK_COLUMNS],
                )

    return run


def _bands(batches):
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.slice(at, 2000)
            sketches = np.array([np.frombuffer(x.as_buffer(), np.uint16) for x in part.column("sketch")]).reshape(len(part), REGISTERS)
            keys = band_keys(sketches)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part.column("cls").to_numpy(zero_copy_only=False), BANDS))], ["band", "cls"])


def _shingles(batches):
    for batch in batches:
        for at in range(0, len(batch), 100):
            part = batch.slice(at, 100)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("items")]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("cls").to_numpy(zero_copy_only=False), [len(x) for x in sets])), pa.array(np.concatenate(sets))], ["cls", "shingle"])


def _beside(judge: Callable):
    """Rows (a, n, b, payload) sorted so that a hub's own row (b null) comes before its partners: judged beside the hub held."""

    def run(batches):
        hub = None
        for batch in batches:
            own = batch.column("b").is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *np.flatnonzero(own).tolist(), len(batch)]
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(at, to - at)
                if len(part) and own[at]:
                    hub = (part.column("n")[0].as_py(), part.column("payload")[0].as_py())
                    part = part.slice(1)
                if len(part):
                    ok, about = judge(*hub, part.column("n").to_numpy(zero_copy_only=False), part.column("payload"))
                    yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(about)], ["a", "b", "about"]).filter(pa.array(ok))

    return run


def _likely(percent: int):
    limit = percent / 100

    def judge(n, sketch, m, sketches):
        b = np.array([np.frombuffer(x.as_buffer(), np.uint16) for x in sketches])
        a, m = np.broadcast_to(np.frombuffer(sketch, np.uint16), b.shape), m.astype(np.float64)
        found, used = estimate(a, b, np.full(len(b), float(n)), m)
        return (found >= limit - 5 * np.sqrt(limit * (1 - limit) / np.maximum(used, 1))) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)), found

    return judge


def _verify(percent: int):
    def judge(n, items, m, payloads):
        hub, shared = np.frombuffer(items, U), np.zeros(len(m), np.int64)
        for k, x in enumerate(payloads):
            x = np.frombuffer(x.as_buffer(), U)
            at = np.searchsorted(hub, x)
            shared[k] = int((hub[np.minimum(at, len(hub) - 1)] == x).sum())
        union = n + m - shared
        return (shared > 0) & (100 * shared >= percent * union), shared / np.maximum(union, 1)

    return judge


def components(links: DataFrame) -> DataFrame:
    """(cls, comp): the smallest node reachable, for every node of links (a, b)."""
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "cls"), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("cls")).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, F.col("cls") == F.col("a"), "left").select("cls", "comp", F.least("comp", "near").alias("now"))
        up = labels.select(F.col("cls").alias("up"), F.col("comp").alias("over"))
        now = F.least("now", "over")
        step = stored(step.join(up, F.col("now") == F.col("up"), "left").select("cls", now.alias("comp"), (now < F.col("comp")).alias("moved")), "labels")
        labels = step.select("cls", "comp")
        if not step.where("moved").head(1):
            return labels


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links, from those before: the links between components are joined up first."""
    label = comps.select(F.col("cls").alias("c"), "comp")
    ends = links.join(label, F.col("a") == F.col("c"), "left").select(F.coalesce("comp", "a").alias("a"), "b")
    ends = ends.join(label, F.col("b") == F.col("c"), "left").select("a", F.coalesce("comp", "b").alias("b")).where("a <> b").distinct()
    joined = components(ends).select(F.col("cls").alias("old"), F.col("comp").alias("new"))
    nodes = comps.union(joined.select("old", "old")).groupBy("cls").agg(F.min("comp").alias("comp"))
    return stored(nodes.join(joined, F.col("comp") == F.col("old"), "left").select("cls", F.coalesce("new", "comp").alias("comp")), "components")


class Search:
    """Stored tables of one run."""

    def __init__(self, docs: DataFrame, words: int, percent: int) -> None:
        bounded_batches(docs.sparkSession)
        self.percent = percent
        read = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), "text")
        self.signatures = stored(read.mapInArrow(_signatures(words), SIGNATURE), "signatures")
        some = self.signatures.where("n_shingles > 0")
        self.classes = stored(some.groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.min("key").alias("key"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
        bands = self.classes.select("cls", "sketch").mapInArrow(_bands, "band long, cls long")
        shared = bands.groupBy("band").agg(F.min("cls").alias("hub"), F.max("cls").alias("top")).where("hub < top")
        shared = stored(shared.select(F.col("band").alias("shared_band"), "hub"), "buckets")
        self.members = stored(bands.join(shared, F.col("band") == F.col("shared_band")).select("band", "cls", "hub"), "members")
        searched = self.members.select(F.col("cls").alias("c")).distinct()
        self.sketches = stored(self.classes.select("cls", "key", "n", F.col("sketch").alias("payload")).join(searched, F.col("cls") == F.col("c"), "left_semi"), "sketches")
        places = Places(self.sketches, "key")
        placed = read.select("text", places.place(F.col("key")).alias("place"))
        found = placed.mapInArrow(_sets(words, places.shared), "cls long, n long, items binary, " + ", ".join(f"{c} long" for c in MARK_COLUMNS))
        wanted = self.sketches.select(F.col("cls").alias("c"))
        self.sets = stored(found.join(wanted, F.col("cls") == F.col("c"), "left_semi").dropDuplicates(["cls"]), "sets")

    def beside(self, pairs: DataFrame, table: DataFrame, judge: Callable) -> DataFrame:
        """(a, b, about) of the pairs that ``judge`` lets pass. table: cls, n, payload; a is the side with many partners."""
        blocks = pairs.groupBy(F.col("a").alias("hub")).agg((F.floor(F.count("*") / BLOCK) + 1).alias("blocks"))
        blocks = stored(blocks, "hubs")
        hubs = table.join(blocks, F.col("cls") == F.col("hub"))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
        hubs = hubs.select(F.col("hub").alias("a"), each, F.lit(None).cast("long").alias("b"), "n", "payload")
        placed = pairs.join(blocks, F.col("a") == F.col("hub")).select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), "b")
        partners = placed.join(table, F.col("b") == F.col("cls")).select("a", "block", "b", "n", "payload")
        rows = hubs.union(partners).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
        return rows.select("a", "b", "n", "payload").mapInArrow(_beside(judge), "a long, b long, about double")

    def likely(self, pairs: DataFrame) -> DataFrame:
        return self.beside(pairs, self.sketches.select("cls", "n", "payload"), _likely(self.percent))

    def verified(self, pairs: DataFrame) -> DataFrame:
        return self.beside(pairs, self.sets.select("cls", "n", F.col("items").alias("payload")), _verify(self.percent)).select("a", "b")

    def mixed(self, members: DataFrame, comps: DataFrame) -> DataFrame:
        """Members of the buckets that hold two components, with their component and whether it's the bucket's first one."""
        label = comps.select(F.col("cls").alias("c"), "comp")
        tagged = members.select("band", "cls").join(label, F.col("cls") == F.col("c"), "left").select("band", "cls", F.coalesce("comp", "cls").alias("comp"))
        return stored(self.still_mixed(tagged), "alive")

    def still_mixed(self, tagged: DataFrame) -> DataFrame:
        two = tagged.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select(F.col("band").alias("mixed_band"), "low")
        return tagged.join(two, F.col("band") == F.col("mixed_band")).withColumn("main", F.col("comp") == F.col("low")).drop("mixed_band", "low")

    def enough(self, most, n, m):
        """Whether sets of n and m shingles that share at most ``most`` may reach the limit."""
        return (100 + self.percent) * most >= self.percent * (n + m)

    def marks(self, prefix: str) -> DataFrame:
        return self.sets.select(F.col("cls").alias(f"{prefix}cls"), F.col("n").alias(f"{prefix}n"), *[F.col(c).alias(f"{prefix}{c}") for c in MARK_COLUMNS])

    def most_shared(self, x: str, y: str):
        """The greatest number of shingles that the sets of prefixes x and y can share, by their marks."""
        lacks = lambda a, b: reduce(add, (F.bit_count(F.col(f"{a}{c}").bitwiseAND(F.bitwise_not(f"{b}{c}"))) for c in MARK_COLUMNS))
        return F.least(F.col(f"{x}n") - lacks(x, y), F.col(f"{y}n") - lacks(y, x))

    def hub_pairs(self, alive: DataFrame, turn: int) -> DataFrame:
        """(a, b): FIRST_HUBS classes of each bucket with those of other components that they may be linked with."""
        outer = (F.col("main") == (F.col("salt") % 2 == 0)).alias("outer")
        salted = alive.withColumn("salt", F.pmod(F.xxhash64("cls", F.lit(turn)), F.lit(FIRST_HUBS)))
        chosen = salted.groupBy("band", "salt").agg(F.min(F.struct(outer, "cls", "comp")).alias("h"))
        hubs = stored(chosen.select(F.col("band").alias("x_band"), F.col("h.cls").alias("x"), F.col("h.comp").alias("x_comp")), "hubs")
        hubs = hubs.join(self.marks("x_"), F.col("x") == F.col("x_cls"))
        others = alive.select("band", "cls", "comp").join(self.marks("y_"), F.col("cls") == F.col("y_cls"))
        near = (F.col("band") == F.col("x_band")) & (F.col("comp") != F.col("x_comp")) & self.enough(self.most_shared("x_", "y_"), F.col("x_n"), F.col("y_n"))
        return others.join(hubs, near).select(F.col("x").alias("a"), F.col("cls").alias("b")).distinct()

    def reachable(self, alive: DataFrame) -> DataFrame:
        """alive with n and most (shingles that some other class of alive has too), without the classes that these rule out."""
        held = self.sets.select("cls", "n", "items").join(alive.select(F.col("cls").alias("c")).distinct(), F.col("cls") == F.col("c"), "left_semi")
        held = stored(held, "held")
        single = held.select("cls", "items").mapInArrow(_shingles, "cls long, shingle long").groupBy("shingle").agg(F.count("*").alias("k"), F.min("cls").alias("only")).where("k = 1")
        single = single.groupBy("only").agg(F.count("*").alias("single"))
        sizes = held.select(F.col("cls").alias("c"), "n").join(single, F.col("c") == F.col("only"), "left")
        sizes = stored(sizes.select("c", "n", (F.col("n") - F.coalesce("single", F.lit(0))).alias("most")).where(100 * F.col("most") >= self.percent * F.col("n")), "sizes")
        rows = self.still_mixed(alive.join(sizes, F.col("cls") == F.col("c")).drop("c", "main"))
        outside = ~F.col("main")
        ends = rows.groupBy("band").agg(
            F.min("n").alias("least"), F.max("most").alias("widest"), F.min(F.when(outside, F.col("n"))).alias("out_least"), F.max(F.when(outside, F.col("most"))).alias("out_widest")
        )
        rows = rows.join(ends.withColumnRenamed("band", "ends_band"), F.col("band") == F.col("ends_band"))
        main_ok = self.enough(F.least("most", "out_widest"), F.col("n"), F.col("out_least"))
        out_ok = self.enough(F.least("most", "widest"), F.col("n"), F.col("least"))
        rows = rows.where(F.when(F.col("main"), main_ok).otherwise(out_ok)).select("band", "cls", "comp", "n", "most")
        return stored(self.still_mixed(rows), "reachable")

    def meeting(self, rows: DataFrame, key: list[str], near) -> DataFrame:
        """(a, b): outsiders x of rows with the rows of other components that have the same key and pass ``near``.

        rows: key, cls, comp, main and what ``near`` reads, which finds it under an x_ for the outsider.
        """
        named = [F.col(c).alias(f"s_{c}") for c in key]
        size = rows.groupBy(*key).agg((F.floor(F.count("*") / BLOCK) + 1).alias("rows"), (F.floor(F.count_if(~F.col("main")) / BLOCK) + 1).alias("cols"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        size = stored(size.where("low < high").select(*named, "rows", "cols"), "sized")
        cut = rows.join(size, reduce(and_, (F.col(c) == F.col(f"s_{c}") for c in key))).drop(*[f"s_{c}" for c in key])
        block = lambda of: F.pmod(F.xxhash64("cls", F.lit("block")), F.col(of))
        every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
        outs = cut.where("not main").select("*", block("cols").alias("col"), every("rows").alias("row")).drop("rows", "cols", "main")
        outs = outs.select(*[F.col(c).alias(f"x_{c}") for c in outs.columns])
        rest = cut.select("*", block("rows").alias("row"), every("cols").alias("col")).drop("rows", "cols")
        meet = reduce(and_, (F.col(c) == F.col(f"x_{c}") for c in [*key, "row", "col"]))
        once = (F.col("comp") != F.col("x_comp")) & (F.col("main") | (F.col("x_cls") < F.col("cls")))
        return rest.join(outs, meet & once & near).select(F.col("x_cls").alias("a"), F.col("cls").alias("b")).distinct()

    def prefixes(self, classes: DataFrame) -> DataFrame:
        """classes (c, n, further columns) with shingle and left, a row for each shingle from which a pair may begin to share, rarest first; left counts it and those after it.

        Shingles that one class alone holds stand before all others; they take places and aren't rows.
        """
        held = self.sets.select("cls", "items").join(classes.select("c"), F.col("cls") == F.col("c"), "left_semi")
        each = stored(held.mapInArrow(_shingles, "cls long, shingle long"), "shingles")
        often = each.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1").select(F.col("shingle").alias("often"), "k")
        placed = each.join(often, F.col("shingle") == F.col("often")).withColumn("left", F.row_number().over(Window.partitionBy("cls").orderBy(F.col("k").desc(), F.col("shingle").desc())).cast("long"))
        early = placed.join(classes, F.col("cls") == F.col("c")).where(100 * F.col("left") >= self.percent * F.col("n"))
        return stored(early.drop("often", "k", "c"), "prefixes")

    def outsider_pairs(self, alive: DataFrame) -> DataFrame:
        """(a, b): every outsider with each class of another component in its buckets that it may be linked with."""
        wide = stored(alive.groupBy("band").agg(F.count("*").alias("of")).where(F.col("of") > FEW).select(F.col("band").alias("wide")), "wide")
        narrow = alive.join(wide, F.col("band") == F.col("wide"), "left_anti").drop("n")
        marked = narrow.join(self.marks("").withColumnRenamed("cls", "marked"), F.col("cls") == F.col("marked")).drop("marked")
        found = self.meeting(marked, ["band"], self.enough(F.least("most", "x_most", self.most_shared("x_", "")), F.col("x_n"), F.col("n")))
        if not wide.head(1):
            return found
        rows = alive.join(wide, F.col("band") == F.col("wide"), "left_semi")
        alike = [F.min(c).alias(c) for c in ("comp", "n", "most")]
        classes = rows.groupBy(F.col("cls").alias("c")).agg(*alike, F.bool_and("main").alias("main"), F.collect_set(F.hash("band")).alias("bands"))
        near = self.enough(F.least("most", "x_most", "left", "x_left"), F.col("x_n"), F.col("n")) & F.arrays_overlap("bands", "x_bands")
        return found.union(self.meeting(self.prefixes(stored(classes, "wide-classes")), ["shingle"], near)).distinct()

    def linked(self, pairs: DataFrame) -> DataFrame:
        likely = stored(self.likely(stored(pairs, "pairs")), "likely")
        return stored(self.verified(likely.select("a", "b")), "links")

    def run(self) -> DataFrame:
        """(cls, comp) of all classes that have a link."""
        first = stored(self.members.where("cls > hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct(), "first")
        best = stored(self.likely(first).groupBy("b").agg(F.max(F.struct("about", "a")).alias("best")).select("best.a", "b"), "candidates")
        comps, before, turn = components(stored(self.verified(best), "links")), None, 0
        alive = self.mixed(self.members, comps)
        while True:
            outside = alive.where("not main").select("cls").distinct().count()
            if not outside:
                return comps
            if before is not None and 2 * outside > before:
                break
            before, turn = outside, turn + 1
            found = self.linked(self.hub_pairs(alive, turn))
            if not found.head(1):
                break
            comps = merged(comps, found)
            alive = self.mixed(alive, comps)
        found = self.linked(self.outsider_pairs(self.reachable(alive)))
        return merged(comps, found) if found.head(1) else comps


def labelled(search: Search) -> DataFrame:
    """(c, group, least_id) of every class with shingles: its component's key and smallest doc_id."""
    comps = search.run().select(F.col("cls").alias("linked"), "comp")
    known = search.classes.select("cls", "least_id").join(comps, F.col("cls") == F.col("linked"), "left")
    known = stored(known.select(F.col("cls").alias("c"), F.coalesce("comp", "cls").alias("group"), "least_id"), "class-components")
    least = known.groupBy(F.col("group").alias("g")).agg(F.min("least_id").alias("component_id"))
    return known.drop("least_id").join(least, F.col("group") == F.col("g")).drop("g")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; kept marks the smallest doc_id of a component."""
    search = Search(docs, words, percent)
    known = stored(labelled(search), "labels")
    rows = search.signatures.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cls")).alias("cls"))
    full = rows.join(known, F.col("cls") == F.col("c"), "left")
    found = full.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component (that of its smallest doc_id, null last), all columns as they were.

    Rows equal in doc_id and text stay once; rows without words all stay. Only rows that may go meet a shuffle.
    """
    search = Search(docs, words, percent)
    known = labelled(search).select("c", "group")
    rows = search.signatures.where("n_shingles > 0").groupBy("key", "cls").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    rows = stored(rows.join(known, F.col("cls") == F.col("c")).select("key", "group", "doc_id", "n"), "rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    stays = rows.groupBy(F.col("group").alias("g")).agg(F.min_by("key", order).alias("stay"), F.count("*").alias("of"))
    judged = rows.join(stays.where("of > 1"), F.col("group") == F.col("g"), "left").select(F.col("key").alias("__k"), F.coalesce(F.col("key") != F.col("stay"), F.lit(False)).alias("__gone"), (F.col("n") > 1).alias("__again"))
    judged = stored(judged.where("__gone or __again"), "judged")
    places = Places(judged, "__k")
    placed = docs.withColumn("__key", row_key()).withColumn("__place", places.place(F.col("__key")))
    flagged = placed.mapInArrow(_flag(places.shared), placed.schema)
    maybe = flagged.where("__place = 1").join(judged, F.col("__key") == F.col("__k"), "left")
    single = maybe.where("__k is null").drop(*judged.columns)
    twice = maybe.where("__again and not __gone").drop(*judged.columns).dropDuplicates(["__key"])
    return flagged.where("__place = 0").union(single).union(twice).drop("__place", "__key")
