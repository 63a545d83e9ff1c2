"""Benchmark decontamination by template canonicalisation.

Words lose case and all bytes but letters and digits; numbers, names (capitalised words inside a sentence) and units
after a number become typed placeholders. Windows of WINDOW template words are joined by hash with the windows of the
benchmark items (an item of fewer words is one window of all of them). Joined windows are put together on diagonals
(item, document place minus item place). A window whose slot values all equal the item's always counts. The changed
windows count where each slot value of the item stands for one value in the document and the other way round over all
of them; where they break this, only the equal ones count. Windows are added up on each diagonal, and over every
stretch of NEAR + 1 diagonals (words put in or left out move the rest of a passage to another diagonal); a window of the
item counts once. A document is contaminated when one diagonal or stretch has at least MATCHED windows, or all windows
of a shorter item.

A changed window counts only with LITERAL words that aren't slots, so a row of numbers or names matches by its values
alone. Items of fewer than WINDOW words match only with equal values, and those of fewer than SHORTEST words only a
document that holds nothing else. Each window with names is looked for in a second form too, in which names are plain
lower-case words, so that other case or punctuation doesn't hide a copy; numbers may still differ there, names may not.

A bitmap of fixed size (2**FILTER_BITS places set by the benchmark's window hashes) is broadcast so that only windows
that may match become rows; it has no false negatives, and with a large benchmark only lets more rows into the join.

Windows that differ in one slot of one name only are found as re-parameterised; text that differs in other words is not.
Defined results: a null or empty text or one without words is clean, as is everything against an empty benchmark; null
or word-less items match nothing; repeated items and rows repeat their results; a null doc_id is judged by its own text
(rows are keyed by doc_id and text digest); columns of other names aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, utf8
from .wordhash import LOWERED, SPACE, U, mix, ngrams, owner, runs, word_bounds

WINDOW, MATCHED, NEAR, LITERAL, SHORTEST, FILTER_BITS = 8, 6, 4, 3, 4, 24
# Units that follow a number.
UNITS = "km m cm mm mi ft in kg g mg lb oz l ml s sec min h hr hour hours minute minutes second seconds day days week weeks month months year years dollars euros usd eur percent mph kmh mile miles meters metres kilometers kilometres grams kilograms pounds liters litres degrees".split()
DIGIT, UPPER, KEEP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
DIGIT[48:58] = True
UPPER[65:91] = True
KEEP[48:58] = KEEP[65:91] = KEEP[97:123] = True
KEEP[128:] = True
FINAL = np.zeros(256, bool)
FINAL[[ord(c) for c in ".!?:;\"|"]] = True
NUMBER, NAME, UNIT = (U(x) for x in (0x11B7, 0x22C9, 0x33D1))
CLOSING = np.zeros(256, bool)
CLOSING[[ord(c) for c in "\"')]}"]] = True


def _unit_hashes() -> np.ndarray:
    data, offsets = utf8(pa.array(UNITS))
    return np.sort(runs(data, offsets[:-1], LOWERED, KEEP[data]))


UNIT_HASHES = _unit_hashes()


def canonical(data: np.ndarray, offsets: np.ndarray, inner: bool = False) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Template hash of each word and its own hash where it is a slot (else 0), the same without names, and each document's first word.

    Words without a letter or digit are left out. inner: a text's first word is read as inside a sentence, as it is
    where the text was put after other words.
    """
    starts, ends, first = word_bounds(data, offsets)
    if not len(starts):
        return (np.zeros(0, U), np.zeros(0, U)), (np.zeros(0, U), np.zeros(0, U)), first
    kept = np.concatenate(([0], np.cumsum(KEEP[data])))
    solid = kept[ends] > kept[starts]
    doc = owner(first)
    surface = runs(data, starts, LOWERED, KEEP[data])
    digits = np.concatenate(([0], np.cumsum(DIGIT[data])))
    number = (digits[ends] - digits[starts]) * 2 >= np.maximum(1, kept[ends] - kept[starts])
    number &= digits[ends] > digits[starts]
    head = np.minimum(starts + CLOSING[data[starts]], ends - 1)
    # capital: ASCII A-Z, or a two-byte letter from U+00C0 to U+00DE
    nxt = data[np.minimum(head + 1, len(data) - 1)]
    capital = UPPER[data[head]] | ((data[head] == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E))
    last = data[np.maximum(ends - 1, 0)]
    opens = np.ones(len(starts), bool)  # first of a document, of a line, or after a sentence's end
    opens[1:] = FINAL[last[:-1]]
    opens[np.flatnonzero(np.diff(doc, prepend=-1))] = not inner
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    opens[1:] |= (lines[starts[1:]] > lines[starts[:-1]]) & (doc[1:] == doc[:-1])
    name = capital & ~opens & ~number
    after = np.zeros(len(starts), bool)
    after[1:] = number[:-1] & (doc[1:] == doc[:-1])
    unit = after & np.isin(surface, UNIT_HASHES) & ~name & ~number
    template = np.where(number, mix(np.full(1, NUMBER))[0], np.where(name, mix(np.full(1, NAME))[0], np.where(unit, mix(np.full(1, UNIT))[0], surface)))
    slot = np.where(number | name | unit, surface, U(0))
    count = np.concatenate(([0], np.cumsum(solid)))[first]
    # the form without names: the same for any case and punctuation
    plain_unit = after & np.isin(surface, UNIT_HASHES) & ~number
    plain = np.where(number, mix(np.full(1, NUMBER))[0], np.where(plain_unit, mix(np.full(1, UNIT))[0], surface))
    plain_slot = np.where(number | plain_unit, surface, U(0))
    return (template[solid], slot[solid]), (plain[solid], plain_slot[solid]), count


def windows(template: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, place and length in words of each window; a document of fewer than WINDOW words has one."""
    counts = np.diff(first)
    doc = owner(first)
    place = np.arange(len(template)) - first[:-1][doc] if len(template) else np.zeros(0, np.int64)
    full = np.flatnonzero(place + WINDOW <= counts[doc]) if len(template) else np.zeros(0, np.int64)
    rolled = ngrams(template, WINDOW)[full] if len(full) else np.zeros(0, U)
    short = np.flatnonzero((counts > 0) & (counts < WINDOW))
    extra = np.array([mix(ngrams(template[first[d] : first[d + 1]], int(counts[d])) + U(int(counts[d])))[0] for d in short], U)
    return np.concatenate((rolled, extra)), np.concatenate((doc[full], short)), np.concatenate((place[full], np.zeros(len(short), np.int64))), np.concatenate((np.full(len(full), WINDOW), counts[short]))


def shorter(template: np.ndarray, first: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of the given lengths below WINDOW, for items that have fewer words."""
    doc, out = owner(first), []
    counts = np.diff(first)
    place = np.arange(len(template)) - first[:-1][doc] if len(template) else np.zeros(0, np.int64)
    for n in lengths:
        full = np.flatnonzero(place + n <= counts[doc]) if len(template) >= n else np.zeros(0, np.int64)
        if len(full):
            out.append((mix(ngrams(template, n)[full] + U(n)), doc[full], place[full], np.full(len(full), n)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _emit(ids, hashes, doc, place, length, slot, first):
    spans = [slot[first[d] + p : first[d] + p + n] for d, p, n in zip(doc.tolist(), place.tolist(), length.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [*(c.take(pa.array(doc)) for c in ids.values()), pa.array(hashes.astype(np.int64)), pa.array(place.astype(np.int64)), pa.array([[int(v) for v in s.astype(np.int64)] for s in spans], pa.list_(pa.int64()))],
        [*ids, "h", "place", "slots"],
    )


def _differ(plain: np.ndarray, template: np.ndarray, first: np.ndarray, doc: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each window's two forms differ."""
    other = np.concatenate(([0], np.cumsum(plain != template)))
    at = first[doc] + place
    return other[at + length] > other[at]


def _items(batches):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for inner in (False, True):
            (template, slot), (plain, plain_slot), first = canonical(data, offsets, inner)
            found = windows(template, first)
            hashes, doc, place, length = (x[found[2] == 0] for x in found) if inner else found
            yield _emit({"item_id": batch.column("item_id")}, hashes, doc, place, length, slot, first)
            if not inner:
                hashes, doc, place, length = windows(plain, first)
                new = _differ(plain, template, first, doc, place, length)
                yield _emit({"item_id": batch.column("item_id")}, hashes[new], doc[new], place[new], length[new], plain_slot, first)


def _documents(shared):
    def run(batches):
        bitmap, lengths = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                (template, slot), (plain, plain_slot), first = canonical(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for form, values in ((template, slot), (plain, plain_slot)):
                    parts = [x[:4] for x in (windows(form, first), shorter(form, first, lengths))]
                    hashes, doc, place, length = (np.concatenate(x) for x in zip(*parts, strict=True))
                    at = hashes >> U(64 - FILTER_BITS)
                    maybe = (bitmap[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1
                    if form is plain:
                        maybe &= _differ(plain, template, first, doc, place, length)
                    maybe = np.flatnonzero(maybe)
                    yield _emit({c: batch.column(c)[a:b] for c in ("doc_id", "key")}, hashes[maybe], doc[maybe], place[maybe], length[maybe], values, first)

    return run


WINDOWS = "h long, place long, slots array<long>"


def _worded(slots: str):
    """Whether a window has the literal words that it needs to match with other values in its slots."""
    return (F.size(F.filter(slots, lambda x: x != 0)) <= WINDOW - LITERAL) & (F.size(slots) == WINDOW)


def met(found: DataFrame, items: DataFrame) -> tuple[DataFrame, Column]:
    """Windows of documents with the item windows they may match, and which of those may differ in their slots.

    Windows of few literal words match by equal values alone, so they meet by their values too: the windows of number
    tables, which all have one template, don't meet in one key.
    """
    key = lambda slots: F.when(_worded(slots), F.lit(0)).otherwise(F.xxhash64(slots))
    item = items.select("item_id", F.col("h").alias("ih"), F.col("place").alias("at"), F.col("slots").alias("given"), key("slots").alias("iv"))
    hits = found.withColumn("v", key("slots")).join(item, (F.col("h") == F.col("ih")) & (F.col("v") == F.col("iv"))).where(F.size("slots") == F.size("given"))
    hits = hits.select("doc_id", "key", "item_id", (F.col("place") - F.col("at")).alias("diagonal"), "at", (F.col("slots") == F.col("given")).alias("exact"), F.size("given").alias("n"), F.filter(F.arrays_zip("given", "slots"), lambda p: p["given"] != 0).alias("pairs"))
    return hits, (F.size("pairs") <= WINDOW - LITERAL) & (F.col("n") == WINDOW)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, diagonal, windows, of) of each diagonal, or stretch of diagonals, that contaminates."""
    spark = docs.sparkSession
    items = stored(benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("item_id").isNotNull()).mapInArrow(_items, f"item_id long, {WINDOWS}").distinct(), "items")
    places = items.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("p")).distinct().toPandas()["p"].to_numpy()  # 2**FILTER_BITS at most
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    np.bitwise_or.at(bitmap, places >> 3, (1 << (places & 7)).astype(np.uint8))
    lengths = sorted(r[0] for r in items.select(F.size("slots").alias("n")).where(f"n >= {SHORTEST} and n < {WINDOW}").distinct().collect())  # below WINDOW of them
    shared = spark.sparkContext.broadcast((bitmap, lengths))
    sizes = items.groupBy(F.col("item_id").alias("sized")).agg(F.count_distinct("place").alias("of"))
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long"), F.md5(text).alias("key"), text.alias("text")).mapInArrow(_documents(shared), f"doc_id long, key string, {WINDOWS}").distinct()
    hits, worded = met(found, items)
    hits = stored(hits.where(F.col("exact") | worded).drop("n"), "hits")
    span = ["doc_id", "key", "item_id", "diagonal", "wide"]
    counted = _spans(hits.select("doc_id", "key", "item_id", "diagonal", "at", "exact")).groupBy(*span, "at").agg(F.max("exact").alias("exact"))
    counted = counted.groupBy(*span).agg(F.count("*").alias("every"), F.count_if("exact").alias("verbatim"))
    counted = counted.join(sizes, F.col("item_id") == F.col("sized")).drop("sized").withColumn("least", F.least(F.lit(MATCHED), F.col("of")))
    counted = stored(counted.where("every >= least"), "counted")
    pairs = hits.where("not exact").select("doc_id", "key", "item_id", "diagonal", F.explode("pairs").alias("p")).select("doc_id", "key", "item_id", "diagonal", "p.given", "p.slots").distinct()
    pairs = _spans(pairs).distinct()
    broken = pairs.groupBy(*span).agg(F.count("*").alias("n"), F.count_distinct("given").alias("g"), F.count_distinct("slots").alias("s")).where("n <> g or n <> s")
    broken = broken.select(*[F.col(c).alias(f"x_{c}") for c in span])
    same = F.lit(True)
    for c in span:
        same = same & F.col(c).eqNullSafe(F.col(f"x_{c}"))
    judged = counted.join(broken, same, "left").withColumn("windows", F.when(F.col("x_item_id").isNull(), F.col("every")).otherwise(F.col("verbatim")))
    return judged.where("windows >= least").select("doc_id", "key", "item_id", "diagonal", "windows", "of")


def _spans(rows: DataFrame) -> DataFrame:
    """rows once for their own diagonal, and once for each stretch of NEAR + 1 diagonals that theirs lies in (wide, named by its first)."""
    copies = [F.struct(F.col("diagonal").alias("d"), F.lit(False).alias("w"))] + [F.struct((F.col("diagonal") - i).alias("d"), F.lit(True).alias("w")) for i in range(NEAR + 1)]
    out = rows.withColumn("span", F.explode(F.array(*copies)))
    return out.withColumn("diagonal", F.col("span.d")).withColumn("wide", F.col("span.w")).drop("span")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, n_items, item_id, matched_windows): one row per contaminated document, with its first best item."""
    return matches(docs, benchmark).groupBy("doc_id", "key").agg(F.count_distinct("item_id").alias("n_items"), F.max(F.struct("windows", (-F.col("item_id")).alias("i"))).alias("best")).select("doc_id", "key", "n_items", (-F.col("best.i")).alias("item_id"), F.col("best.windows").alias("matched_windows"))


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document: doc_id, contaminated, n_items, item_id (null if clean), matched_windows."""
    bad = stored(contaminated(docs, benchmark), "contaminated").select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "n_items", "item_id", "matched_windows")
    keyed = docs.select(F.col("doc_id").cast("long"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    out = keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return out.select("doc_id", F.col("d").isNotNull().__or__(F.col("k").isNotNull()).alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.coalesce("matched_windows", F.lit(0)).alias("matched_windows"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones, all columns as they were."""
    bad = stored(contaminated(docs, benchmark), "contaminated").select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"))
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__d")) & (key == F.col("__k")), "left_anti")
