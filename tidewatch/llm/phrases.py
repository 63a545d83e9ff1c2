"""Phrase collocations from sorted count streams.

Counting goes by length: a phrase that stands often enough is made of parts that stand as often, so phrases of k words are
counted only where both phrases of k-1 words inside are frequent. A bitmap of fixed size (2**MOST_BITS places at most) of
the frequent ones' hashes tells; it has no false negatives, and what it lets through too much the exact count drops.
Counts are made of the words themselves; hashes only choose and pre-aggregate within a slice of texts.

The frequent phrases of all lengths make one stream in prefix order (words from the left) and one in suffix order (words
from the right), each range-partitioned and sorted. In prefix order a phrase stands behind its own prefixes, so one pass
with a stack of open prefixes gives each phrase the counts of its first 1, 2, .. words and each prefix the largest count
of its extensions to the right; the suffix stream gives the counts of the last words and the extensions to the left. A
range that begins inside the extensions of a phrase is given that phrase's row (a few rows a range), so a first word with
any share of all phrases is spread over ranges. Both results are put in prefix order and merged in lockstep; no hash table
and no hash join takes part.

An extension by several words that holds 80 % of a phrase's count has an extension by one word that does, so looking at
those by one word is enough.

Defined results: null and empty texts have no words, a null lang is 'und'; repeated rows count as often as they stand;
ties are ordered by phrase; extra columns aren't read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, slices, stored, utf8
from .wordhash import U, VALUES, mix, ngrams, owner, runs

# Characters that end a piece, and those that part words inside one.
CUTS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
LEAST, LONGEST, SHARE, TOP = 30, 4, 80, 2000
LEAST_BITS, MOST_BITS = 20, 28
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(CUTS)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_VALUES = np.where(KIND == 0, VALUES, U(0))
COUNTED = "lang string, phrase string, n long"
COUNTED_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def language_hash(lang: str) -> np.uint64:
    return U(int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little"))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of lower-cased bytes, the number of its piece, and its document."""
    kind = KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = kind == 0
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    piece = np.cumsum((kind == 2) | edge[:-1])[starts]
    return starts, ends, piece, owner(np.searchsorted(starts, offsets))


def _counter(size: int, shared, bits: int):
    """Phrases of ``size`` words and their counts in each slice of texts; of one word, also the number of words (null phrase)."""

    def run(batches):
        known: dict[str, np.uint64] = {}
        for batch in batches:
            langs = [x if x is not None else "und" for x in batch.column("lang").to_pylist()]
            for x in set(langs) - set(known):
                known[x] = language_hash(x)
            salts = np.array([known[x] for x in langs], U)
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets, 1 << 22):
                yield from counted(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], langs[a:b], salts[a:b])

    def counted(data, offsets, langs, salts):
        data = LOWER[data]
        starts, ends, piece, doc = words_of(data, offsets)
        if len(starts) < size:
            return
        hashes = runs(data, starts, WORD_VALUES)
        at = np.arange(len(starts))
        if size > 1:
            fits = piece[: len(piece) - size + 1] == piece[size - 1 :]
            inner = mix(ngrams(hashes, size - 1) ^ salts[doc[: len(doc) - size + 2]])
            frequent = seen(shared.value, inner, bits)
            at = np.flatnonzero(fits & frequent[:-1] & frequent[1:])
        if len(at):
            # Words one after the other, without what stands between them: an Arrow string array over all words.
            lengths = ends - starts
            texts = data[KIND[data] == 0]
            to = np.concatenate(([0], np.cumsum(lengths)))
            words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(texts)))
            whole = (ngrams(hashes, size)[at] if size > 1 else hashes) ^ salts[doc[at]]
            _, first, counts = np.unique(whole, return_index=True, return_counts=True)
            first = at[first]
            parts = [words.take(pa.array(first + j)) for j in range(size)]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]
            names = pa.array(langs).take(pa.array(doc[first]))
            for k in range(0, len(first), 20_000):
                part = slice(k, min(k + 20_000, len(first)))
                yield pa.RecordBatch.from_arrays([names[part], phrase[part].cast(pa.string()), pa.array(counts[part], pa.int64())], schema=COUNTED_SCHEMA)
        if size == 1:
            per = np.bincount(doc, minlength=len(langs))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.nulls(len(langs), pa.string()), pa.array(per, pa.int64())], schema=COUNTED_SCHEMA)

    return run


def seen(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    place = hashes >> U(64 - bits)
    return (bitmap[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) == 1


def _places(size: int, bits: int):
    def run(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            salts = np.array([language_hash(x) for x in langs], U)
            data, offsets = utf8(batch.column("phrase"))
            starts = words_of(data, offsets)[0]
            place = mix(ngrams(runs(data, starts, WORD_VALUES), size)[::size] ^ salts) >> U(64 - bits) if len(langs) else np.zeros(0, U)
            word, inverse = np.unique(place >> U(6), return_inverse=True)
            value = np.zeros(len(word), U)
            np.bitwise_or.at(value, inverse, U(1) << (place & U(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["w", "v"])

    return run


def bitmap_of(frequent: DataFrame, size: int) -> tuple:
    """A broadcast bitmap of the phrases' hashes: eight places for each, 2**MOST_BITS (32 MB) at most."""
    bits = max(LEAST_BITS, min(MOST_BITS, int(frequent.count() * 8).bit_length()))
    found = frequent.select("lang", "phrase").mapInArrow(_places(size, bits), "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["w"].to_numpy()] = found["v"].to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(out.view(U)), bits


def frequent_phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """lang, words (array), f of all phrases that stand ``least`` times or more; and lang, n, the number of its words."""
    texts = documents.select("lang", "text")
    bounded_batches(documents.sparkSession)
    levels, totals, shared, bits = [], None, None, 0
    for size in range(1, longest + 1):
        counts = texts.mapInArrow(_counter(size, shared, bits), COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        kept = stored(counts.where((F.col("n") >= least) | F.col("phrase").isNull()), f"phrases-{size}")
        if size == 1:
            totals = kept.where("phrase IS NULL").select("lang", "n")
        levels.append(kept.where("phrase IS NOT NULL"))
        if size < longest:
            shared, bits = bitmap_of(levels[-1], size)
    return reduce(DataFrame.unionByName, levels).select("lang", F.split("phrase", " ").alias("words"), F.col("n").alias("f")), totals


SCANNED = "lang string, words array<string>, f long, before array<long>, ext long"
SCANNED_SCHEMA = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64()), ("before", pa.list_(pa.int64())), ("ext", pa.int64())])


def _scan(batches):
    """Rows sorted by part, lang and words; each with the counts of the phrases it begins with and its largest extension.

    A row of an earlier range (guest) is given only what this range adds to its extensions.
    """
    opened, out, now = [], [], None  # opened: [words, count, largest extension, guest, counts before]

    def close():
        words, f, ext, guest, before = opened.pop()
        out.append({"lang": now[1], "words": words, "f": None if guest else f, "before": None if guest else before, "ext": ext})

    for batch in batches:
        for part, lang, words, f, guest in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "words", "f", "guest")), strict=True):
            while opened and (now != (part, lang) or words[: len(opened[-1][0])] != opened[-1][0]):
                close()
            now = (part, lang)
            if opened and len(opened[-1][0]) + 1 == len(words):
                opened[-1][2] = max(opened[-1][2], f)
            opened.append([words, f, 0, guest, [x[1] for x in opened]])
        if len(out) >= 5000:
            yield pa.RecordBatch.from_pylist(out, schema=SCANNED_SCHEMA)
            out.clear()
    while opened:
        close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=SCANNED_SCHEMA)


def scanned(phrases: DataFrame, name: str) -> DataFrame:
    """A pass over the stream of phrases in the order of their words: f, before (counts of the first 1, 2, .. words), ext."""
    order = ["lang", "words"]
    ranges = stored(phrases.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), f"phrases-{name}")
    heads = ranges.groupBy("part").agg(F.min(F.struct("lang", "words")).alias("s"))  # a row for each range
    heads = heads.where(F.size("s.words") > 1).select(F.col("part").alias("to"), "s.lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("s.words") - 1), lambda j: F.slice("s.words", 1, j))).alias("words"))
    guests = ranges.join(heads, order).where("part <> to").select(F.col("to").alias("part"), *order, "f", F.lit(True).alias("guest"))
    rows = ranges.select("part", *order, "f", F.lit(False).alias("guest")).unionByName(guests)
    return rows.repartition("part").sortWithinPartitions("part", *order).mapInArrow(_scan, SCANNED)


MERGED = "lang string, phrase string, a long, l long, r long, score long"
MERGED_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), *[(c, pa.int64()) for c in ("a", "l", "r", "score")]])


def _merge(share: int):
    """Sorted rows of both streams; the rows of one phrase lie side by side."""

    def run(batches):
        out, key, a, first, last, ext = [], None, None, None, None, 0

        def done():
            if key is None or len(key[1]) < 2 or 100 * ext >= share * a:
                return
            n = len(key[1])
            score, k = min((2_000_000 * a // (first[k - 1] + last[n - k - 1]), k) for k in range(1, n))
            out.append({"lang": key[0], "phrase": " ".join(key[1]), "a": a, "l": first[k - 1], "r": last[n - k - 1], "score": score})

        for batch in batches:
            for lang, words, f, before, more, side in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "f", "before", "ext", "side")), strict=True):
                if key != (lang, words):
                    done()
                    key, ext = (lang, words), 0
                ext = max(ext, more)
                if f is not None:
                    a = f
                    if side:
                        last = before
                    else:
                        first = before
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema=MERGED_SCHEMA)
                out.clear()
        done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=MERGED_SCHEMA)

    return run


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(documents, least, longest)
    left = scanned(phrases, "prefix").withColumn("side", F.lit(0))
    right = scanned(phrases.withColumn("words", F.reverse("words")), "suffix").withColumns({"words": F.reverse("words"), "side": F.lit(1)})
    order = ["lang", "words"]
    both = left.unionByName(right).repartitionByRange(*order).sortWithinPartitions(*order)
    scores = stored(both.mapInArrow(_merge(share), MERGED), "phrases-scores")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = scores.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(4 * tasks)))  # a lang of any size is ranked in parts first
    salted = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("place") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _grams(m: int) -> str:
    return f"SELECT lang, {m} AS m, unnest(list_transform(range(1, len(w) - {m} + 2), lambda i: array_to_string(w[i:i + {m - 1}], ' '))) AS phrase FROM w WHERE len(w) >= {m}"


SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS ({" UNION ALL ".join(_grams(m) for m in range(1, LONGEST + 1))}),
c AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase),
tot AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE m = 1 GROUP BY lang),
q AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS s FROM c WHERE m > 1 AND f >= {LEAST}),
longer AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda k: list_transform(range(1, m - k + 2), lambda i: array_to_string(s[i:i + k - 1], ' '))))) AS part FROM q WHERE m > 2) GROUP BY lang, part),
cut AS (SELECT lang, m, phrase, a, s, unnest(range(1, m)) AS k FROM q),
scored AS (SELECT x.lang, x.phrase, x.a, l.f AS l, r.f AS r, x.k, ((2000000::HUGEINT * x.a) // (l.f + r.f))::BIGINT AS score FROM cut x
  JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(x.s[1:x.k], ' ') JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(x.s[x.k + 1:x.m], ' ')),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT low.* FROM low LEFT JOIN longer o ON o.lang = low.lang AND o.part = low.phrase WHERE o.most IS NULL OR 100 * o.most < {SHARE} * low.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT kept.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN tot USING (lang) WHERE rank <= {TOP}
"""
