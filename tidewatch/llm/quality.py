"""Quality rules by repetition coverage.

For each text, rolling hashes of several n-gram lengths mark the words inside n-grams that occur at least twice, and
line hashes mark repeated lines; the shares of a text's word characters inside them decide, beside two base rules.
All counting is in numpy over whole Arrow batches; no shuffle.

Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are. Defined results: a null or empty text, and one without words,
has all counts 0 and fails the base rule; rows are independent, so repeated rows repeat their result; null doc_ids are
kept; only doc_id and text are read, so other columns and clashing names don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, utf8
from .wordhash import SPACE, U, VALUES, mix, ngrams, owner, runs, word_bounds, word_hashes

# The largest share of characters inside duplicated n-grams of each length, and inside duplicated lines.
NGRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_SHARE = 0.20
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
LINE_VALUES = VALUES.copy()
LINE_VALUES[10] = 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def spread(marks: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside marked windows of n words."""
    steps = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(marks)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[first])


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = word_bounds(data, offsets)
    hashes, doc = word_hashes(data, starts), owner(first)
    points = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data], dtype=np.int64)))
    chars = points[ends] - points[starts]
    out = {"n_words": np.diff(first).astype(np.int64), "word_chars": np.diff(points[offsets]), "n_symbols": sums(SYMBOLS[data], offsets)}
    # lines
    begins = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(data == 10) + 1)))
    begins = begins[begins < len(data)]
    line_first = np.searchsorted(begins, offsets)
    line_doc = owner(line_first)
    upto = np.append(begins[1:], len(data)) if len(begins) else begins
    line_chars = points[upto] - points[begins]
    full = np.flatnonzero(line_chars > 0)
    again, shared = np.zeros(len(begins), bool), np.zeros(len(begins), bool)
    if len(full):
        keys = runs(data, begins, LINE_VALUES)[full] ^ mix(line_doc[full].astype(U))
        _, where = np.unique(keys, return_index=True)
        later = np.ones(len(full), bool)
        later[where] = False
        again[full], shared[full] = later, repeated(keys)
    out["n_dup_lines"] = sums(again, line_first)
    out["dup_line_chars"] = sums(np.where(again, line_chars, 0), line_first)
    # n-grams: what repeats at n words repeats at 3, so longer windows are looked up only where three-word ones repeat
    size, last = len(hashes), first[1:][doc] if len(doc) else doc
    salt = mix(doc.astype(U) + U(0x632BE59BD9B4E019))
    marks = np.zeros(max(0, size - 2), bool)
    if size >= 3:
        inside = np.flatnonzero(np.arange(size - 2) + 3 <= last[: size - 2])
        marks[inside] = repeated(ngrams(hashes, 3)[inside] ^ salt[inside])
    covered = spread(marks, 3, size) if size >= 3 else np.zeros(size, bool)
    out["n_repeat_words"] = sums(covered, first)
    run = np.concatenate(([0], np.cumsum(marks)))
    for n in NGRAM_SHARES:
        dup = np.zeros(max(0, size - n + 1), bool)
        if size >= n:
            places = np.arange(size - n + 1)
            maybe = np.flatnonzero((run[places + n - 2] - run[places] == n - 2) & (places + n <= last[places]))
            dup[maybe] = repeated(ngrams(hashes, n)[maybe] ^ salt[maybe])
        out[f"dup_chars_{n}"] = sums(np.where(spread(dup, n, size), chars, 0), first) if size >= n else np.zeros(len(first) - 1, np.int64)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    fine = out["dup_line_chars"] <= LINE_SHARE * out["word_chars"]
    for n, share in NGRAM_SHARES.items():
        fine &= out[f"dup_chars_{n}"] <= share * out["word_chars"]
    out["kept"] = ~out["base_failed"] & fine
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in NGRAM_SHARES)]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"


def _batches(batches):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in slices(offsets):
            found = measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], *(pa.array(found[c]) for c in [*COUNTS, "base_failed", "kept"])], ["doc_id", *COUNTS, "base_failed", "kept"])


def quality_rules(docs: DataFrame) -> DataFrame:
    """A row per document: the base counts, characters in repeated lines and n-grams, base_failed and kept."""
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_batches, SCHEMA)


_LENGTHS = [3, *NGRAM_SHARES]
_FIELDS = ", ".join(f"coalesce(max(CASE WHEN n = {n} THEN c END), 0) AS dup_chars_{n}" for n in NGRAM_SHARES)
_FINE = " AND ".join(f"dup_chars_{n} <= {share} * word_chars" for n, share in NGRAM_SHARES.items())
SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
y AS (SELECT doc_id, p, {", ".join("word || ' ' || " + " || ' ' || ".join(f"lead(word, {j}) OVER o" for j in range(1, n)) + f" AS g{n}" for n in _LENGTHS)} FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
i AS ({" UNION ALL ".join(f"SELECT doc_id, p, {n} AS n, g{n} AS gram FROM y WHERE g{n} IS NOT NULL" for n in _LENGTHS)}),
g AS (SELECT doc_id, n, p, count(*) OVER (PARTITION BY doc_id, n, gram) AS times FROM i),
m AS (SELECT DISTINCT doc_id, n, unnest(range(p, p + n)) AS p FROM g WHERE times > 1),
s AS (SELECT m.doc_id, n, sum(length(word)) AS c, count(*) AS words FROM m JOIN x ON m.doc_id = x.doc_id AND m.p = x.p GROUP BY ALL),
f AS (SELECT doc_id, max(CASE WHEN n = 3 THEN words END) AS n_repeat_words, {_FIELDS} FROM s GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM w),
r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS rn FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
t AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS dup_line_chars FROM r WHERE rn > 1 GROUP BY doc_id),
a AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars, {", ".join(f"CAST(coalesce(dup_chars_{n}, 0) AS BIGINT) AS dup_chars_{n}" for n in NGRAM_SHARES)}
  FROM w LEFT JOIN f ON w.doc_id = f.doc_id LEFT JOIN t ON w.doc_id = t.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND dup_line_chars <= {LINE_SHARE} * word_chars AND {_FINE} AS kept FROM b
"""
