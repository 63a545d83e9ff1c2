"""Language identification of mixed-language text.

Training: byte-trigram counts of each language over a sample of at most about TRAIN_DOCS labelled documents outside the
held-out fold, taken by a hash of doc_id. The model is one table of 2**15 log-probabilities a language, and the share of
each script in each language's text; its size depends on the number of languages alone.

Prediction: the script of a word, from the ranges of its UTF-8 lead bytes, narrows its candidate languages to those in
whose text that script was seen; a word's score is the sum of its trigrams' log-probabilities. Viterbi over the words,
with a penalty for each switch, labels spans. The label with most letters-bearing words is the document's language and
its share of such words the score.

Defined results: a text that is null or has no letter is ``und`` with score 0; a text with letters but no word of a
script of any learned language is judged over all languages; with no training text at all every text is ``und``; ties fall to the first language by name; rows are independent, so
repeated rows repeat their result; a null doc_id counts as held out and is kept; other columns aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, utf8
from .wordhash import SPACE, owner, word_bounds

BITS, TRAIN_DOCS, FOLDS, SWITCH = 15, 8000, 5, 6.0
SCRIPT_SHARE = 0.001
GROUP_BYTES = 6 << 20
# Scripts by the lead byte of their UTF-8 ranges.
SCRIPTS = ["none", "latin", "greek", "cyrillic", "semitic", "indic", "kana", "han", "hangul", "other"]
LEADS = [(0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xCA, 1), (0xCD, 0xCF, 2), (0xD0, 0xD4, 3), (0xD6, 0xDF, 4), (0xE0, 0xE0, 5), (0xE1, 0xE2, 9), (0xE3, 0xE3, 6), (0xE4, 0xE9, 7), (0xEA, 0xED, 8), (0xEE, 0xF4, 9)]
SCRIPT = np.zeros(256, np.int8)
for _a, _b, _s in LEADS:
    SCRIPT[_a : _b + 1] = _s
LETTER = re.compile(r"[^\W\d_]")
FOLD = np.arange(256, dtype=np.uint32)
FOLD[65:91] = FOLD[97:123]
FOLD[SPACE] = 32


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Table place of the three lower-cased bytes that end at each byte; white space is one blank, as is what precedes a text."""
    x = FOLD[data]
    before = np.concatenate((np.full(1, 32, np.uint32), x[:-1]))[: len(x)]
    two = np.concatenate((np.full(2, 32, np.uint32), x[:-2]))[: len(x)]
    begin = offsets[:-1][np.diff(offsets) > 0]
    before[begin] = two[begin] = 32
    two[begin[begin + 1 < len(x)] + 1] = 32
    mixed = (two * np.uint32(0x9E3779B1)) ^ (before * np.uint32(0x85EBCA77)) ^ (x * np.uint32(0xC2B2AE3D))
    mixed *= np.uint32(0x27D4EB2F)
    return mixed >> np.uint32(32 - BITS)


def word_scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The largest script number among a word's bytes; 0 where it has no letter."""
    return np.maximum.reduceat(SCRIPT[data], starts) if len(starts) else np.zeros(0, np.int8)


def _count(batches):
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for a, b in slices(offsets):
            x, places = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            grams, doc = trigrams(x, places), owner(places)
            starts, _, first = word_bounds(x, places)
            scripts, word_doc = word_scripts(x, starts), owner(first)
            for lang in set(langs[a:b]):
                own = langs[a:b] == lang
                t = tables.setdefault(lang, np.zeros((1 << BITS) + len(SCRIPTS), np.int64))
                t[: 1 << BITS] += np.bincount(grams[own[doc] & ~SPACE[x]], minlength=1 << BITS)
                t[1 << BITS :] += np.bincount(scripts[own[word_doc]], minlength=len(SCRIPTS))
    for lang, t in tables.items():
        at = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(t[at])], ["lang", "place", "n"])


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> dict:
    """The model; reads text, lang and doc_id of labelled documents that aren't held out."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    n = labelled.select("doc_id", "lang").count()
    share = min(1.0, most / max(1, n))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = sample.select("text", "lang").mapInArrow(_count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()  # 2**15 rows a language at most
    langs = sorted(counts["lang"].unique())
    table, scripts = np.zeros((len(langs), 1 << BITS)), np.zeros((len(langs), len(SCRIPTS)))
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        grams = own[own["place"] < 1 << BITS]
        table[k, grams["place"]] = grams["n"]
        rest = own[own["place"] >= 1 << BITS]
        scripts[k, rest["place"] - (1 << BITS)] = rest["n"]
    table = np.log((table + 0.5) / (table + 0.5).sum(axis=1, keepdims=True)) if len(langs) else table
    seen = scripts / np.maximum(1, scripts[:, 1:].sum(axis=1, keepdims=True)) >= SCRIPT_SHARE
    return {"langs": langs, "table": table.astype(np.float32), "seen": seen}


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word. scores: words x labels; first: number of each document's first word.

    All documents go forward together, one word a step, the longest first, so that those still running are a prefix.
    """
    words, labels = scores.shape
    assert labels < 1 << 15, "labels are 16-bit numbers"
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, left = first[:-1][order], counts[order]
    running = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
    back, state = np.zeros((words, labels), np.int16), np.zeros((len(order), labels), np.float64)
    for t, k in enumerate(running):
        at, now = begin[:k] + t, state[:k]
        if t:
            best = now.argmax(axis=1)
            jump = now[np.arange(k), best][:, None] - penalty
            switch = jump > now
            back[at] = np.where(switch, best[:, None], np.arange(labels))
            now = np.where(switch, jump, now)
        state[:k] = now + scores[at]
    out = np.zeros(words, np.int16)
    label = state.argmax(axis=1)
    for t in range(len(running) - 1, -1, -1):
        k = running[t]
        at = begin[:k] + t
        out[at] = label[:k]
        label[:k] = back[at, label[:k]]
    return out


def label_words(model: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores (words x languages), whether a word counts, the first word of each document, and how many have a candidate by script.

    In a document without a word of a known script all words count, for all languages.
    """
    starts, ends, first = word_bounds(data, offsets)
    grams, langs = trigrams(data, offsets), len(model["langs"])
    scores = np.zeros((len(starts), langs), np.float32)
    scripts = word_scripts(data, starts)
    for k in range(langs):
        total = np.concatenate(([0.0], np.cumsum(np.where(SPACE[data], 0, model["table"][k][grams]), dtype=np.float64)))
        scores[:, k] = total[ends] - total[starts]
    allowed = model["seen"][:, scripts].T if langs else np.zeros((len(starts), 0), bool)
    usable = (scripts > 0) & allowed.any(axis=1)
    total = np.concatenate(([0], np.cumsum(usable)))
    known = total[first[1:]] - total[first[:-1]]
    strange = (known == 0)[owner(first)]
    allowed, usable = allowed | strange[:, None], usable | strange
    scores = np.where(allowed, scores, -1e4 * usable[:, None])
    scores[~usable] = 0
    return scores.astype(np.float32), usable, first, known


def predict(model: dict, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text of a column, and whether it has a word of a learned script, some megabytes at a time."""
    names, shares, known = [], [np.zeros(0)], [np.zeros(0, bool)]
    for a, b in slices(utf8(column)[1], GROUP_BYTES):
        found, share, some = predict_group(model, column.slice(a, b - a))
        names += found
        shares.append(share)
        known.append(some)
    return names, np.concatenate(shares), np.concatenate(known)


def predict_group(model: dict, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    parts = [label_words(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)] if model["langs"] else []
    n, langs = len(column), len(model["langs"])
    votes, familiar = np.zeros((n, max(1, langs)), np.int64), np.zeros(n, bool)
    if parts:
        familiar = np.concatenate([p[3] for p in parts]) > 0
        scores, usable = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))))
        del parts
        labels = viterbi(scores, first, SWITCH)
        np.add.at(votes, (owner(first)[usable], labels[usable]), 1)
    total = votes.sum(axis=1)
    letters = np.array([bool(x) and LETTER.search(x) is not None for x in column.to_pylist()], bool)
    known = (total > 0) & letters
    best = votes.argmax(axis=1)
    names = [model["langs"][b] if k else "und" for b, k in zip(best, known, strict=True)]
    return names, np.where(known, votes[np.arange(n), best] / np.maximum(1, total), 0.0), familiar


def _predict(shared):
    def run(batches):
        for batch in batches:
            names, share, _ = predict(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(share)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _keep(shared, least: float):
    def run(batches):
        for batch in batches:
            names, share, familiar = predict(shared.value, batch.column("text"))
            yield batch.filter(pa.array((share >= least) & familiar & np.array([x != "und" for x in names], bool)))

    return run


def spans(model: dict, text: str | None) -> list[tuple[int, int, str]]:
    """(first word, end word, language) of each span of one text; words without a candidate join the span before them."""
    if not text or not LETTER.search(text) or not model["langs"]:
        return []
    data, offsets = utf8(pa.array([text]))
    scores, usable, first, _ = label_words(model, data, offsets)
    if not usable.any():
        return []
    labels = viterbi(scores, first, SWITCH)
    cuts = np.flatnonzero(np.diff(labels)) + 1
    edges = [0, *cuts.tolist(), len(labels)]
    return [(a, b, model["langs"][labels[a]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by its text alone."""
    bounded_batches(docs.sparkSession, 2000)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict, least: float = 0.0) -> DataFrame:
    """docs with a familiar word and a language; all columns as they were.

    least: the least share of words of the winning language; by default texts of several languages are kept too.
    """
    bounded_batches(docs.sparkSession, 2000)
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model), least), docs.schema)
