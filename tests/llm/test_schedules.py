"""Schedules and labels against plain loops: EDF slots, mixed order, LPT, Viterbi, token cache, scripts without a language."""

import heapq
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import langid, mixing, sharding, token_counts
from tidewatch.llm.common import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edf(blocks, targets):
    """Slots of Pfair blocks one by one: released ones, earliest deadline first; a new pattern when a source ends."""
    left, done, out = dict(blocks), dict.fromkeys(blocks, 0), []
    while left:
        weights = {s: targets.get(s, 1) for s in left}
        total, taken, t = sum(weights.values()), dict.fromkeys(left, 0), 0
        while all(left.values()):
            ready = [(-(-(taken[s] + 1) * total // w), s) for s, w in weights.items() if taken[s] * total // w <= t]
            _, s = min(ready)
            out.append((s, done[s]))
            taken[s] += 1
            done[s] += 1
            left[s] -= 1
            t += 1
        left = {s: n for s, n in left.items() if n}
    return out


@pytest.mark.parametrize("targets", [{"a": 3, "b": 2}, {"a": 1}, {"c": 5, "b": 2}])
def test_slots_are_earliest_deadline_first(spark, targets):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, "b").when(F.col("id") % 7 == 0, "c").otherwise("a").alias("source"))
    got = mixing.mix_sources(docs, targets, block=4).select("slot", "source", "block").distinct().orderBy("slot").collect()
    counts = {r["source"]: -(-r["n"] // 4) for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert [(r["source"], r["block"]) for r in got] == edf(counts, targets)


def test_mixed_order_keeps_columns_and_order(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 3 if i % 2 else 0}", 777) for i in range(3000)] + [(None, None, "en", None, 1), (None, "x", "en", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"lang": "slot", "n_chars": "__w"})
    got = mixing.mixed_order(docs, {"s0": 3}, block=4)
    assert got.columns == docs.columns and sorted(got.collect(), key=repr) == sorted(docs.collect(), key=repr)
    slots = {(r["doc_id"], r["text"]): (r["slot"], r["place"]) for r in mixing.mix_sources(docs, {"s0": 3}, block=4).collect()}
    path = scratch_path(spark, "mixed")
    got.write.parquet(path)
    order = spark.read.parquet(path).select("doc_id", "text", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()
    places = [slots[r["doc_id"], r["text"]] for r in order]
    assert places == sorted(places) and len(set(places)) == len(rows)
    assert mixing.mixed_order(docs.limit(0)).count() == 0


def test_too_many_sources_are_refused(spark):
    docs = spark.range(mixing.MOST_SOURCES + 1).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"))
    with pytest.raises(ValueError, match="sources"):
        mixing.mix_sources(docs)


def plain_lpt(items, shards):
    heap, out = [(0, s) for s in range(shards)], []
    for size in sorted(items, reverse=True):
        load, s = heapq.heappop(heap)
        out.append((size, s))
        heapq.heappush(heap, (load + size, s))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_the_plain_loop(seed):
    draw = random.Random(seed)
    items = [draw.choice([1, 2, 3, 9, 50, 700]) if seed % 2 else int(draw.paretovariate(0.7)) + 8 for _ in range(30_000 if seed < 2 else 400)]
    counts = {s: items.count(s) for s in set(items)} if len(set(items)) < 50 else dict(zip(*np.unique(items, return_counts=True), strict=True))
    got = []
    for size, runs in sharding.lpt_runs(sorted(((int(s), int(n)) for s, n in counts.items()), reverse=True), 24):
        ends = [r[0] for r in runs[1:]] + [int(counts[size])]
        got += [(size, s) for (start, turn), end in zip(runs, ends, strict=True) for s in itertools.islice(itertools.cycle(turn), end - start)]
    assert got == plain_lpt([int(x) for x in items], 24)


def test_groups_are_placed_by_the_plain_loop(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 700, F.lit("the same")).otherwise(F.repeat(F.lit("é"), (F.col("id") % 97).cast("int"))).alias("text"))
    out = sharding.shard_documents(docs).toPandas()
    groups = out.merge(docs.toPandas(), on="doc_id").groupby("text").agg(size=("size", "sum"), shard=("shard", "first"), n=("shard", "nunique"))
    assert (groups["n"] == 1).all()
    want = plain_lpt(groups["size"].tolist(), 24)
    assert sorted(zip(groups["size"], groups["shard"], strict=True)) == sorted(want)
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_shard_slots_follow_the_mixed_order(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(i, f"text {i}", "en", f"src{i % 4 if i % 2 else 0}", 3) for i in range(900)], SCHEMA).withColumn("slot", F.lit("mine"))
    place = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix_sources(docs).collect()}
    out = p.shard(spark, docs, None).toPandas()
    for _, g in out.groupby("shard"):
        order = [place[d] for d in g.sort_values("slot")["doc_id"]]
        assert order == sorted(order) and sorted(g["slot"]) == list(range(len(g)))
    assert p.shard(spark, docs.limit(0), None).count() == 0


@pytest.mark.parametrize("clash", ["slot", "_metadata"])
def test_shards_take_the_order_that_the_mixing_stage_stored(spark, clash):
    """Another order in the files is another order of slots; the mixed one is mix's own."""
    import corpus_pipeline as p

    docs = spark.createDataFrame([(i, f"text {i}", "en", f"src{i % 4}", 3) for i in range(1200)], SCHEMA).withColumn(clash, F.lit("mine"))
    mixed = mixing.mixed_order(docs)
    for made in (docs.repartitionByRange(12, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")), mixed):
        path = scratch_path(spark, "arranged")
        made.write.option("maxRecordsPerFile", 50).parquet(path)
        rows = [r["doc_id"] for r in made.collect()] if made is not mixed else [r["doc_id"] for r in mixing.mix_sources(docs).orderBy("slot", "place").collect()]
        place = {d: k for k, d in enumerate(rows)}
        out = p.shard(spark, spark.read.parquet(path), None).toPandas()
        assert len(out) == 1200 and (clash in ("slot",) or set(out[clash]) == {"mine"})
        for _, g in out.groupby("shard"):
            order = [place[d] for d in g.sort_values("slot")["doc_id"]]
            assert order == sorted(order) and sorted(g["slot"]) == list(range(len(g)))


def test_viterbi_equals_every_path():
    draw = np.random.default_rng(5)
    first = np.array([0, 4, 4, 5, 11])
    scores = draw.normal(size=(11, 3)) * 4
    got = langid.viterbi(scores, first, 2.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        value = lambda path, a=a: sum(scores[a + i, x] for i, x in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))
        best = max(itertools.product(range(3), repeat=b - a), key=value)
        assert value(tuple(got[a:b])) == pytest.approx(value(best))


def test_more_languages_than_a_byte_holds():
    scores = np.zeros((3, 200))
    scores[:, 150] = 9
    assert langid.viterbi(scores, np.array([0, 3]), 6.0).tolist() == [150] * 3


def test_scripts_without_a_language(spark):
    rows = [(i, "the house and the garden of the people " * 5, "en", "a", 0) for i in range(40)] + [(100 + i, "das haus und der garten der leute ist " * 5, "de", "a", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, "これは日本語の文章です"), (2, "Это русский текст"), (3, "ª º"), (4, "12 ?!"), (5, None), (6, "the garden")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, model).collect()}
    assert {got[1], got[2], got[3]} <= {"en", "de"} and got[4] == got[5] == "und" and got[6] == "en"
    assert [r["doc_id"] for r in langid.keep_identified(odd, model).collect()] == [6]


def test_a_digest_stored_twice_counts_once(spark):
    import public_tokenizers

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "cache")
    docs = spark.createDataFrame([(1, "some text"), (2, "some text"), (3, "other")], "doc_id long, text string")
    once = sorted(token_counts.count_tokens(docs, path, cache).collect())
    spark.read.parquet(cache).write.mode("append").parquet(f"{cache}-copy")
    spark.read.parquet(f"{cache}-copy").write.mode("append").parquet(cache)
    assert sorted(token_counts.count_tokens(docs, path, cache).collect()) == once and len(once) == 3


def test_sizes_pass_the_driver_in_pieces(spark, monkeypatch):
    rows = [(i, "x" * (i % 37) + str(i % 5), "en", "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    shown = lambda: sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_documents(docs, 5).collect())
    whole = shown()
    monkeypatch.setattr(sharding, "PIECE", 3)
    assert shown() == whole
