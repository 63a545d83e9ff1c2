"""Work in proportion to rows, and cases where rows, columns or sources could be lost."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tidewatch.llm import decontam, linededup, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_line_removal_is_linear(spark):
    lines = "\n".join(f"line {i} of the template" for i in range(100_000))
    rows = [(k, f"head {k}\n{lines}", "en", f"s{k}", 0) for k in range(5)]
    began = time.time()
    out = linededup.remove_boilerplate(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out} == {(k, f"head {k}", 100_001, 100_000) for k in range(5)}
    assert time.time() - began < 60


def test_null_and_empty_sites_differ(spark):
    rows = [(k, "Cookie notice.\nOwn text.", "en", s, 0) for k, s in enumerate([None, "", "a", "b", "c"])]
    out = linededup.remove_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.text, r.n_removed) for r in out] == [("", 2)] * 5
    assert all(r.n_removed == 0 for r in linededup.remove_boilerplate(spark.createDataFrame(rows[1:], SCHEMA)).collect())


def test_line_dedup_keeps_clashing_columns(spark):
    rows = [(k, "same\nown", "en", f"s{k}", 0, 1, 2, "x", 9) for k in range(5)]
    out = linededup.remove_boilerplate(spark.createDataFrame(rows, SCHEMA + ", n_lines int, k1 int, pos string, `a.b` int"))
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "k1", "pos", "a.b", "n_lines", "n_removed"}
    assert {(r["k1"], r["pos"], r["a.b"], r["n_lines"]) for r in out.collect()} == {(2, "x", 9, 2)}


def test_bad_weights_are_refused(spark):
    docs = spark.createDataFrame([(1, "x", "en", "s0", 0), (2, "y", "en", "s1", 0)], SCHEMA)
    for bad in (0, -1, 0.5, True):
        with pytest.raises(ValueError, match="whole numbers"):
            mixing.mix_sources(docs, {"s0": bad})
    with pytest.raises(ValueError, match="slots"):
        mixing.mix_sources(docs, {"s0": 1_000_000})


def test_null_source_is_its_own(spark):
    docs = spark.createDataFrame([(k, "x", "en", [None, "", "a"][k % 3], 0) for k in range(96)], SCHEMA)
    out = mixing.mix_sources(docs, {None: 2}).collect()
    slots = {r.slot: r.source for r in out}
    assert Counter(r.source for r in out) == {None: 32, "": 32, "a": 32} and len(slots) == 6
    assert Counter(slots[k] for k in range(4))[None] == 2


def test_number_tables_meet_by_value_only(spark):
    """Windows of numbers all have one template; they are candidates only where their values are equal."""
    numbers = lambda seed: " ".join(str((seed * 7919 + i * 104729) % 1_000_003) for i in range(60))
    docs = spark.createDataFrame([(k, numbers(k), "en", "s", 0) for k in range(81)], SCHEMA)
    bench = spark.createDataFrame([(k, numbers(1000 + k) if k else numbers(80)) for k in range(20)], "item_id long, text string")
    items = bench.mapInArrow(decontam._items, f"item_id long, {decontam.WINDOWS}").distinct()
    found = docs.select("doc_id", F.md5("text").alias("key"), "text")
    import numpy as np

    every = spark.sparkContext.broadcast((np.full(1 << (decontam.FILTER_BITS - 3), 255, np.uint8), []))
    hits, _ = decontam.met(found.mapInArrow(decontam._documents(every), f"doc_id long, key string, {decontam.WINDOWS}").distinct(), items)
    assert hits.count() <= 200  # of the one equal pair; all pairs of windows would be about four million
    bad = [r.doc_id for r in decontam.judge(docs, bench).where("contaminated").collect()]
    assert bad == [80]


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    extra = ", place string, block int, phase double, slot string, `__o` int, label string, lines int, h long, key string"
    text = "the quick brown fox jumps over the lazy dog and runs away from here "
    rows = [(k, f"{text * 3} {k} {'abcdefghij'[k % 10]}", "en", ["a", None, ""][k % 3], 1, "p", 2, 0.5, "s", 3, "l", 4, 5, "k") for k in range(40)]
    rows += [rows[0], (None, *rows[1][1:]), (77, None, *rows[1][2:]), (78, "", *rows[1][2:])]
    spark.createDataFrame([(1, "nothing like it at all in these texts of ours here now then")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, none = spark.createDataFrame(rows, SCHEMA + extra), spark.createDataFrame([], SCHEMA + extra)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {tuple(r[5:]) for r in out.collect()} <= {tuple(rows[0][5:])}, name
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    sharded = p.shard(spark, docs, str(tmp_path))
    assert sharded.count() == len(rows) and p.shard(spark, none, str(tmp_path)).count() == 0
    assert {(r["place"], r["block"], r["phase"], r["__o"], r["label"], r["lines"], r["h"], r["key"]) for r in sharded.collect()} == {("p", 2, 0.5, 3, "l", 4, 5, "k")}
    assert p.mix(spark, docs, str(tmp_path)).count() == len(rows)
