"""Near-duplicates in large buckets: prefix filtering against brute force, and how many pairs it compares."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, shingles
from tidewatch.llm import neardup


def linked(sets):
    """Pairs of ids whose sets reach 80 %, over an inverted index."""
    holders, shared = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            for j in holders[x]:
                shared[j, i] += 1
            holders[x].append(i)
    return {(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)}


def smallest(sets, links):
    label = {i: i for i in sets}
    while True:
        now = dict(label)
        for a, b in links:
            now[a] = now[b] = min(now[a], now[b])
        if now == label:
            return label
        label = now


def pages(n, seed, copies=0):
    """n pages of one 400-word template with 60 words each from 300 common ones (under 80 %), and near copies of some."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"t{i}" for i in range(400)]
        for at in rng.sample(range(400), 60):
            words[at] = f"c{rng.randrange(300)}"
        out.append(words)
    for k in range(copies):
        words = list(out[k % n])
        for at in rng.sample(range(400), 5 + 3 * (k % 6)):
            words[at] = f"d{rng.randrange(50)}"
        out.append(words)
    return [(i, " ".join(w), "en", "a", 0) for i, w in enumerate(out)]


@pytest.mark.parametrize("few, block", [(64, 4096), (2, 4096), (2, 3)])
def test_template_pages(spark, monkeypatch, few, block):
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "FIRST_HUBS", 2)
    rows = pages(90, 5, copies=24)
    sets = {r[0]: shingles(r[1], 2) for r in rows}
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=2).toPandas().set_index("doc_id")["component_id"].to_dict()
    links = linked(sets)
    assert 10 <= len(links) < 90
    assert got == smallest(sets, links)


def test_short_sets_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 1)
    monkeypatch.setattr(neardup, "FIRST_HUBS", 1)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 14))), "en", "a", 0) for i in range(150)]
    sets = {r[0]: shingles(r[1], 2) for r in rows}
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=2).toPandas().set_index("doc_id")["component_id"].to_dict()
    assert got == smallest(sets, linked(sets))


def test_pairs_of_a_template(spark):
    """The exact pass compares a small part of all pairs, and none that reaches the limit is missing."""
    rows = pages(400, 6)
    search = neardup.Search(spark.createDataFrame(rows, SCHEMA), 2, 80)
    alive = search.mixed(search.members, spark.createDataFrame([], "cls long, comp long"))
    pairs = search.outsider_pairs(search.reachable(alive)).count()
    assert pairs < 400 * 399 / 2 / 50


def test_a_shingle_is_one_row_however_many_buckets(spark, monkeypatch):
    """Classes that share many buckets meet once a shingle; no pair comes from another bucket, none is lost."""
    monkeypatch.setattr(neardup, "FEW", 2)
    rows, met = pages(90, 5, copies=24), []
    meeting = neardup.Search.meeting
    monkeypatch.setattr(neardup.Search, "meeting", lambda self, rows, key, near: met.append((key, rows)) or meeting(self, rows, key, near))
    search = neardup.Search(spark.createDataFrame(rows, SCHEMA), 2, 80)
    alive = search.reachable(search.mixed(search.members, spark.createDataFrame([], "cls long, comp long")))
    pairs = {tuple(sorted(r)) for r in search.outsider_pairs(alive).collect()}
    ((key, wide),) = [x for x in met if "shingle" in x[0]]
    assert wide.count() == wide.select("cls", "shingle").distinct().count() > 0
    bands = alive.groupBy("cls").agg(F.collect_set("band").alias("b")).toPandas().set_index("cls")["b"].map(set)
    assert all(bands[a] & bands[b] for a, b in pairs)
    sets = {r["cls"]: set(np.frombuffer(r["items"], np.int64)) for r in search.sets.collect()}
    ids = sorted(bands.index)
    alike = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if bands[a] & bands[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(alike) >= 10 and alike <= pairs


def test_links_of_every_fiftieth_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text, 2) for r in docs.select("doc_id", "text").toPandas().itertuples()}
    got = neardup.near_duplicates(docs, words=2).toPandas().set_index("doc_id")["component_id"].to_dict()
    links = linked(sets)
    assert any(a % 50 == 0 or b % 50 == 0 for a, b in links)
    assert [(a, b) for a, b in links if got[a] != got[b]] == []
