"""Each operator against brute force, and its edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import chat, decontam, langid, linededup, mixing, neardup, quality, sharding, token_counts, warc
from tidewatch.llm.common import scratch_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "   ", "en", None, 3), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (None, "one two", "de", "b", 7),
    (6, "x " * 40_000, "en", "b", 80_000), (7, "Ünï çödé 　 wörds\nline\nline", "fr", "b", 20), (8, "12 34 !!", "en", "c", 8), (9, "the quick brown fox " * 30, "en", "c", 600), (10, "the quick brown fox " * 30, "en", "d", 600),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, docs, words):
    got = neardup.near_duplicates(docs, words=words).toPandas().set_index("doc_id")
    sets = {r.doc_id: shingles(r.text, words) for r in docs.select("doc_id", "text").toPandas().itertuples()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {i: find(i) for i in ids} == got["component_id"].to_dict()
    assert {i: len(sets[i]) for i in ids} == got["n_shingles"].to_dict()
    assert (got["kept"] == (got["component_id"] == got.index)).all()


def test_near_duplicates_edges(spark, odd, none):
    rows = neardup.near_duplicates(odd, words=2).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[1]["kept"] and by[2]["kept"]
    assert by[4]["n_shingles"] == 1 and by[10]["component_id"] == 9 and not by[10]["kept"] and by[6]["n_shingles"] == 1
    assert neardup.near_duplicates(none, words=2).count() == 0


def test_near_copies_chain_across_rounds(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"v{i}x{j}" if (j * 7 + i * 13) % 200 < 2 * (i % 12) else w for j, w in enumerate(base)), "en", "a", 0) for i in range(120)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=2).toPandas().set_index("doc_id")["component_id"].to_dict()
    sets = {r[0]: shingles(r[1], 2) for r in rows}
    label = {i: i for i in sets}
    for _ in range(120):
        now = {i: min([label[j] for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]) for i in sets}
        if now == label:
            break
        label = now
    assert got == label


def test_repeated_rows_do_not_multiply(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"v{i}x{j}" if (j * 7 + i * 13) % 200 < 2 * (i % 12) else w for j, w in enumerate(base)), "en", "a", 0) for i in range(60)]
    found = []
    for table in (rows, rows * 3):
        search = neardup.Search(spark.createDataFrame(table, SCHEMA), 2, 80)
        comps = {r["cls"]: r["comp"] for r in search.run().collect()}
        assert search.sets.count() == search.sets.select("cls").distinct().count()
        found.append((comps, search.members.count(), search.sets.count()))
    assert found[0] == found[1]


def test_repeated_ids_are_told_apart_by_text(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("b")), (2, text("b")), (None, text("a")), (None, text("c")), (3, None), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).withColumn("gone", F.lit("mine"))
    got = Counter((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs, 5).collect())
    assert got == Counter({(1, 1): 2, (2, 1): 1, (None, 1): 1, (None, None): 1, (3, 3): 2})
    left = neardup.one_of_each(docs.union(docs), 5)
    assert left.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"], r["gone"]) for r in left.collect())
    assert kept == Counter({(1, text("a"), "mine"): 1, (1, text("b"), "mine"): 1, (None, text("c"), "mine"): 1, (3, None, "mine"): 4})


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 5)
    monkeypatch.setattr(neardup, "FIRST_HUBS", 2)
    test_near_copies_chain_across_rounds(spark)


def test_line_dedup(spark, odd, none):
    rows = [(i, f"Buy now!  \nown line {i}\n\nBuy now!", "en", f"s{i % 6}", 0) for i in range(12)] + [(50, "rare\nrare", "en", "s1", 0), (51, None, "en", "s1", 0)]
    out = {r["doc_id"]: r for r in linededup.remove_boilerplate(spark.createDataFrame(rows, SCHEMA).withColumn("n_lines", F.lit("clash"))).collect()}
    assert out[3]["text"] == "own line 3\n" and out[3]["n_removed"] == 2 and out[3]["n_lines"] == 3
    assert out[50]["text"] == "rare\nrare" and out[51]["text"] is None and out[51]["n_lines"] == 0
    assert linededup.remove_boilerplate(odd).count() == len(ODD) and linededup.remove_boilerplate(none).count() == 0


def test_token_counts(spark, odd, docs, none):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = scratch_path(spark, "cache")
    rows = token_counts.count_tokens(odd.withColumn("n_tokens", F.lit("clash")), path, cache).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter((r[0], len(model.encode(r[1] or ""))) for r in ODD)
    before = spark.read.parquet(cache).count()
    token_counts.count_tokens(odd, path, cache)
    assert spark.read.parquet(cache).count() == before == len({r[1] or "" for r in ODD})
    token_counts.compacted(spark, cache, f"{cache}-compact")
    assert spark.read.parquet(f"{cache}-compact").count() == before
    some = token_counts.count_tokens(docs, path, cache).toPandas().set_index("doc_id")["n_tokens"].to_dict()
    assert some == {r.doc_id: len(model.encode(r.text)) for r in docs.toPandas().itertuples()}
    assert token_counts.count_tokens(none, path, cache).count() == 0
    # with a warm cache no text is sent to the tokenizer, nor any row of its text to another task
    known = spark.read.parquet(cache).count()
    missing = docs.select(F.unhex(F.sha2("text", 256)).alias("content_digest")).distinct().join(spark.read.parquet(cache), "content_digest", "left_anti")
    assert missing.count() == 0 and not neardup.Places(missing, "content_digest").flagged(docs, "text", "maybe").where("maybe").head(1)
    token_counts.count_tokens(docs, path, cache)
    assert spark.read.parquet(cache).count() == known


def test_preferences(spark):
    turn = "pair_id long, side string, turn long, role string, text string"
    rows = [(1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 1, "assistant", "bad"), (2, "chosen", 0, None, None), (2, "rejected", 0, "user", ""), (3, "chosen", 0, "user", "only")]
    out = {r["pair_id"]: r for r in chat.format_preferences(spark.createDataFrame(rows, turn)).collect()}
    assert out[1]["n_common"] == 1 and out[1]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert out[1]["chosen"] == "<|im_start|>assistant\ngood<|im_end|>\n" and [(s["text"], s["loss"]) for s in out[1]["chosen_segments"]] == [("<|im_start|>assistant\n", False), ("good<|im_end|>\n", True)]
    assert out[2]["n_common"] == 1 and out[2]["chosen"] == "" and out[3]["n_common"] == 0 and out[3]["prompt"] == "" and out[3]["rejected"] == ""
    assert chat.format_preferences(spark.createDataFrame([], turn)).count() == 0


def test_mixing(spark, docs, odd, none):
    out = mixing.mix_sources(docs.select("doc_id", "source"), {"src0": 3}, block=4).toPandas()
    assert len(out) == docs.count() and not out.duplicated(["slot", "place"]).any() and (out.groupby("slot")["source"].nunique() == 1).all()
    slots = out.drop_duplicates("slot").sort_values("slot")
    assert slots["slot"].tolist() == list(range(len(slots))) and ((slots["slot"] >= slots["release"]) & (slots["slot"] < slots["deadline"])).all()
    for _, phase in slots.groupby("phase"):
        weights = {s: 3 if s == "src0" else 1 for s in phase["source"].unique()}
        done, total = Counter(), sum(weights.values())
        for t, s in enumerate(phase["source"], 1):
            done[s] += 1
            assert all(abs(done[x] - t * w / total) < 1 for x, w in weights.items())
    assert mixing.mix_sources(odd.withColumn("slot", F.lit("clash"))).count() == len(ODD) and mixing.mix_sources(none).count() == 0
    assert mixing.mixed_order(odd).columns == odd.columns


def test_decontamination(spark, docs, odd, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {r["doc_id"] for r in decontam.judge(docs, bench).where("contaminated").collect()}
    items = [r["text"] for r in bench.collect()]
    whole = {r["doc_id"] for r in docs.collect() if any(i in r["text"] for i in items)}
    assert got == whole and whole
    question = "A train leaves Paris at 9 and covers 120 km in 2 hours. How fast does the train from Paris go on the way?"
    changed = question.replace("Paris", "Rome").replace("120", "450").replace("9", "7").replace("2 hours", "5 hours")
    mixed = changed.replace("from Rome", "from Oslo")
    rows = [(1, f"Some words before. {changed} Some after.", "en", "a", 0), (2, f"So: {mixed}", "en", "a", 0), (3, "Nothing of the kind here at all, only other words that go on.", "en", "a", 0)]
    tiny = spark.createDataFrame([(1, question), (2, None), (None, "x")], "item_id long, text string")
    out = {r["doc_id"]: r["contaminated"] for r in decontam.judge(spark.createDataFrame(rows, SCHEMA), tiny).collect()}
    assert out == {1: True, 2: False, 3: False}
    assert decontam.judge(odd, tiny).count() == len(ODD) and decontam.judge(none, tiny).count() == 0 and decontam.clean(odd, tiny.limit(0)).count() == len(ODD)


def test_sharding(spark, docs, odd, none):
    out = sharding.shard_documents(docs, 24).toPandas()
    texts = docs.select("doc_id", "text").toPandas().merge(out, on="doc_id")
    assert (texts.groupby("text")["shard"].nunique() == 1).all() and len(out) == docs.count()
    groups = texts.groupby("text")["size"].sum().sort_values(ascending=False)
    loads = [0] * 24
    for s in groups:
        loads[loads.index(min(loads))] += s
    assert out.groupby("shard")["size"].sum().max() <= max(loads) + groups.min()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sharding.shard_documents(odd.withColumn("shard", F.lit("clash"))).count() == len(ODD) and sharding.shard_documents(none).count() == 0


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.98 and out["score"].between(0, 1).all()
    by = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[3]["lang_pred"] == by[8]["lang_pred"] == "und"
    assert langid.identify(none, model).count() == 0 and langid.identify(odd, langid.train(none)).where("lang_pred <> 'und'").count() == 0
    rows = {r["lang"]: r["text"] for r in docs.where("length(text) between 300 and 900").select("lang", "text").collect()}
    found = langid.spans(model, rows["de"] + " " + rows["es"])
    assert [s[2] for s in found if s[1] - s[0] > 10] == ["de", "es"]
    assert langid.keep_identified(odd, model).columns == odd.columns


def test_archives(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://c/\nx", ""), (5, "http://d/", "é" * 400_000), (5, "http://d/", "é" * 400_000), (None, "http://e/", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_path(spark, "warc")
    bundles = warc.write_archives(pages, path)
    out = warc.read_archives(path, bundles).toPandas()
    assert len(out) == len(rows) and out[out.page_id == 2].iloc[0].record_type == "revisit" and out[out.page_id == 2].iloc[0].refers_to == 1
    assert out[out.page_id == 4].iloc[0].refers_to == 3 and set(out[out.page_id == 5].record_type) == {"response"} and out[out.page_id == 5].payload_bytes.tolist() == [800_000] * 2
    import zstandard

    store, folder = warc.opened(f"{path}/archives")
    for row in bundles.collect():
        with store.open_input_file(f"{folder}/{row['bundle']}") as source:
            frames, content = warc.seek_table(source), source.read_at(source.size(), 0)
        plain = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
        assert len(content) == row["n_bytes"] and len(plain) == sum(f[2] for f in frames) and plain.count(b"WARC/1.1\r\n") == row["n_records"]
    ((_, fields, body),) = warc.find_records(path, bundles, [1])
    assert fields["WARC-Type"] == "response" and body.decode() == next(h for p, _, h, *_ in rows if p == 1)
    ((_, fields, body),) = warc.find_records(path, bundles, [2])
    assert body == b"" and fields["WARC-Refers-To"].startswith("<urn:page:1:") and warc.find_records(path, bundles, [999]) == []
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_quality(spark, docs, odd, none):
    def brute(text):
        w = WORD.findall(text or "")
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = set()
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                inside |= {i, i + 1, i + 2}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        chars = {}
        for n in quality.NGRAM_SHARES:
            c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            hit = {i + j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(n)}
            chars[n] = sum(len(w[i]) for i in hit)
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), *chars.values())

    for rows in (docs, odd):
        texts = {(r["doc_id"], r["text"]) for r in rows.collect()}
        got = {(r["doc_id"], tuple(r[c] for c in ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"dup_chars_{n}" for n in quality.NGRAM_SHARES)])) for r in quality.quality_rules(rows).collect()}
        assert got == {(i, brute(t)) for i, t in texts}
    assert quality.quality_rules(none).count() == 0
    kept = quality.quality_rules(docs).toPandas()
    assert (kept["base_failed"] == ((kept["n_words"] < 50) | (100 * kept["n_repeat_words"] > 50 * kept["n_words"]))).all()


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.drop_near_duplicates(spark, p.identify_languages(spark, docs, SF), SF)
    sets = {r.doc_id: shingles(r.text, 5) for r in kept.toPandas().itertuples()}
    ids = sorted(sets)
    assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] & sets[b])
    mixed = p.mix(spark, p.decontaminate(spark, kept, SF), SF)
    assert mixed.columns == docs.columns and mixed.count() == p.decontaminate(spark, kept, SF).count()
    twice = docs.limit(5).union(docs.limit(5))
    assert p.drop_near_duplicates(spark, twice, SF).count() <= 5
