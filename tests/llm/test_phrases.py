"""Phrase collocations against plain counting, and their edge cases."""

import random
import re
from collections import Counter

import duckdb

from tidewatch.llm import phrases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least, longest=4, share=80, top=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p for p, a in f.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p in candidates:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i : i + k]] = max(covered[p[i : i + k]], f[p])
        found = []
        for p in candidates:
            if 100 * covered[p] >= share * f[p]:
                continue
            score, k = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, totals[lang], -score) for r, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(seed, n):
    dice = random.Random(seed)
    words = ["the", "The", "of", "in", "and", "é", "new", "york", "a\x01", "x\x0b", "O'k", "ß"]
    return [("".join(dice.choice(words) + dice.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(dice.randrange(60))), dice.choice(["en", "en", "en", "de", None, "und"])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, x, "s", 1) for k, (t, x) in enumerate(rows)], SCHEMA)


def test_equals_plain_counting(spark):
    rows = made(3, 400) + [(None, "en"), ("", None), ("  ", "fr"), ("one", "fr"), ("new york " * 30_000, "es")]
    want = plain(rows, 5)
    assert len(want) > 100
    assert rows_of(phrases.collocations(frame(spark, rows).repartition(7), least=5)) == want


def test_ties_and_top(spark):
    rows = made(4, 200) * 2
    assert rows_of(phrases.collocations(frame(spark, rows), least=4, top=7, share=50)) == plain(rows, 4, share=50, top=7)


def test_ranges_that_begin_inside_a_prefix(spark):
    """All phrases begin with one word, so most ranges need rows of earlier ones."""
    dice = random.Random(9)
    rows = [(f"the w{dice.randrange(40)} v{dice.randrange(4)} u{dice.randrange(3)}. ", "en") for _ in range(8000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(phrases.collocations(frame(spark, rows), least=5)) == plain(rows, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table_and_clashing_columns(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    rows = made(5, 150)
    clash = spark.createDataFrame([(t, x, "a b", 1, [1], "q") for t, x in rows], "text string, lang string, phrase string, n long, words array<int>, part string")
    assert rows_of(phrases.collocations(clash, least=5)) == plain(rows, 5)


def test_sql_on_the_test_data(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(phrases.SQL).fetchall())
    got = rows_of(phrases.collocations(spark.read.parquet(f"{sf}/documents.parquet")))
    assert got == want
    docs = con.execute("SELECT text, lang FROM documents").fetchall()
    assert got == plain(docs, 30)
