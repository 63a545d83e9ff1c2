"""The pipeline's near-duplicate stage over rows without a doc_id."""

import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_null_ids_keep_one_of_each_group(spark):
    text = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    near = text("c").replace("c39", "changed")
    rows = [(1, text("a")), (1, text("a")), (2, text("b")), (None, text("c")), (None, text("c")), (None, near), (None, text("d")), (None, text("b")), (None, text("e"))]
    for some in (rows, rows[1:]):
        out = p.drop_near_duplicates(spark, spark.createDataFrame([(i, t, "en", "a", 0) for i, t in some], SCHEMA), None).collect()
        kept = sorted((r["doc_id"] or 0, r["text"]) for r in out)
        c = [t for i, t in kept if t in (text("c"), near)]
        assert len(c) == 1 and len(kept) == 5
        assert {(1, text("a")), (2, text("b")), (0, text("d")), (0, text("e"))} < set(kept)
