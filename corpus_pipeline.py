"""Corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding, each over all that the one before kept."""

from __future__ import annotations

from tidewatch.llm import decontam, langid, mixing, neardup, sharding
from tidewatch.llm.common import documents, stored

#: No SQL: sketches, Viterbi labels and heaps have none.
ORACLE_SQL = None


def identify_languages(spark, docs, sf_dir):
    """Drops documents whose language isn't known, as are null, empty and letterless texts; the columns of documents.

    Texts of any length are judged whole and texts of several known languages stay; null ids are kept and not trained on;
    repeated rows share their fate; columns of any name come back as they were; an empty table stays empty.
    """
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_duplicates(spark, docs, sf_dir):
    """Keeps one document of each group (five-word shingles, similarity 0.8): that of the smallest doc_id, a null one last.

    Rows equal in doc_id and text stay once; rows of one doc_id with different texts are judged by their texts; texts
    without words all stay; an empty table stays empty; columns of any name come back as they were.
    """
    return neardup.one_of_each(docs, words=5, percent=80)


def decontaminate(spark, docs, sf_dir):
    """Drops documents that hold benchmark items; null, empty and word-less texts stay, null ids are judged by their text.

    Repeated rows share their fate; columns of any name come back as they were; an empty table stays empty.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark, docs, sf_dir):
    """All documents, in the order that keeps every prefix within a block of the target weights.

    A null source is a source of its own; rows with null ids or texts and repeated rows have places like any other;
    columns of any name come back as they were; an empty table stays empty.
    """
    return mixing.mixed_order(docs)


def shard(spark, docs, sf_dir):
    """The shard and slot of each document; the slots of a shard follow the rows' places in the files, so the mixing stage's order.

    Rows that aren't read from files have no places: they are mixed and stored first.
    A null text counts as an empty one, equal texts share a shard, repeated rows and null ids are kept; columns of output
    names (size, text_crc32, law, shard, slot, grown_shard) are replaced, all others but text come back as they were; an
    empty table gives an empty result.
    """
    placed = mixing.stored_places(docs, "__place")
    if placed is None:
        placed = mixing.stored_places(stored(mix(spark, docs, sf_dir), "mixed"), "__place")
    return sharding.shard_documents(placed, order_by="__place")


STAGES = [("language_id", identify_languages), ("near_dedup", drop_near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]


def run(spark, sf_dir):
    """All stages over documents, each written and read again."""
    out = documents(spark, sf_dir)
    for name, stage in STAGES:
        out = stored(stage(spark, out, sf_dir), name)
    return out
