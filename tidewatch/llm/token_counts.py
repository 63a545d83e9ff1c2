"""Token counts through a digest cache.

Each text's normalised content (null becomes empty; nothing else, as every byte can change a count) is digested. Digest
and tokenizer version are joined to the stored counts; only distinct misses are encoded, and their counts are appended
to the cache, a Parquet table. A digest that is stored twice (by runs that overlapped) counts once. Whole texts are
encoded, without truncation or added special tokens.

The cache is asked with digests alone. Of the missing ones a bitmap of fixed size is made, which picks their texts where
they lie; only these are shuffled, to encode each once. With a warm cache no text moves. ``compacted`` rewrites a cache of
many small files.

Defined results: null or empty text has the count the tokenizer gives '' (0); repeated rows and ties share one cache
row; null doc_id is kept as it is; extra columns stay unless they bear an output name, which is replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, stored
from .neardup import Places

CACHE = T.StructType([T.StructField("content_digest", T.BinaryType()), T.StructField("tokenizer_digest", T.StringType()), T.StructField("n_tokens", T.LongType())])
#: Texts are handed to the tokenizer in groups of about this many characters, so that the lists of ids stay small.
GROUP_CHARS = 1 << 20


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file, with the way it is called."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|plain|").hexdigest()


def load_counter(path: str):
    """A function from a list of texts to their token counts, by the library that the file's ending names."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
    raise ValueError(f"no library for {path}")


def _encode(path: str):
    def run(batches):
        count = load_counter(path)
        for batch in batches:
            texts, counts, group, size = batch.column("text"), [], [], 0
            for value in texts:
                text = value.as_py() or ""
                group.append(text)
                size += len(text)
                if size >= GROUP_CHARS:
                    counts += count(group)
                    group, size = [], 0
            counts += count(group) if group else []
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array(counts, pa.int64())], ["content_digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 4096) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit. ``cache`` is the folder of the count table; it is made if it is missing."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    bounded_batches(spark)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    known = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer_digest") == version).select("content_digest")
    missing = stored(docs.select(digest.alias("content_digest")).distinct().join(known, "content_digest", "left_anti"), "missing-digests")
    texts = docs.select(digest.alias("content_digest"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    maybe = Places(missing, "content_digest").flagged(texts, "content_digest", "maybe").where("maybe").drop("maybe")
    misses = maybe.dropDuplicates(["content_digest"]).join(missing, "content_digest", "left_semi")
    new = misses.mapInArrow(_encode(tokenizer), "content_digest binary, n_tokens long")
    new.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    stored_counts = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer_digest") == version)
    counts = stored_counts.groupBy(F.col("content_digest").alias("__digest")).agg(F.min("n_tokens").alias("__n"))
    keyed = docs.drop("n_bytes", "n_tokens", "over_limit").withColumn("n_bytes", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")).withColumn("__key", digest).drop("text")
    return keyed.join(counts, F.col("__key") == F.col("__digest")).drop("__key", "__digest").withColumnRenamed("__n", "n_tokens").withColumn("over_limit", F.col("n_tokens") > limit)


def compacted(spark: SparkSession, cache: str, into: str) -> None:
    """The counts of a cache, each digest once, in few files of a new folder ``into``."""
    rows = spark.read.schema(CACHE).parquet(cache).groupBy("content_digest", "tokenizer_digest").agg(F.min("n_tokens").alias("n_tokens"))
    rows.repartition(F.col("content_digest")).write.parquet(into)
