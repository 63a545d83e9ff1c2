"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontam, langid, linededup, mixing, neardup, phrases, quality, repair, secretscan, sharding, token_counts, warc
from .common import documents, scratch_path


def op1_line_dedup(spark, sf_dir):
    out = linededup.remove_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("clean_md5"))


def op2_token_counts(spark, sf_dir):
    import public_tokenizers

    docs, tokenizer, cache = documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "token-cache")
    # An earlier run over about half of the texts fills the cache, so that the run over all of them finds counts in it.
    token_counts.count_tokens(docs.where(F.col("text") < F.lit("I")), tokenizer, cache)
    out = token_counts.count_tokens(docs, tokenizer, cache)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(documents(spark, sf_dir), words=2, percent=80)


def op4_chat_formatting(spark, sf_dir):
    return chat.digests(chat.format_preferences(chat.neighbour_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op5_mixing(spark, sf_dir):
    return mixing.mix_sources(documents(spark, sf_dir).select("doc_id", "source"))


def op6_decontamination(spark, sf_dir):
    return decontam.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_sharding(spark, sf_dir):
    out = sharding.shard_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op9_warc(spark, sf_dir):
    out = warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark, sf_dir):
    return quality.quality_rules(documents(spark, sf_dir))


def op11_phrases(spark, sf_dir):
    return phrases.collocations(documents(spark, sf_dir))


def op12_secret_scan(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return secretscan.digests(secretscan.scan(docs, secretscan.train(docs)))


def op13_repair(spark, sf_dir):
    return repair.repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_near_duplicates, op4_chat_formatting, op5_mixing, op6_decontamination, op7_sharding, op8_language_id, op9_warc, op10_quality_rules, op11_phrases, op12_secret_scan, op13_repair)}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": linededup.SQL, "op4_chat_formatting": chat.SQL, "op9_warc": warc.SQL, "op10_quality_rules": quality.SQL, "op11_phrases": phrases.SQL}
