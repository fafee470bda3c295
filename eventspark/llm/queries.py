"""The operators over their whole tables with production parameters, and SQL that gives the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.llm import (
    backoff_lm,
    bpe_fst,
    chat,
    embedding_tiles,
    line_dedup,
    minhash_forest,
    packing,
    quality_rules,
    spelling,
    url_filter,
    vector_codes,
    warc,
    weak_quality,
)

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CHAT_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_fst.digests(_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op3_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.scores(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.without_boilerplate(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(turns, CHAT_BPE), CHAT_BPE)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.resolve(warc.captures(_table(spark, sf_dir, "pages"))))


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), WORD_BPE)


def op10_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_tiles.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, url_filter.RULES, url_filter.listed_domains(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op12_spelling_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_pivot_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.product_codes(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_forest,
        op2_byte_bpe,
        op3_backoff_lm,
        op4_quality_rules,
        op5_line_dedup,
        op6_weak_quality,
        op7_chat_format,
        op8_warc_revisits,
        op9_best_two_fit,
        op10_embedding_tiles,
        op11_bloom_cascade,
        op12_spelling_tiles,
        op13_pivot_codes,
    )
}
ORACLES: dict[str, str] = {
    "op4_quality_rules": quality_rules.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op8_warc_revisits": warc.SQL,
    "op11_bloom_cascade": url_filter.SQL,
}
