"""The queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from facetrank.llm.oracle import ORACLE
from facetrank.sources.session import table

__all__ = ["ORACLE", "QUERIES"]


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facetrank.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facetrank.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("host_rate")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facetrank.llm.secrets import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facetrank.llm.urls import url_filter

    return url_filter(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facetrank.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary="piece_bpe_32k.model")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facetrank.llm.sharding import SHARDS, assign

    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return assign(docs, "doc_id", [f"shard-{i:03d}" for i in range(SHARDS)])


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facetrank.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), ranks="byte_bpe_multi_50k.tiktoken", with_ids=False)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facetrank.llm.suffix import repeat_report

    return repeat_report(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facetrank.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facetrank.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary="word_bpe_49k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_url_filter": op2_url_filter,
    "op3_token_counts": op3_token_counts,
    "op4_sharding": op4_sharding,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
}
