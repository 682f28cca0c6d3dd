"""A training corpus in five stages: quality rules, near-dedup, suffix dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one works on what it wrote. All but the last
return the columns of documents: rejected documents and near copies are gone, repeated bytes are cut out of the texts,
secrets are masked. The last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrank.llm.minhash import keep_one
from facetrank.llm.packing import pack_documents
from facetrank.llm.quality import keep_good
from facetrank.llm.secrets import redact
from facetrank.llm.suffix import remove_repeats
from facetrank.sources.session import cut, table

#: Words of a shingle and least similarity in percent of the near-dedup stage.
SHINGLE, PERCENT = 5, 80
VOCABULARY = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, shingle=SHINGLE, percent=PERCENT)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary=VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL can express the tokenizer's merges; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each over what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
