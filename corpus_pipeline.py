"""Corpus pipeline: quality rules, near-duplicate removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of its input, which is the
Parquet output of the stage before it. All stages but the last return the columns of
``documents``.

1. quality_rules: documents that the rules reject go.
2. ngram_jaccard_join: of each group of linked documents the one with the smallest id stays.
   A document id in several rows is one document, and its rows stay or go together; rows with
   a null id stay.
3. secret_scan: secrets become ``[secret]`` and ``n_chars`` follows; no document goes.
4. best_fit_packing: pieces of at most 2048 tokens and their places in sequences.

SQL cannot express the tokenizer, so ORACLE_SQL is None; tests/llm compares the stages with
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm.common import drop, table, written
from netlens.llm.entry_queries import vocabulary
from netlens.llm.ngram_join import ngram_jaccard_join
from netlens.llm.packing import best_fit_packing
from netlens.llm.quality_rules import quality_rules
from netlens.llm.secret_scan import redact_secrets


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs).where("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_jaccard_join(docs, percent=75)
    return docs.join(groups.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs, vocabulary("byte_bpe_50k.json"), end_id=0, most=2048)


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", hide_secrets),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        old, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if old is not given:
            drop(old)
    return STAGES[-1][1](spark, docs, sf_dir)
