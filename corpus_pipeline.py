"""Corpus pipeline: quality rules, quality classifier, exact and near deduplication, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's
docs. Null texts, empty texts, ties, repeated rows, empty tables and extra columns are as each operator defines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rippleframe.llm import exact_dedup, near_dedup, ordinal_quality, packing, quality_rules
from rippleframe.llm.common import shared_dir, table, written
from rippleframe.llm.queries import tokenizer_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what fails the base rules or lies outside its language's perplexity band."""
    return quality_rules.keep(spark, docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is likely toxic or of low quality, by the ratings in labels."""
    ratings = ordinal_quality.grades_of(table(spark, sf_dir, "labels"))
    found = ordinal_quality.classify(spark, docs, ratings, ordinal_quality.N_GRADES)
    return found.where("kept").select("doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.keep_one(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity of 0.8), the document with the least doc_id stays."""
    return near_dedup.keep_one(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 ids."""
    return packing.pack(spark, docs, tokenizer_path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("exact_dedup", exact),
    ("minhash_dedup", near),
    ("packing", pack),
]

#: The perplexity model, the fitted classifier and the tokenizer's ids can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    scratch = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(spark, docs, f"{scratch}/{k}-{name}")
    return docs
