"""A corpus pipeline: the stages' tables follow one another through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import shared_dir
from lodestone.llm.jaccard import keep_one
from lodestone.llm.language_id import keep_identified, train_language_model
from lodestone.llm.mixing import take_mix
from lodestone.llm.packing import pack_documents
from lodestone.llm.quality import keep_good, train_quality_model
from lodestone.plans.session import ship


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided."""
    return keep_identified(docs, train_language_model(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, by trees fitted to the labelled ones among them."""
    return keep_good(docs, train_quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources with equal shares of as many tokens as there are."""
    return take_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The fitted models and the differencing of the packing are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents of ``sf_dir``; each result is written as Parquet and read back."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{where}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
