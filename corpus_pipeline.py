"""The corpus pipeline: quality, exact and near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as
the next one's docs. All but the last return the columns of their docs. The first stage reads
the labels table beside the documents; nothing else is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoalcount.llm import bpe, exact_dedup, mixing, quality_lm, simhash
from shoalcount.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier does not reject."""
    return quality_lm.survivors(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest doc_id."""
    return exact_dedup.survivors(docs, exact_dedup.fresh_index(spark))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the smallest doc_id."""
    return simhash.survivors(docs, words=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule of their sources."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests per document."""
    return bpe.encode(docs, bpe.production_file())


STAGES = [("quality", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mix), ("BPE", tokens)]

#: The classifier and the fingerprints are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result stored for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
