"""A training corpus from raw documents: quality, exact and near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. SQL can't express the learned and hashed stages,
so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import bpe, exact_dedup, minhash, mixing, quality
from fieldloom.llm.common import Stage, read

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.classify(spark, docs).where("keep").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.deduplicate(spark, docs).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest id."""
    return minhash.drop_near_duplicates(spark, docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; a source's last one whole or not at all, whichever is nearer to its target."""
    out = mixing.materialise(spark, docs, whole=True)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text, a row for each document of the mix."""
    return bpe.round_trip(spark, docs)


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("mixing", mixed), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on all documents; the last one's result reads the table of the one before it, earlier tables go."""
    stage = Stage(spark, "pipeline")
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage.put(docs, name)
            if before is not None:
                stage.drop(before)
            before = docs
    return docs
