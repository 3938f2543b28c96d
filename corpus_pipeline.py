"""From raw documents to packed training sequences: each stage calls one operator and reads what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, packing, quality, simhash
from tidemark.llm.common import scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the weak-label classifier rejects; the model is fitted on this stage's own documents.

    Null and empty texts are rejected, repeated rows are judged alike and all stay or go; an empty table stays empty.
    """
    weights, _ = quality.fit(docs)
    scored = quality.with_quality(docs, weights, into="_tidemark_quality")
    return scored.where(F.col("_tidemark_quality") >= quality.THRESHOLD).drop("_tidemark_quality")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked SimHash fingerprints: the one with the smallest doc_id, rows without one come last.

    Null and empty texts are copies of one another. Of rows that are equal in id and text one stays; an empty table stays empty.
    """
    return simhash.drop_linked(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, within its error budget.

    Null and empty texts and items match nothing; rows are judged each for itself, with or without an id; with an empty
    benchmark all stay.
    """
    found = decontaminate.with_matches(docs, table(spark, sf_dir, "benchmark"), into="_tidemark_matches")
    return found.where(F.size("_tidemark_matches") == 0).drop("_tidemark_matches")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's token ids goes. A null or empty text is one piece of its end id; repeated rows are each packed."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_copies),
    ("decontaminate", drop_leaks),
    ("packing", pack_sequences),
]
#: The stages are models and searches that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
