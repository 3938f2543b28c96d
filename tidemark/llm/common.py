"""Helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoints import cut, scratch, shared_dir

__all__ = ["ascii_lower", "cut", "let", "partitions", "scratch", "shared_dir", "small_batches", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once per row, however often body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps Arrow batches of long texts small: Python holds at most so many rows at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))

