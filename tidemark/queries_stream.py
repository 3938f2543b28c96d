"""Queries on streams: events arrive in files, records are scored when they are complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import oracle as sql
from tidemark.checkpoints import scratch
from tidemark.registry import query
from tidemark.sources.events import segments
from tidemark.streaming import live

FILES = 20


def arriving(spark: SparkSession, sf_dir: str, per_batch: int = 4) -> DataFrame:
    """All segments as a stream of files, with the number of rows that their record has."""
    path = scratch(spark, "arriving")
    rows = segments(spark, sf_dir, "ts")
    rows = rows.join(rows.groupBy("rec_id").agg(F.count("*").alias("expected")), "rec_id")
    rows.select("rec_id", "gt", "i", "s", "e", "b", "expected", "ts").repartition(FILES, F.col("i")).write.parquet(path)
    return spark.readStream.schema("rec_id long, gt boolean, i long, s double, e double, b int, expected long, ts timestamp").option("maxFilesPerTrigger", per_batch).parquet(path)


@query(sql.record_rows((0.3, 0.5), "strict"))
def streamed_record_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose segments come in several batches, each scored once."""
    out = scratch(spark, "streamed")
    live.write_whole_records(arriving(spark, sf_dir), out, scratch(spark, "stream-state"), (0.3, 0.5)).awaitTermination()
    return spark.read.parquet(out).select("tau", "rec_id", *sql.WHOLE, *[F.round(c, 6).alias(c) for c in sql.REAL])
