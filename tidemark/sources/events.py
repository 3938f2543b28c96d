"""Interval records from the event stream: one record per user and week of the month.

Even events are annotated intervals (side gt), odd ones predicted intervals. Labels are a bit mask, bit j - 1 for label j.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ("C1", "C2", "C3", "C4", "C5", "C6")


def segments(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """rec_id, model_id, iter, gt, i (event id), s, e, b (label bits), k, and more columns of the events."""
    day, k = F.dayofmonth("ts") - 1, F.get_json_object("props", "$.k").cast("int")
    week = F.floor(day / 7).cast("long")
    start = ((day % 7) * 1440 + F.hour("ts") * 60 + F.minute("ts")).cast("double") / 60
    one = F.when(k % 3 != 0, F.expr("shiftleft(1, k % 6)")).otherwise(0)
    two = F.when(k % 5 == 0, F.expr("shiftleft(1, (k div 6) % 6)")).otherwise(0)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", k)
    return rows.select(
        (F.col("user_id") * 10 + week).alias("rec_id"),
        (F.col("user_id") % 3).alias("model_id"),
        week.alias("iter"),
        "user_id",
        (F.col("event_id") % 2 == 0).alias("gt"),
        F.col("event_id").alias("i"),
        start.alias("s"),
        (start + F.col("value") / 4).alias("e"),
        one.bitwiseOR(two).alias("b"),
        "k",
        *more,
    )


#: The same as DuckDB SQL, for queries to build on: CTE `seg`.
SQL = """
ev AS (SELECT event_id, user_id, day(ts) - 1 AS d, hour(ts) * 60 + minute(ts) AS m, value, CAST(props->>'$.k' AS INT) AS k FROM events),
seg AS (SELECT user_id * 10 + d // 7 AS rec_id, user_id % 3 AS model_id, d // 7 AS iter, user_id, event_id % 2 = 0 AS gt, event_id AS i,
    CAST((d % 7) * 1440 + m AS DOUBLE) / 60 AS s, CAST((d % 7) * 1440 + m AS DOUBLE) / 60 + value / 4 AS e,
    (CASE WHEN k % 3 <> 0 THEN 1 << (k % 6) ELSE 0 END) | (CASE WHEN k % 5 = 0 THEN 1 << ((k // 6) % 6) ELSE 0 END) AS b, k FROM ev)"""
