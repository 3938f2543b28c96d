"""Plans for work outside the engine: which clips to render, which frames to take, which runs to make.

The tables hold durations as columns; what renders, decodes or infers reads a plan table and writes results that later
queries join. `infer` is the hook for a model: it maps batches of a plan through a callable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import frame_index, frame_times, inserted_intervals, insertion_start


def frame_plan(videos: DataFrame, id_col: str, duration: str, fps: str | float = 1.0) -> DataFrame:
    """id, n, t, frame: the frames to take at one a second."""
    rate = F.col(fps) if isinstance(fps, str) else F.lit(float(fps))
    rows = videos.select(F.col(id_col).alias(id_col), F.col(duration).alias("_d"), rate.alias("_fps"), F.posexplode(frame_times(F.col(duration))).alias("n", "t"))
    return rows.select(id_col, F.col("n").cast("long").alias("n"), "t", frame_index(F.col("t"), F.col("_fps"), F.floor(F.col("_d") * F.col("_fps")).cast("long")).alias("frame"))


def insertion_plan(pairs: DataFrame, id_col: str, limit: float = 60.0, seed: int = 7) -> DataFrame:
    """id, start, total, intervals: where a harmful clip goes into a safe one. pairs: safe, harmful (seconds), b (label bits)."""
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rows = pairs.withColumn("start", insertion_start(F.col("safe"), F.col("harmful"), limit, unit))
    rows = rows.withColumn("total", F.least(F.lit(float(limit)), F.col("safe") + F.col("harmful")))
    return rows.withColumn("intervals", inserted_intervals(F.col("start"), F.col("harmful"), F.col("total"), F.col("b")))


def run_matrix(models: DataFrame, datasets: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """model, dataset of every run to make, but those whose outputs exist. Both sides are lists of names."""
    every = models.select("model").join(datasets.select("dataset"), F.lit(True))
    return every if done is None else every.join(done, ["model", "dataset"], "left_anti")


def infer(plan: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The plan's batches through a callable that asks a model; a failed task asks again for its rows only."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield run(batch)

    return plan.mapInPandas(each, schema)


def retry(first: DataFrame, second: DataFrame, id_col: str, ok: str = "parse_ok") -> DataFrame:
    """The first answer where it parsed, else the second, with retried."""
    two = second.select(F.col(id_col), F.struct(*[c for c in second.columns if c != id_col]).alias("_s"))
    cols = [c for c in first.columns if c != id_col]
    rows = first.join(two, id_col, "left").withColumn("retried", ~F.col(ok) & F.col("_s").isNotNull())
    return rows.select(id_col, *[F.when(F.col("retried"), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in cols], "retried")


def answer_counts(answers: DataFrame, ok: str = "parse_ok", retried: str = "retried") -> DataFrame:
    """One row: how many answers there are, how many don't parse, and how many were asked for twice."""
    return answers.agg(F.count("*").alias("n"), F.count_if(~F.col(ok)).alias("n_parse_errors"), F.count_if(retried).alias("n_retried"))


def clip_plan(safe: DataFrame, id_col: str, length: float, seed: int = 7) -> DataFrame:
    """id, start: where a clip of the length begins in a safe video (duration): a seeded uniform start, 0 in a shorter one."""
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return safe.select(id_col, (F.greatest(F.col("duration") - length, F.lit(0.0)) * unit).alias("start"))
