"""Preparing a dataset by plan: safe recordings get clips inserted, and plans whose sample doesn't come out as planned are drawn again.

Every round draws for all open plans at once, by hashes of (sample, attempt), which any engine can repeat: a safe recording, places on
the time grid, and a clip for each planned label, found by its number in an equi-join. Accepted samples are written, and an
anti-join leaves the rejected ones for the next round; a checkpoint cuts each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.checkpoints import cut, scratch
from tidemark.functions import intervals
from tidemark.operators import curate

ATTEMPTS = 50
SEGMENT = "array<struct<start:double,end:double,label:string,clip:bigint,at:double>>"


def number(what: str | Column, seed: int, most: Column) -> Column:
    """1 to most, drawn by sample, attempt and what for."""
    said = F.concat_ws(":", F.col("sample").cast("string"), F.col("attempt").cast("string"), F.lit(what) if isinstance(what, str) else what.cast("string"), F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long"), most) + 1


def draw(open_: DataFrame, pool: DataFrame, safe: DataFrame, base: float, step: float, longest: float, seed: int) -> DataFrame:
    """What an attempt makes of each open plan (sample, labels, attempt): recording, seconds, segments that are left, and whether it is as planned."""
    of_label = pool.groupBy("label").agg(F.max("cnt").alias("most"))
    n_safe = safe.agg(F.coalesce(F.max("cnt"), F.lit(1)).alias("n_safe"))
    asked = open_.join(F.broadcast(n_safe), F.lit(True)).withColumn("rn", number("safe", seed, F.col("n_safe"))).join(safe.select("rn", "recording", "length"), "rn", "left")
    lost = F.raise_error(F.lit("there is no safe recording to draw from")).cast("long")
    asked = asked.withColumns({"recording": F.coalesce("recording", lost), "own": F.least(F.lit(float(base)), F.col("length"))}).drop("rn", "n_safe")
    places = intervals.grid_positions(F.col("own"), F.size("labels"), step, F.concat_ws(":", F.col("sample").cast("string"), F.col("attempt").cast("string")))
    each = asked.withColumn("places", places).select("sample", "attempt", "own", "places", F.posexplode("labels").alias("j", "label"))
    each = each.join(of_label, "label", "left").withColumn("rn", number(F.col("j"), seed, F.coalesce("most", F.lit(1))))
    found = each.join(pool.select("label", "rn", "clip", "duration"), ["label", "rn"], "left")
    none = F.raise_error(F.concat(F.lit("no clips of label "), F.col("label"))).cast("long")
    found = found.select("sample", "own", "label", F.coalesce("clip", none).alias("clip"), F.col("duration").alias("length"), F.get("places", F.col("j")).alias("at"))
    laid = curate.shifted(found, "sample").withColumn("total", F.least(F.lit(float(longest)), F.col("own") + F.sum("length").over(Window.partitionBy("sample"))))
    s, e = intervals.snap_interval(F.col("start"), F.col("start") + F.col("length"), F.col("total"), step, "nearest", "ceil")
    kept = laid.select("sample", "total", "label", "clip", "at", s.alias("s"), e.alias("e"))
    one = F.when(F.col("e") > F.col("s"), F.struct(F.col("s").alias("start"), F.col("e").alias("end"), "label", "clip", "at"))
    made = kept.groupBy("sample").agg(F.array_sort(F.collect_list(one)).alias("segments"), F.max("total").alias("total"))
    rows = asked.join(made, "sample", "left").withColumns({"segments": F.coalesce("segments", F.array().cast(SEGMENT)), "seconds": F.coalesce("total", F.least(F.col("own"), F.lit(float(longest))))})
    labels_left = F.array_sort(F.array_distinct(F.transform("segments", lambda x: x["label"])))
    planned = (F.size("segments") == F.size("labels")) & (labels_left == F.array_sort(F.array_distinct("labels")))
    return rows.select("sample", "labels", "attempt", "recording", "seconds", "segments", planned.alias("as_planned"))


def prepare(
    plans: DataFrame, pool: DataFrame, safe: DataFrame, base: float = 60.0, step: float = 0.5, longest: float = 64.0, seed: int = 7, attempts: int = ATTEMPTS
) -> DataFrame:
    """sample, labels, attempt, recording, seconds, segments of every plan (sample, labels).

    pool: clip, label, duration. safe: recording, length. base: seconds of a safe recording that are used; step: the time grid;
    longest: seconds after which a sample is cut, so what lies beyond is lost and its plan is drawn again. Raises if a plan isn't met after
    `attempts` rounds.
    """
    clips = cut(curate.ranked(pool, "label", "clip", seed))
    safe = cut(curate.ranked(safe.withColumn("_all", F.lit(0)), "_all", "recording", seed).drop("_all"))
    open_, out = cut(plans.select("sample", "labels")), scratch(plans.sparkSession, "samples")
    for attempt in range(1, attempts + 1):
        tried = cut(draw(open_.withColumn("attempt", F.lit(attempt)), clips, safe, base, step, longest, seed))
        tried.where("as_planned").drop("as_planned").write.mode("append").parquet(out)
        open_ = cut(tried.where(~F.col("as_planned")).select("sample", "labels"))
        if open_.isEmpty():
            return plans.sparkSession.read.parquet(out)
    raise ValueError(f"no valid sample after {attempts} attempts for {open_.head(1)}")


def balance(samples: DataFrame, plans: DataFrame) -> DataFrame:
    """what, expected, actual: samples by number of labels, and segments by label, of the plans and of the samples made; raises when run if they differ."""
    counts = lambda df, labels: df.select(F.explode(F.concat(F.array(F.concat(F.lit("labels: "), F.size("labels").cast("string"))), F.transform(labels, lambda x: F.concat(F.lit("segments: "), x)))).alias("what"))
    return curate.assert_balanced(counts(samples, F.transform("segments", lambda x: x["label"])), counts(plans, F.col("labels")), "what")
