"""Comparison of result sets: joins by key priority, model metrics side by side, filters on the comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import has
from tidemark.operators.ranges import union_iou, union_of


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last in order (a column or struct). Lasts combine before their shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_x")).select(key, "_x.*")


def prioritized_lookup(probes: DataFrame, index: DataFrame, id_col: str = "id", keys_col: str = "keys", order_col: str = "ordinal") -> DataFrame:
    """id, hit_at, match: for each probe the index row of its first key that any index row has.

    index: (id, keys, ordinal); a key belongs to the first row that lists it. Both sides are exploded to keys and meet in
    an equi-join; the first hit is an aggregate that combines before its shuffle.
    """
    owner = index.select(F.explode(keys_col).alias("key"), F.struct(order_col, F.col(id_col).alias("match")).alias("o")).groupBy("key").agg(F.min_by("o.match", "o").alias("match"))
    asked = probes.select(F.col(id_col).alias("id"), F.posexplode(keys_col).alias("hit_at", "key"))
    return asked.join(owner, "key").groupBy("id").agg(F.min("hit_at").alias("hit_at"), F.min_by("match", "hit_at").alias("match"))


def lookup_others(rows: DataFrame, id_col: str = "id", keys_col: str = "keys") -> DataFrame:
    """id, hit_at, match: for each row the other row with the smallest id that has its first key that any other row has.

    Each key keeps its two smallest ids, so the pairs of a common key are never made.
    """
    asked = rows.select(F.col(id_col).alias("id"), F.posexplode(keys_col).alias("hit_at", "key"))
    first = asked.groupBy("key").agg(F.min("id").alias("first"))
    second = asked.join(first, "key").where("id != first").groupBy("key").agg(F.min("id").alias("second"))
    found = asked.join(first.join(second, "key"), "key").withColumn("match", F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")))
    return found.groupBy("id").agg(F.min("hit_at").alias("hit_at"), F.min_by("match", "hit_at").alias("match"))


def harmful(intervals: Column) -> Column:
    """Intervals (s, e, b) with a label."""
    return F.filter(intervals, lambda x: x["b"] != 0)


def label_union(intervals: Column) -> Column:
    return F.aggregate(intervals, F.lit(0), lambda a, x: a.bitwiseOR(x["b"]))


def compare_models(bundle: DataFrame) -> DataFrame:
    """bundle (key, left, right, gt: arrays of (s, e, b)) with union IoU and label bits of both models, and what differs.

    Only labelled intervals count. fp and fn are label bits.
    """
    c = F.col
    rows = bundle.select("key", *[harmful(c(x)).alias(x) for x in ("left", "right", "gt")])
    rows = rows.select("*", *[union_of(c(x)).alias(f"{x}_u") for x in ("left", "right", "gt")], *[label_union(c(x)).alias(f"{x}_b") for x in ("left", "right", "gt")])
    rows = rows.select("key", *[F.size(x).alias(f"n_{x}") for x in ("left", "right", "gt")], "left_b", "right_b", "gt_b",
                       *[union_iou(c(f"{x}_u"), c("gt_u")).alias(f"{x}_iou") for x in ("left", "right")])
    return rows.withColumns(
        {
            "iou_gap": F.abs(c("left_iou") - c("right_iou")), "label_mismatch": c("left_b") != c("right_b"),
            "left_fp": F.expr("left_b & ~gt_b"), "left_fn": F.expr("gt_b & ~left_b"),
            "right_fp": F.expr("right_b & ~gt_b"), "right_fn": F.expr("gt_b & ~right_b"),
            "left_exact": c("left_b") == c("gt_b"), "right_exact": c("right_b") == c("gt_b"),
        }
    )


def rank_items(compared: DataFrame) -> DataFrame:
    """Most intervals first, then by key."""
    return compared.orderBy(F.desc(F.greatest("n_left", "n_right", "n_gt")), "key")


def filter_items(
    compared: DataFrame, parents: Sequence[str] | None = None, mismatch_only: bool = False, min_gap: float = 0.0, with_intervals: bool = False, hide_marked: bool = False
) -> DataFrame:
    """The rows that all filters keep; an empty list of parents keeps none, None keeps all."""
    out = compared.where(~F.col("marked")) if hide_marked else compared
    if parents is not None:
        out = out.where(F.col("parent").isin(list(parents)) if parents else F.lit(False))
    if mismatch_only:
        out = out.where("label_mismatch")
    if min_gap > 0:
        out = out.where(F.col("iou_gap") >= min_gap)
    return out.where("n_left + n_right + n_gt > 0") if with_intervals else out


def model_summary(compared: DataFrame, side: str, labels: int = 6, digits: int = 6) -> DataFrame:
    """One row: mean union IoU, accuracy by label (acc_1, ...), exact matches and the count; zeros for no rows."""
    same = [F.coalesce(F.avg((has(F.col(f"{side}_b"), j) == has(F.col("gt_b"), j)).cast("double")), F.lit(0.0)) for j in range(labels)]
    return compared.agg(
        F.round(F.coalesce(F.avg(f"{side}_iou"), F.lit(0.0)), digits).alias("mean_iou"),
        *[F.round(x, digits).alias(f"acc_{j + 1}") for j, x in enumerate(same)],
        F.round(F.coalesce(F.avg(F.col(f"{side}_exact").cast("double")), F.lit(0.0)), digits).alias("exact"),
        F.count("*").alias("n"),
    )


def ground_truth_choice(external: Column, embedded: Column) -> tuple[Column, Column]:
    """(intervals, source): external ones unless they are none. The source is external wherever an external record was met and any list is left."""
    chosen = F.when(F.coalesce(F.size(external), F.lit(0)) > 0, external).otherwise(embedded)
    return chosen, F.when(external.isNotNull() & (F.size(chosen) > 0), "external").otherwise("embedded")
