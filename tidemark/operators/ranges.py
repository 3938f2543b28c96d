"""Operators on sets of time ranges: union, overlap of unions, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.checkpoints import cut
from tidemark.operators import sizes


def merged(ranges: DataFrame, *keys: str, limit: int = sizes.LIMIT) -> DataFrame:
    """keys, s, e of the union of each key's ranges; empty ranges go, touching ones merge.

    Of ranges that start alike only the longest counts. Keys of few starts are one window each; keys of many are scanned in range
    partitions (`sizes.running`), so no task holds one.
    """
    rows = ranges.where("e > s").groupBy(*keys, "s").agg(F.max("e").alias("e"))
    small, large = sizes.split(rows, *keys, limit=limit)
    order = Window.partitionBy(*keys).orderBy("s")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = small.withColumn("island", F.max(F.when(reach.isNull() | (F.col("s") > reach), F.col("s"))).over(order))
    if large is not None:
        parts = sizes.running(sizes.dealt(large, list(keys), "s"), list(keys), "s", reach=(F.max, F.col("e"), False))
        begins = F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach")), F.col("s"))
        fresh = fresh.unionByName(sizes.running(cut(parts), list(keys), "s", island=(F.max, begins, True)).select(*keys, "s", "e", "island"))
    return fresh.groupBy(*keys, "island").agg(F.max("e").alias("e")).withColumnRenamed("island", "s")


def shared(ranges: DataFrame, *keys: str, side: str = "gt", limit: int = sizes.LIMIT) -> DataFrame:
    """keys, n_a, n_b, a, b, both: number and length of the unions of each key's two sides (side true or false), and of their overlap.

    A sweep over the unions' ends: how many of either side are open is a running sum, and the time until the next end counts where
    both are. Linear in the ranges. A key without non-empty ranges has zeros.
    """
    unions = cut(merged(ranges, *keys, side, limit=limit))
    length = F.col("e") - F.col("s")
    sums = unions.groupBy(*keys).agg(*[x for n, c in (("a", F.col(side)), ("b", ~F.col(side))) for x in (F.count_if(c).alias(f"n_{n}"), F.sum(F.when(c, length).otherwise(0.0)).alias(n))])
    ends = unions.select(*keys, side, F.explode(F.array(*[F.struct(F.col(c).alias("at"), F.lit(by).alias("by")) for c, by in (("s", 1), ("e", -1))])).alias("x"))
    ends = ends.groupBy(*keys, F.col("x.at").alias("at")).agg(*[F.sum(F.when(c, F.col("x.by")).otherwise(0)).alias(f"d{n}") for n, c in (("a", F.col(side)), ("b", ~F.col(side)))])
    small, large = sizes.split(ends, *keys, limit=2 * limit)
    order = Window.partitionBy(*keys).orderBy("at")
    swept = small.select(*keys, "at", F.lead("at").over(order).alias("next"), *[F.sum(f"d{n}").over(order).alias(f"open_{n}") for n in "ab"])
    if large is not None:
        parts = sizes.following(sizes.dealt(large, list(keys), "at"), list(keys), "at", "next")
        parts = sizes.running(cut(parts), list(keys), "at", open_a=(F.sum, F.col("da"), True), open_b=(F.sum, F.col("db"), True))
        swept = swept.unionByName(parts.select(*swept.columns))
    both = swept.where("open_a > 0 and open_b > 0").groupBy(*keys).agg(F.sum(F.col("next") - F.col("at")).alias("both"))
    rows = ranges.select(*keys).distinct()
    for part in (sums, both):
        named = part.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in part.columns if c not in keys])
        rows = rows.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left").drop(*[f"_{k}" for k in keys])
    return rows.na.fill(0, ["n_a", "n_b"]).na.fill(0.0, ["a", "b", "both"])


def shared_iou() -> Column:
    """Overlap over union from the columns of `shared`; 1 if both sides are empty."""
    a, b, both = F.col("a"), F.col("b"), F.col("both")
    whole = a + b - both
    return F.when((F.col("n_a") == 0) & (F.col("n_b") == 0), 1.0).when(whole <= 0, 0.0).otherwise(both / whole)


def union_of(ranges: Column) -> Column:
    """The union of an array of (s, e), as an array in order."""
    pair = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    plain = F.array_sort(F.filter(F.transform(ranges, lambda r: pair(r["s"], r["e"])), lambda r: r["e"] > r["s"]))

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(pair(last["s"], F.greatest(last["e"], r["e"]))))
        return F.when((F.size(done) > 0) & (r["s"] <= F.try_element_at(done, F.lit(-1))["e"]), grown).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(plain, F.array().cast("array<struct<s:double,e:double>>"), add)


def duration(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0.0), lambda a, r: a + F.greatest(F.lit(0.0), r["e"] - r["s"]))


def intersection(a: Column, b: Column) -> Column:
    """Total overlap of two unions."""
    overlap = lambda x, y: F.greatest(F.lit(0.0), F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"]))
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + F.aggregate(b, F.lit(0.0), lambda u, y: u + overlap(x, y)))


def union_iou(a: Column, b: Column) -> Column:
    """Overlap over union of two unions; 1 if both are empty."""
    inter = intersection(a, b)
    whole = duration(a) + duration(b) - inter
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(whole <= 0, 0.0).otherwise(inter / whole)


def coverage(shots: DataFrame, key: str, duration_col: str, max_gap: float = 5.0, tolerance: float = 1e-6) -> DataFrame:
    """key, covered: whether the ordered shots (s, e, i) cover the duration without overlap and without large gaps."""
    order = Window.partitionBy(key).orderBy("s", "e", "i")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("s") - reach
    ok = F.when(reach.isNull(), F.col("s") <= max_gap).otherwise((gap >= 0) & (gap <= max_gap))
    rows = shots.withColumn("ok", ok)
    tail = F.greatest(F.lit(0.0), F.max(duration_col) - F.max_by("e", F.struct("s", "e", "i")))
    return rows.groupBy(key).agg((F.bool_and("ok") & (tail <= max_gap + tolerance)).alias("covered"))
