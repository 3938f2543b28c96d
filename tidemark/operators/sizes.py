"""Two routes by size: keys of few rows are gathered, the others stay spread. Both give the same result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.checkpoints import cut

#: Rows of a key up to which it is gathered to one row or window.
LIMIT = 500


def split(rows: DataFrame, *keys: str, limit: int = LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys that at most `limit` rows have, and the others (None if there are none).

    Counts combine before their shuffle. There are fewer large keys than rows / limit; a join finds their rows, by broadcast only if
    they turn out to be few.
    """
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(*[F.col(k).alias(f"_large_{k}") for k in keys])
    if large.isEmpty():
        return rows, None
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in keys])
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def dealt(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows, dealt by range of (keys, order), with part: the number of the range; a key of many rows spans many parts."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *keys, order).withColumn("part", F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: str, **columns: tuple) -> DataFrame:
    """rows (from `dealt`) with running columns over each key in the order: name = (aggregate, column, whether the row itself counts).

    A segmented scan: each part is scanned by itself; what a part begins with, the aggregate over all earlier parts of the key, comes
    from a table of one row for each key and part.
    """
    own = Window.partitionBy("part", *keys).orderBy(order)
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part", *keys).agg(*[aggregate(c).alias(f"_{n}") for n, (aggregate, c, _) in columns.items()])
    begin = totals.select("part", *keys, *[aggregate(f"_{n}").over(earlier).alias(f"_{n}") for n, (aggregate, _, _) in columns.items()])
    begin = begin.select(*[F.col(c).alias(f"_at_{c}") if c == "part" or c in keys else F.col(c) for c in begin.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys], F.col("part") == F.col("_at_part"))
    scanned = rows.withColumns({n: aggregate(c).over(own.rowsBetween(Window.unboundedPreceding, 0 if itself else -1)) for n, (aggregate, c, itself) in columns.items()})
    both = {F.max: F.greatest, F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
    met = scanned.join(begin, same).withColumns({n: both[aggregate](F.col(n), F.col(f"_{n}")) for n, (aggregate, _, _) in columns.items()})
    return met.drop(*[f"_{n}" for n in columns], *[f"_at_{k}" for k in ("part", *keys)])


def following(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """rows (from `dealt`) with the next value of the order column in the key, also across parts; null at the end."""
    firsts = rows.groupBy("part", *keys).agg(F.min(order).alias("_first"))
    after = firsts.select(F.col("part").alias("_at_part"), *[F.col(k).alias(f"_at_{k}") for k in keys], F.lead("_first").over(Window.partitionBy(*keys).orderBy("part")).alias("_next"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys], F.col("part") == F.col("_at_part"))
    own = F.lead(order).over(Window.partitionBy("part", *keys).orderBy(order))
    return rows.withColumn(name, own).join(after, same).withColumn(name, F.coalesce(name, "_next")).drop("_next", "_at_part", *[f"_at_{k}" for k in keys])
