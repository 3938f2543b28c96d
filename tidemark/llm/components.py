"""Connected components of a large edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: A key that more than one row in so many has is hot; there are fewer hot keys than this number.
SHARES = 1000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), root being the smallest node that it reaches.

    Every round links each node's larger neighbours to its smallest neighbour (large star) and then its smaller ones
    (small star), until no edge changes. The smallest neighbour comes from an aggregate that combines before its
    shuffle. It meets the edges by `meet`, so a node with very many neighbours is never gathered in one task. Each round
    is cut by a checkpoint in the shared folder. Nulls and loops are ignored.
    """
    edges = cut(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _state(edges)
    while before[0]:
        total = 2 * before[0]
        edges = cut(_small_star(_large_star(edges, total), total))
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))


def meet(rows: DataFrame, side: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """rows joined with side on the key. side has one row per key and says in n how many of the total rows have it.

    Hot keys, fewer than SHARES by their count, are broadcast and meet the rows where they lie; the other keys are shuffled. That is said
    by a hint: Spark sizes rows after an explode as if there were as many as before, and would broadcast them through the driver.
    """
    hot = F.col(n) * SHARES > total
    hubs, rest = side.where(hot).drop(n), side.where(~hot).drop(n)
    here = rows.join(F.broadcast(hubs), key)
    there = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(rest.hint("merge"), key)
    return here.unionByName(there)


def _state(edges: DataFrame) -> tuple:
    """Count and checksums of distinct edges: equal for equal edges."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h))).head())


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return meet(both, least, "u", "n", total).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    linked = meet(edges, least, "a", "n", total).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
