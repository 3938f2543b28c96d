"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and their white space is made single spaces. A test item of m characters has an error budget of
floor(ERRORS * m) edits and is cut into budget + 1 pieces: if a passage is within the budget, at least one piece stands
in it unchanged. An Aho-Corasick automaton finds all exact piece hits in one pass over a text; around each hit, Myers'
bit-parallel algorithm computes the smallest edit distance between the item and any passage there.

Items reach the tasks in blocks of at most BLOCK_CHARS characters (by their hash), each block in its own pass over the
texts, so the broadcast is bounded however many items there are. Texts are never shuffled.

Defined results: null and empty texts match nothing; null and empty items (after normalizing) are ignored; items with
equal texts are each reported. Repeated rows are matched each for itself and a null doc_id stays null. Empty tables on
either side give no matches. Other columns are kept untouched by `with_matches`. A text of any length is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches

ERRORS = 0.06
BLOCK_CHARS = 4_000_000
MATCH = T.ArrayType(
    T.StructType(
        [T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("end", T.LongType())]
    )
)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[str, int]]:
    """(piece, place) of budget + 1 pieces of nearly equal length that cover the item."""
    n, k = len(item), min(budget + 1, len(item))
    cuts = [n * i // k for i in range(k + 1)]
    return [(item[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str) -> tuple[int, int]:
    """(smallest distance of item to a passage of text, end of the first such passage), bit-parallel over the item."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a passage may start anywhere: no cost in row zero
        mv = ph & xv
        pv = (mh << 1 & full) | ~(xv | ph) & full
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], errors: float) -> None:
        self.items = [(i, t, int(errors * len(t))) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, budget) in enumerate(self.items):
            for piece, at in pieces(t, budget):
                places.setdefault(piece, []).append((n, at))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def match(self, raw: str | None) -> list[dict]:
        """One entry per item that the text holds within its budget: the best distance and where that passage ends."""
        text = normal(raw)
        if not text or not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for n, at in where:
                _, item, budget = self.items[n]
                start = end + 1 - length - at - budget
                stop = start + len(item) + 2 * budget
                own = windows.setdefault(n, [])
                for w in reversed(own):  # hits come in the order of their ends: windows overlap the latest ones
                    if start <= w[1] and stop >= w[0]:
                        w[0], w[1] = min(w[0], start), max(w[1], stop)
                        break
                    if w[1] < start:
                        own.append([start, stop])
                        break
                else:
                    own.append([start, stop])
        found = []
        for n, own in windows.items():
            item_id, item, budget = self.items[n]
            best, end = budget + 1, 0
            for a, b in own:
                a = max(0, a)
                part = text[a:b]
                at = part.find(item)
                d, e = (0, at + len(item)) if at >= 0 else myers(item, part)
                if d < best:
                    best, end = d, a + e
                if best == 0:
                    break
            if best <= budget:
                found.append({"item_id": item_id, "distance": best, "end": end})
        return sorted(found, key=lambda x: (x["item_id"] is None, x["item_id"]))


_held: dict = {}  # the matcher of the block that this worker process matches now


def _matches(block: list[tuple[int, str]], errors: float, sc) -> F:
    shared = sc.broadcast(block)

    @F.pandas_udf(MATCH)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = (id(shared.value), errors)
        if _held.get("key") != key:
            _held.update(key=key, items=shared.value, matcher=Matcher(shared.value, errors))
        for batch in texts:
            yield pd.Series([_held["matcher"].match(t) for t in batch], dtype=object)

    return run


def with_matches(
    documents: DataFrame, benchmark: DataFrame, errors: float = ERRORS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", into: str = "matches"
) -> DataFrame:
    """documents with one more column: array of (item_id, distance, end in the normalized text)."""
    spark = documents.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text_col}`").cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.length("t"))).head()[0] or 0
    blocks = int(total // (BLOCK_CHARS // 2)) + 1
    found: Column = F.array().cast(MATCH)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    for b in range(blocks):
        held = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        block = sorted(((r.i, t) for r in held if (t := normal(r.t))), key=lambda x: (x[1], x[0] is None, x[0]))
        if block:
            found = F.concat(found, _matches(block, errors, spark.sparkContext)(text)) if b else _matches(block, errors, spark.sparkContext)(text)
    return documents.withColumn(into, found)


def find_contamination(documents: DataFrame, benchmark: DataFrame, errors: float = ERRORS, id_col: str = "doc_id") -> DataFrame:
    """doc_id, item_id, distance, end_char: one row per document and item that it holds."""
    rows = documents.select(F.col(f"`{id_col}`").alias(id_col), "text")
    hits = with_matches(rows, benchmark, errors).select(id_col, F.explode("matches").alias("m"))
    return hits.select(id_col, F.col("m.item_id").alias("item_id"), F.col("m.distance").alias("distance"), F.col("m.end").alias("end_char"))
