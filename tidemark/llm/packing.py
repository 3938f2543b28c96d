"""Best-fit packing of token sequences by bin completion.

Each text becomes ids plus an end id; texts longer than a sequence are cut into whole sequences and a rest. What is
packed is the histogram of piece lengths: at most `capacity` rows, whatever the input. The best-fit packing is the
incumbent. Where it needs more sequences than the lower bound (L2), a depth-first branch-and-bound over whole packings
looks for a better one: it enumerates the undominated fillings around the longest piece left, least waste first, fixes one
as often as its pieces last or fewer times, and takes it back where the waste so far or the bound of the rest leaves no
packing with fewer sequences. It is exhaustive up to STEPS steps; the number of steps bounds the driver's work whatever
the input. `solve` says which packing won and what the bound was; the column packed_by carries it.

The plan (filling, how often, first sequence) says for each length which ranks of its pieces go where. Pieces get their
rank within their length from counts by partition, so no length, however common, is gathered anywhere.

Defined results: a null or empty text is one piece of length 1 (the end id). Repeated rows are packed each for itself; a
null doc_id stays null. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small_batches
from tidemark.llm.tokens import encoder, vocabulary_path

CAPACITY = 4096
END_ID = 1
#: Steps of the search for a better packing; where they run out the best one found so far stands.
STEPS = 200_000
#: The tokenizer's memory here (pieces a generation, characters at once): two workers share an executor with the packing.
HELD, AT_ONCE = 200_000, 2_000_000


class Plan(NamedTuple):
    """fillings: (longest piece first, how many sequences); bound: what no packing can go below; by: whose packing it is."""

    fillings: list[tuple[list[int], int]]
    sequences: int
    bound: int
    by: str


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound L2: for each k, pieces over half a sequence and what pieces of at least k need beyond their gaps."""
    n = np.zeros(capacity + 2, dtype=object if sum(histogram.values()) > 1 << 40 else np.int64)
    for x, c in histogram.items():
        n[x] = c
    pieces, tokens = np.cumsum(n), np.cumsum(n * np.arange(capacity + 2))
    half = capacity // 2
    k = np.arange(half + 1)
    large = pieces[capacity] - pieces[capacity - k]
    middle, middle_tokens = pieces[capacity - k] - pieces[half], tokens[capacity - k] - tokens[half]
    small = tokens[half] - np.where(k > 0, tokens[np.maximum(k, 1) - 1], 0)
    more = -((middle * capacity - middle_tokens - small) // capacity)
    return int(np.max(large + middle + np.maximum(more, 0)))


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Around the longest piece left go the longest that still fit; a filling is repeated as long as its pieces last."""
    counts = {k: v for k, v in histogram.items() if v}
    lengths = sorted(counts)
    out = []
    while lengths:
        room, filling, hi = capacity, Counter(), len(lengths)
        while hi := bisect_right(lengths, room, 0, hi):
            x = lengths[hi - 1]
            filling[x] = min(room // x, counts[x])
            room -= x * filling[x]
            hi -= 1
        out.append((sorted(filling.elements(), reverse=True), take(counts, filling)))
        lengths = [x for x in lengths if x in counts] if any(x not in counts for x in filling) else lengths
    return out


def take(counts: dict[int, int], filling: Counter, times: int | None = None) -> int:
    """Takes the filling's pieces from the counts as often as said, or as they last; returns how often."""
    times = times or min(counts[x] // n for x, n in filling.items())
    for x, n in filling.items():
        counts[x] -= n * times
        if not counts[x]:
            del counts[x]
    return times


def _sums(filling: dict[int, int]) -> int:
    """Bit k is set if some of the filling's pieces sum to k."""
    bits = 1
    for x, n in filling.items():
        step = 1
        while n:
            step = min(step, n)
            bits |= bits << x * step
            n -= step
            step *= 2
    return bits


def dominated(filling: dict[int, int], spare: dict[int, int], waste: int) -> bool:
    """Whether a spare piece could stand in the place of some of the filling's pieces that are together at most as long.

    What then gets free is easier to place, so a packing with the filling is never better (Martello and Toth).
    """
    every = _sums(filling)
    for x in spare:
        bits = _sums({y: n for y, n in filling.items() if y != x}) if x in filling else every
        low = max(1, x - waste)
        if bits >> low & (1 << x - low + 1) - 1:
            return True
    return False


def fillings(counts: dict[int, int], space: int, waste: int, budget: list[int]) -> list[tuple[int, dict[int, int]]]:
    """(waste, {length: how many}) of the undominated fillings of the space that waste no more than said, least waste first.

    Each step of the enumeration takes one from the budget; it ends where the budget does.
    """
    lengths = sorted((x for x in counts if x <= space), reverse=True)
    rest = [0] * (len(lengths) + 1)  # tokens of the lengths from here on
    for i in range(len(lengths) - 1, -1, -1):
        rest[i] = rest[i + 1] + lengths[i] * counts[lengths[i]]
    found: list[tuple[int, dict[int, int]]] = []
    chosen: dict[int, int] = {}

    def search(at: int, room: int) -> None:
        """Each level takes a shorter length, so there are under sqrt(2 * space) + 1 levels."""
        if room <= waste:
            spare = {x: counts[x] - chosen.get(x, 0) for x in lengths if counts[x] > chosen.get(x, 0)}
            if min(spare, default=room + 1) > room and not dominated(chosen, spare, room):
                found.append((room, dict(chosen)))
        for i in range(at, len(lengths)):
            if room - rest[i] > waste or budget[0] <= 0:
                return
            x = lengths[i]
            for n in range(min(room // x, counts[x]), 0, -1):
                budget[0] -= 1
                if budget[0] <= 0:
                    return
                chosen[x] = n
                search(i + 1, room - n * x)
                del chosen[x]

    search(0, space)
    return sorted(found, key=lambda f: (f[0], sorted(f[1], reverse=True)))


def fill(lengths: list[int], counts: dict[int, int], space: int, steps: int = STEPS) -> list[int]:
    """Pieces that fill the space with the least waste found, longest first."""
    found = fillings({x: counts[x] for x in lengths}, space, space, [steps])
    return sorted(Counter(found[0][1]).elements(), reverse=True) if found else []


def complete(histogram: dict[int, int], capacity: int, incumbent: list[tuple[list[int], int]], bound: int, steps: int = STEPS) -> list[tuple[list[int], int]]:
    """Bin completion: the best packing that a depth-first search over fillings finds, at least as good as the incumbent.

    A node fixes the filling around the longest piece left, and how often. It is dropped where the waste so far, or the
    bound of what is left, leaves no packing with fewer sequences than the best one. The search is exhaustive where its
    steps suffice, and ends early at the bound.
    """
    size = lambda p: sum(times for _, times in p)
    best, best_n, budget = incumbent, size(incumbent), [steps]
    counts, total = {k: v for k, v in histogram.items() if v}, sum(k * v for k, v in histogram.items())

    def branches(wasted: int) -> Iterator[tuple[Counter, int, int]]:
        longest = max(counts)
        own = dict(counts)
        take(own, Counter([longest]), 1)
        for waste, made in fillings(own, capacity - longest, (best_n - 1) * capacity - total - wasted, budget):
            filling = Counter(made)
            filling[longest] += 1
            for times in range(min(counts[x] // n for x, n in filling.items()), 0, -1):
                yield filling, times, waste * times

    path: list[tuple[Counter, int, int]] = []
    used = wasted = 0
    stack = [branches(0)] if counts else []
    while stack and budget[0] > 0 and best_n > bound:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                filling, times, waste = path.pop()
                used, wasted = used - times, wasted - waste
                for x, n in filling.items():
                    counts[x] = counts.get(x, 0) + n * times
            continue
        filling, times, waste = step
        budget[0] -= 1
        if wasted + waste > (best_n - 1) * capacity - total:
            continue
        take(counts, filling, times)
        if counts and used + times + lower_bound(counts, capacity) < best_n:
            path.append(step)
            used, wasted = used + times, wasted + waste
            stack.append(branches(wasted))
            continue
        if not counts and used + times < best_n:
            best = [(sorted(f.elements(), reverse=True), t) for f, t, _ in [*path, step]]
            best_n = used + times
        for x, n in filling.items():
            counts[x] = counts.get(x, 0) + n * times
    return best


def solve(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Plan:
    """The best-fit packing is the incumbent. Where it is above the lower bound, bin completion looks for a better one."""
    made, by = best_fit(histogram, capacity), "best fit"
    count = sum(times for _, times in made)
    bound = max(lower_bound(histogram, capacity), -(-sum(k * v for k, v in histogram.items()) // capacity))
    if count > bound:
        better = complete(histogram, capacity, made, bound, steps)
        if better is not made:
            made, by, count = better, "bin completion", sum(times for _, times in better)
    return Plan(made, count, bound, by)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(filling with its longest piece first, how many sequences) until the histogram is empty."""
    return solve(histogram, capacity).fillings


def places(plans: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of pieces, in rank order."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    first = 0
    for filling, times in plans:
        offset = 0
        for x in filling:
            runs.setdefault(x, []).append((taken[x], first, offset))
            taken[x] += times
            offset += x
        first += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


PIECE = "_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def cut_pieces(documents: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece, with the partition it was made in and its rank among that partition's pieces of its length."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, own = TaskContext.get().partitionId(), Counter(), encoder(path, HELD, AT_ONCE)
        for batch in batches:
            out = []
            for doc, coded in zip(batch.column(0).to_pylist(), own.encode_all(batch.column(1).to_pylist()), strict=True):
                ids = coded + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    length = len(piece) // 4
                    out.append((doc, n, at // 4, length, zlib.crc32(piece), part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                names=["_id", "piece", "start", "length", "ids_crc32", "part", "local"],
            )

    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, PIECE)


def pack(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
    steps: int = STEPS,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, packed_by, above_bound: one row per piece.

    packed_by says which packing won, above_bound how many sequences more than the lower bound it has (0: it is best); steps
    bounds the search for a better one.
    """
    spark = documents.sparkSession
    small_batches(spark)
    pieces = cut(cut_pieces(documents, id_col, text_col, vocabulary or vocabulary_path(), capacity, end_id))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    best = solve(histogram, capacity, steps)
    shared = spark.sparkContext.broadcast(places(best.fillings))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        made = np.zeros((len(lengths), 2), dtype=np.int64)
        n, r = lengths.to_numpy(), ranks.to_numpy()
        for x in np.unique(n):
            first, sequence, offset = shared.value[int(x)]
            at = np.flatnonzero(n == x)
            run = np.searchsorted(first, r[at], side="right") - 1
            made[at, 0], made[at, 1] = sequence[run] + r[at] - first[run], offset[run]
        return pd.DataFrame(made, columns=["sequence_id", "offset"])

    ranked = pieces.join(bases, ["length", "part"]).withColumn("at", place("length", F.col("base") + F.col("local")))
    return ranked.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", F.lit(best.by).alias("packed_by"), F.lit(best.sequences - best.bound).cast("long").alias("above_bound"))
