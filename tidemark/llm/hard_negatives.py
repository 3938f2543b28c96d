"""Hard negatives by norm-bucketed search: buckets of falling norm, pruned by the Cauchy-Schwarz bound.

Vectors become whole numbers, floor(scale * x) for each component x; a score is the inner product with the anchor, and equal scores
go by smaller id. An anchor's positives are its first rows of the same label. Each positive opens a window of scores, from 80 % of
its own score up to it, and the first rows of other labels in a window are its hard negatives.

How it is spread: candidates are dealt evenly to partitions, sorted there by falling norm, packed into buckets of at most BUCKET
rows and written: an index, read once by each pass. Anchors go in waves of bounded size (WAVE rows, WAVE_BYTES), which are broadcast. A
task goes through its buckets by falling norm and keeps the first k rows of each anchor and window. Against a bucket it takes only
anchors for which |anchor| * (largest norm in the bucket) reaches the window's lower limit and the kth score found so far; no
other row can enter. The tasks' firsts, k for each task and window, are ranked by window in a shuffle. So all rows are searched, but
no pair of rows is ever a row of a table.

Exact: products are summed in 32-bit floats where the largest norms' product is under 2^24, in 64-bit floats under 2^53, else in whole
numbers; scores must fit 64 bits.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part. Rows of one id are one anchor
each, and never an anchor's own positive or negative. Missing components of shorter vectors count as zero, an empty vector scores
zero. Repeated rows count each. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, scratch

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A window reaches from LOW / 100 of the positive's score up to it.
LOW = 80
BUCKET, BLOCK = 2048, 1024
#: Anchors that are broadcast at once, and bytes of their vectors.
WAVE, WAVE_BYTES = 32_768, 64 << 20
LEAST, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
PACKED = "n long, width long, norm double, ids binary, labels binary, vectors binary"
FOUND = "anchor long, slot long, score long, id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: SQL for the query's rows.
ORACLE_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""


def _rows(scale: int):
    """Rows (id, label, vector) to those that take part, with the vector in whole numbers and its norm."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            lengths = np.diff(vectors.offsets.to_numpy())
            values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components are NaN
            of = np.repeat(np.arange(len(lengths)), lengths)
            good = np.array(vectors.is_valid()) & np.array(batch.column("id").is_valid()) & np.array(batch.column("label").is_valid())
            good[of[~np.isfinite(values)]] = False
            whole = np.floor(values[good[of]] * scale)
            if len(whole) and np.abs(whole).max() >= 2**31:
                raise ValueError("a component is too large: scaled components must fit 32 bits")
            squares = np.bincount(of[good[of]], whole * whole, len(lengths))[good]
            ends = np.cumsum(4 * lengths[good])
            data = whole.astype("<i4").tobytes()
            taken = pa.array(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").filter(taken), batch.column("label").filter(taken), pa.array(np.sqrt(squares) * (1 + 1e-9)), pa.array([data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) else [], pa.binary())],
                ["id", "label", "norm", "vector"],
            )

    return read


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to buckets of at most BUCKET rows; a bucket's vectors are as wide as its widest."""
    for batch in batches:
        for start in range(0, batch.num_rows, BUCKET):
            some = batch.slice(start, BUCKET)
            vectors = some.column("vector").to_pylist()
            width = max(map(len, vectors))
            data = b"".join(v.ljust(width, b"\0") for v in vectors)
            ids, labels = (some.column(c).cast(pa.int64()).to_numpy().astype("<i8").tobytes() for c in ("id", "label"))
            norm = float(some.column("norm").to_numpy().max())
            yield pa.RecordBatch.from_pylist([{"n": some.num_rows, "width": width // 4, "norm": norm, "ids": ids, "labels": labels, "vectors": data}])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and vectors of a bucket."""
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["vectors"], "<i4").reshape(row["n"], row["width"])


def _scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of all rows, exact: bound holds for every partial sum. The narrower rows count as filled with zeros."""
    width = min(a.shape[1], b.shape[1])
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    if bound >= 2**63:
        raise ValueError("vectors are too long: scores must fit 64 bits")
    return (a[:, :width].astype(kind) @ b[:, :width].astype(kind).T).astype(np.int64)


class Firsts:
    """The first k (score, id) of each of n slots, filled with (LEAST, NO_ID)."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.id = np.full((n, k), LEAST), np.full((n, k), NO_ID)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        k, touched = self.score.shape[1], np.unique(slot)
        held = self.id[touched] != NO_ID
        slot = np.concatenate([slot, np.repeat(touched, held.sum(1))])
        score, ids = np.concatenate([score, self.score[touched][held]]), np.concatenate([ids, self.id[touched][held]])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        first = rank < k
        self.score[touched], self.id[touched] = LEAST, NO_ID
        self.score[slot[first], rank[first]], self.id[slot[first], rank[first]] = score[first], ids[first]


class Search:
    """What a task does with its buckets for a wave of anchors (ids, labels, vectors, norms).

    windows: None for the positives, the first rows of the same label; else (slots, low, high), the windows of each anchor, for
    the first rows of other labels with a score from low to high.
    """

    def __init__(self, wave, k: int, windows: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.wave, self.k, self.windows = wave, k, windows

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, norms = self.wave.value
        n = len(ids)
        if self.windows is None:
            low, high = np.full((n, 1), LEAST), np.full((n, 1), NO_ID)
        else:
            low, high = self.windows.value
        slots = low.shape[1]
        firsts = Firsts(n * slots, self.k)
        for batch in batches:
            for row in batch.to_pylist():
                own_ids, own_labels, own = _unpacked(row)
                for start in range(0, n, BLOCK):
                    span = slice(start, start + BLOCK)
                    # a window's limit: its own, and the kth score so far (equal scores may still win by their id)
                    limit = np.maximum(low[span], firsts.score[start * slots : (start + BLOCK) * slots, -1].reshape(-1, slots))
                    open_ = limit <= high[span]
                    least = np.where(open_, limit, NO_ID).min(1)
                    alive = start + np.flatnonzero(open_.any(1) & (norms[span] * row["norm"] * (1 + 1e-9) + 1 >= least))
                    if not len(alive):
                        continue
                    score = _scores(vectors[alive], own, float(norms[alive].max() * row["norm"]))
                    fits = (labels[alive][:, None] == own_labels) == (self.windows is None)
                    fits &= ids[alive][:, None] != own_ids
                    for slot in range(slots):
                        at, which = np.nonzero(fits & (score >= limit[alive - start, slot][:, None]) & (score <= high[alive, slot][:, None]))
                        firsts.add(alive[at] * slots + slot, score[at, which], own_ids[which])
        at, which = np.nonzero(firsts.id != NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (at // slots, at % slots, firsts.score[at, which], firsts.id[at, which])], ["anchor", "slot", "score", "id"])


def _waves(spark: SparkSession, path: str) -> Iterator[tuple]:
    """Packed anchors, in waves of bounded size."""
    held: list = []
    for row in spark.read.parquet(path).toLocalIterator():
        part = _unpacked(row.asDict())
        rows, size = sum(len(p[0]) for p in held) + len(part[0]), sum(p[2].nbytes for p in held) + part[2].nbytes
        if held and (rows > WAVE or size > WAVE_BYTES):
            yield _joined(held)
            held = []
        held.append(part)
    if held:
        yield _joined(held)


def _joined(parts: list) -> tuple:
    width = max(p[2].shape[1] for p in parts)
    vectors = np.concatenate([np.pad(p[2], ((0, 0), (0, width - p[2].shape[1]))) for p in parts])
    norms = np.sqrt(np.square(vectors.astype(np.float64)).sum(1)) * (1 + 1e-9)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), vectors, norms


def _ranked(found: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def mine(
    embeddings: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label",
    scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first negatives of each anchor and positive.

    anchors: the condition on columns of embeddings that makes a row an anchor; all rows are candidates.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    parse = lambda r: r.select("id", "label", "vector").mapInArrow(_rows(scale), "id long, label long, norm double, vector binary")

    index, queries, out = (scratch(spark, n) for n in ("norm-buckets", "anchors", "hard-negatives"))
    dealt = parse(rows).repartition(partitions(spark), F.xxhash64("id", "vector", F.monotonically_increasing_id()))
    dealt.sortWithinPartitions(F.desc("norm")).mapInArrow(_pack, PACKED).write.parquet(index)
    parse(rows.where("anchor")).mapInArrow(_pack, PACKED).write.parquet(queries)
    # files keep their order; as many tasks as partitions were dealt
    buckets = spark.read.parquet(index)
    spark.createDataFrame([], RESULT).write.parquet(out)
    for wave in _waves(spark, queries):
        sent = spark.sparkContext.broadcast(wave)
        n = len(wave[0])
        found = _ranked(buckets.mapInArrow(Search(sent, positives), FOUND), positives).toPandas()
        score, ids = np.full((n, positives), LEAST), np.full((n, positives), NO_ID)
        score[found["anchor"], found["rank"] - 1], ids[found["anchor"], found["rank"] - 1] = found["score"], found["id"]
        # 100 * negative >= low * positive; a window of no positive is empty
        some = ids != NO_ID
        floor = np.where(some, -((-low * np.where(some, score, 0)) // 100), 1)
        windows = spark.sparkContext.broadcast((floor, np.where(some, score, 0)))
        best = _ranked(buckets.mapInArrow(Search(sent, negatives, windows), FOUND), negatives)
        best.mapInArrow(_named(sent, spark.sparkContext.broadcast((ids, score))), RESULT).write.mode("append").parquet(out)
    return spark.read.schema(RESULT).parquet(out)


def _named(wave, positives):
    """Ranked rows with the ids of their anchor and positive."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, (ids, scores) = wave.value[0], positives.value
        for b in batches:
            anchor, slot = b.column("anchor").to_numpy(), b.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor_ids[anchor]), pa.array(ids[anchor, slot]), b.column("rank"), b.column("id"), pa.array(scores[anchor, slot]), b.column("score")],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    return name


def mine_shifted(embeddings: DataFrame) -> DataFrame:
    """The query's rows: labels of every seventh id are wrong by one; anchors are ids divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings, F.col("vec_id") % 100 == 0, label=label)
