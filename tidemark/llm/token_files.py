"""Token-ID files: ids of all texts in ascending doc_id order, written as coded segments and read back.

Texts are range-partitioned by id, encoded and gathered into segments (see `id_codec`) of whole documents; a written table
in the shared folder holds one segment a row with its place (part, segment). Reading decodes each row on its own, so a
lost executor costs only its rows. Starts come from sums: within a part by segment, over parts (as many as shuffle
partitions) on the driver.

Defined results: a null or empty text has the end id alone. Rows without a doc_id come first; rows with equal doc_id
follow the order of their texts. Repeated rows are written each. An empty table gives an empty result; other columns are
ignored. Damaged segments raise an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import tee

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, scratch, small_batches
from tidemark.llm.id_codec import decode_segment, encode_segment, segments
from tidemark.llm.tokens import encoder, vocabulary_path

END_ID = 2
FILE = "part int, segment int, n_tokens long, payload binary"


def write_ids(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Writes the table of segments to path."""
    spark = documents.sparkSession
    small_batches(spark, 500)
    vocabulary, end = vocabulary or vocabulary_path(), np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), encoder(vocabulary)
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        rows, same = tee(rows)  # apart by one lot of texts at most
        docs = ((d, ids + end) for (d, _), ids in zip(rows, own.encode_all(text for _, text in same), strict=True))
        for n, (ids_of, lengths, ids) in enumerate(segments(docs)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([encode_segment(ids_of, lengths, ids)], pa.binary())],
                names=["part", "segment", "n_tokens", "payload"],
            )

    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    dealt = rows.repartitionByRange(partitions(spark), F.asc_nulls_first("_id")).sortWithinPartitions(F.asc_nulls_first("_id"), "_text")
    dealt.mapInArrow(run, FILE).write.parquet(path)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the segments at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, segment, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                docs, lengths, ids = decode_segment(data.as_py())
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n : e].tobytes()) for n, e in zip(lengths, ends, strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())],
                    names=["part", "segment", "_id", "within", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(FILE).parquet(path)
    sizes = files.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, n = [], 0
    for r in parts:
        before.append((r.part, n))
        n += r.n
    earlier = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(F.broadcast(spark.createDataFrame(before, "part int, part_start long")), "part").select(
        "part", "segment", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).alias("segment_start")
    )
    docs = files.select("part", "segment", "payload").mapInArrow(run, "part int, segment int, _id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "segment"]).select(F.col("_id").alias(id_col), (F.col("segment_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts to a fresh table in the shared folder and returns what is read from it."""
    path = scratch(documents.sparkSession, "token-ids")
    write_ids(documents, path, id_col, text_col)
    return read_ids(documents.sparkSession, path, id_col)
