"""Drops lines that stand in many documents: a digest of every line's key, documents counted by digest, texts put together again.

A line's key is the line without white space ``[ \\t-\\r]`` at either end, A-Z lower-cased. A key of at least ``min_chars`` code
points that is found in at least ``min_documents`` documents loses all its lines, except in the largest id that holds it.

How it is spread: tasks cut texts into lines and write one row of digests for every different key of a text (128 bits of the
key; 128 bits of id and text name the row). Documents are counted by key in two combined aggregates, so a line that a third
of all documents hold is summed where it lies. What must go comes back to its row by a join: fewer than a thousand very common keys
are broadcast, the others shuffled. It is a set no larger than the text has lines. Only then does each text move, once, to meet its set.

Defined results: a null or empty text is one empty line. An id counts once, however many rows have it; rows without an id are one
document that comes before all others. Equal rows get equal results, each its own row. An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, scratch
from tidemark.llm.components import meet

MIN_CHARS, MIN_DOCUMENTS = 20, 3
SPACE = b" \t\n\x0b\x0c\r"
#: SQL for the query's rows.
ORACLE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3),
m AS (SELECT k.*, hot.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN hot USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r"""


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The line's key, none if it is too short. Bytes of UTF-8: lower() changes A-Z alone."""
    key = line.strip(SPACE).lower()
    if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars:
        return key
    return None


def _digests(min_chars: int):
    """Rows (row, text as bytes, id) to a row for every different key of each text."""
    from xxhash import xxh3_128_digest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for text in batch.column("_text"):
                keys = {_key(line, min_chars) for line in (text.as_py() or b"").split(b"\n")} - {None}
                found += map(xxh3_128_digest, keys)
                counts.append(len(keys))
            rows = np.repeat(np.arange(len(counts)), counts)
            halves = np.frombuffer(b"".join(found), ">i8").astype("<i8").reshape(-1, 2)
            of = batch.select(["_r1", "_r2", "_id"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), *of.columns], ["_k1", "_k2", "_r1", "_r2", "_id"])

    return cut


def _rebuild(min_chars: int):
    """Rows (id, text as bytes, keys that must go) to the kept texts."""
    from xxhash import xxh3_128_digest

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drops in zip(batch.column("_text"), batch.column("_drops"), strict=True):
                lines, stay = (text.as_py() or b"").split(b"\n"), None
                if drops.is_valid:
                    gone = set(drops.as_py())
                    keys = (_key(line, min_chars) for line in lines)
                    stay = [line for line, key in zip(lines, keys, strict=True) if key is None or xxh3_128_digest(key) not in gone]
                n_lines.append(len(lines))
                n_dropped.append(0 if stay is None else len(lines) - len(stay))
                kept.append(b"\n".join(lines if stay is None else stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_lines", "n_dropped", "kept"]
            )

    return put


def drop_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(id_col, n_lines, n_dropped, text_col): for each row of documents its number of lines, how many go, and the text of those that stay."""
    spark, id_, text = documents.sparkSession, F.col(id_col), F.col(text_col)
    rows = documents.select(
        id_.alias("_id"), text.cast("binary").alias("_text"),
        F.xxhash64(F.lit(1), id_, text).alias("_r1"), F.xxhash64(F.lit(2), text, id_).alias("_r2"),
    )
    kind = dict(rows.dtypes)["_id"]
    path = scratch(spark, "lines")
    rows.mapInArrow(_digests(min_chars), f"_k1 long, _k2 long, _r1 long, _r2 long, _id {kind}").write.parquet(path)
    lines, key = spark.read.parquet(path), ["_k1", "_k2"]

    documents_of = lines.select(*key, "_id").distinct()
    hot = cut(documents_of.groupBy(*key).agg(F.count("*").alias("_n"), F.max("_id").alias("_keeper")).where(F.col("_n") >= min_documents))
    # a key's documents are at most its rows, so few keys hold more than a set share of all rows: these meet them where they lie
    gone = meet(lines, hot, key, "_n", lines.count()).where(~F.col("_id").eqNullSafe(F.col("_keeper")))
    digest = F.unhex(F.concat(*[F.lpad(F.hex(k), 16, "0") for k in key]))  # big-endian, as xxhash writes it
    drops = gone.groupBy("_r1", "_r2").agg(F.collect_set(digest).alias("_drops"))

    met = rows.join(drops, ["_r1", "_r2"], "left").select("_id", "_text", "_drops")
    kept = met.mapInArrow(_rebuild(min_chars), f"id {kind}, n_lines long, n_dropped long, kept binary")
    return kept.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("kept").cast("string").alias(text_col))


def line_digests(documents: DataFrame) -> DataFrame:
    """The query's columns: what drop_lines keeps, as a digest."""
    return drop_lines(documents).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
