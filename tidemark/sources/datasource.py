"""Result folders as a data source: ``spark.read.format("tidemark_records").load(root)``, and the same with readStream.

Partitions are planned from the list of files. What a file's path says, its iteration or its model, is known before it is opened, so
filters on these columns skip files (`spark.sql.python.filterPushdown.enabled`); Spark applies the other filters. Small files share a
task, and a task reads its files line by line, so it never holds one whole, but for records that are files of their own. Files are
reached by Arrow's file systems (local, hdfs, s3, gs), by the path's scheme.

Options: layout is ``iterations`` (iter_N/records.jsonl, and for iterations without it iter_N/pred_R.json and iter_N_pred_R.json)
or ``models`` (every .jsonl file but records.jsonl); mode is ``permissive`` (lines that are no JSON objects have is_valid false)
or ``failfast`` (they raise). In the iterations layout a record index that is no number raises in either mode.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from tidemark.sources.records import EVAL

NAME = "tidemark_records"
SCHEMA = "file string, iter int, model string, line int, rec_idx int, is_valid boolean, raw string"
LAYOUTS, MODES = ("iterations", "models"), ("permissive", "failfast")
#: Bytes of files that share a task, rows of a batch, and seconds that a file must be unchanged before a stream takes it.
TASK_BYTES, BATCH_ROWS, SETTLED = 32 << 20, 2_000, 1.0
ITERATION = re.compile(r"iter_(\d+)/records\.jsonl", re.I)
SINGLE = (re.compile(r"iter_(\d+)/pred_(\d+)\.json", re.I), re.compile(r"iter_(\d+)_pred_(\d+)\.json", re.I))


@dataclass(frozen=True)
class File:
    """A file of a result folder and what its path says: kind is lines or single, index the record's number of a single one."""

    path: str
    size: int
    changed: int
    kind: str
    iter: int | None = None
    model: str | None = None
    index: int | None = None


@dataclass
class Task(InputPartition):
    files: tuple[File, ...]

    def __init__(self, files: Iterable[File]) -> None:
        super().__init__(None)
        self.files = tuple(files)


def listing(root: str, layout: str) -> list[File]:
    """The files of a layout below root, in order of their path."""
    fs, base = arrow_fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (arrow_fs.LocalFileSystem(), root)
    base = base.rstrip("/")
    found = []
    for info in sorted(fs.get_file_info(arrow_fs.FileSelector(base, recursive=True, allow_not_found=False)), key=lambda x: x.path):
        name = info.path[len(base) + 1 :]
        own = (info.path, info.size, info.mtime_ns or 0)
        if info.type != arrow_fs.FileType.File or any(part.startswith(("_", ".")) for part in name.split("/")):
            continue
        if layout == "models":
            if name.endswith(".jsonl") and name.rsplit("/", 1)[-1] != "records.jsonl":
                found.append(File(*own, "lines", model=name.removesuffix(".jsonl")))
        elif m := ITERATION.fullmatch(name):
            found.append(File(*own, "lines", iter=int(m[1])))
        elif m := next(filter(None, (p.fullmatch(name) for p in SINGLE)), None):
            found.append(File(*own, "single", iter=int(m[1]), index=int(m[2])))
    whole = {f.iter for f in found if f.kind == "lines"}
    return [f for f in found if f.kind == "lines" or f.iter not in whole]


def tasks(files: Iterable[File]) -> list[Task]:
    """Files in order, as many to a task as TASK_BYTES allows."""
    made, held, size = [], [], 0
    for f in files:
        if held and size + f.size > TASK_BYTES:
            made.append(Task(held))
            held, size = [], 0
        held.append(f)
        size += f.size
    return [*made, Task(held)] if held else made


#: How a pushed filter decides on a file's value of a column; a null decides nothing but is-null and null-safe equality.
TESTS = {
    EqualTo: lambda v, f: v is not None and v == f.value, EqualNullSafe: lambda v, f: v == f.value, In: lambda v, f: v is not None and v in f.value,
    GreaterThan: lambda v, f: v is not None and v > f.value, GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value,
    LessThan: lambda v, f: v is not None and v < f.value, LessThanOrEqual: lambda v, f: v is not None and v <= f.value,
    IsNull: lambda v, f: v is None, IsNotNull: lambda v, f: v is not None, StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
    StringEndsWith: lambda v, f: v is not None and v.endswith(f.value), StringContains: lambda v, f: v is not None and f.value in v,
}


def decides(f: Filter) -> bool:
    """Whether a filter is about what paths say alone. A negated one is, if its column is never null where it holds."""
    if isinstance(f, Not):
        return isinstance(f.child, (EqualNullSafe, IsNull, IsNotNull)) and decides(f.child)
    return type(f) in TESTS and f.attribute in (("iter",), ("model",))


def holds(f: Filter, file: File) -> bool:
    return not holds(f.child, file) if isinstance(f, Not) else TESTS[type(f)](getattr(file, f.attribute[0]), f)


class Records:
    """What both readers do with a task."""

    def __init__(self, options) -> None:
        self.root, self.layout, self.mode = options["path"], options.get("layout", "iterations"), options.get("mode", "permissive")
        if self.layout not in LAYOUTS or self.mode not in MODES:
            raise ValueError(f"layout is one of {LAYOUTS}, mode one of {MODES}")

    def rows(self, task: Task) -> Iterator[pa.RecordBatch]:
        fs = arrow_fs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else arrow_fs.LocalFileSystem()
        held: list[tuple] = []
        for file in task.files:
            for line, raw in self.texts(fs, file):
                held.append((file.path, file.iter, file.model, line, *self.judged(file, line, raw), raw))
                if len(held) == BATCH_ROWS:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    def texts(self, fs, file: File) -> Iterator[tuple[int, str]]:
        import io

        with fs.open_input_stream(file.path) as stream:
            if file.kind == "single":
                yield 0, stream.read().decode("utf-8", "replace")
                return
            for line, raw in enumerate(io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="\n")):
                if raw.strip():
                    yield line, raw.rstrip("\r\n")

    def judged(self, file: File, line: int, raw: str) -> tuple[int, bool]:
        """(rec_idx, is_valid)."""
        own = line if file.index is None else file.index
        try:
            value = json.loads(raw, parse_constant=_no_constant)
        except ValueError:
            value = None
        if not isinstance(value, dict):
            if self.mode == "failfast":
                raise ValueError(f"no JSON object in {file.path} line {line}")
            return own, False
        if file.index is not None or "jsonl_record_index" not in value:
            return own, True
        try:
            return int(value["jsonl_record_index"]), True
        except (TypeError, ValueError):
            if self.layout == "iterations":
                raise ValueError(f"a record index that is no number in {file.path} line {line}") from None
            return own, True


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "iter": pa.int32(), "model": pa.string(), "line": pa.int32(), "rec_idx": pa.int32(), "is_valid": pa.bool_(), "raw": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


class RecordReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.records, self.filters = Records(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if decides(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Task]:
        files = listing(self.records.root, self.records.layout)
        return tasks(f for f in files if all(holds(x, f) for x in self.filters)) or [Task(())]

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return self.records.rows(partition)


class RecordStream(DataSourceStreamReader):
    """Files in order of (time of change, path). An offset is the last file taken; files still being written wait until they settle."""

    def __init__(self, options) -> None:
        self.records, self.settled = Records(options), float(options.get("settled", SETTLED))

    def initialOffset(self) -> dict:
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settled * 1e9)
        last = max(((f.changed, f.path) for f in listing(self.records.root, self.records.layout) if f.changed <= until), default=(0, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Task]:
        low, high = ((x["changed"], x["path"]) for x in (start, end))
        return tasks(sorted((f for f in listing(self.records.root, self.records.layout) if low < (f.changed, f.path) <= high), key=lambda f: (f.changed, f.path)))

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return self.records.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def streamReader(self, schema) -> RecordStream:
        return RecordStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordSource)


def with_records(rows: DataFrame) -> DataFrame:
    """Rows of the source with raw parsed to record, null where it is not valid."""
    return rows.withColumn("record", F.when(F.col("is_valid"), F.from_json("raw", EVAL))).drop("raw")
