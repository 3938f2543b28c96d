"""Sinks: JSON lines, CSV with map columns as sorted JSON, nested reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """One object a line, nulls written out. With an order the files' lines follow it, file by file."""
    (df.sort(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_observed(df: DataFrame, path: str, kept: Callable[[DataFrame], DataFrame], **counts: Column) -> dict[str, int]:
    """Writes what `kept` leaves of df as Parquet, and returns aggregates over all of df that the same pass has observed."""
    seen = Observation()
    kept(df.observe(seen, *[c.alias(n) for n, c in counts.items()])).write.parquet(path)
    return seen.get


def sorted_json(m: Column) -> Column:
    """A map as a JSON object with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """With a header; map columns become sorted JSON."""
    made = df.select(*[sorted_json(F.col(c)).alias(c) if t.startswith("map<") else F.col(c) for c, t in df.dtypes])
    made.sort(*order).write.mode("overwrite").csv(path, header=True)


def nested(df: DataFrame, *keys: str) -> DataFrame:
    """One row with the rows as nested maps: key1 -> key2 -> ... -> row."""
    value = F.struct(*[c for c in df.columns if c not in keys])
    rows = df.select(*[F.col(k).cast("string").alias(k) for k in keys], value.alias("v"))
    for k in reversed(keys):
        outer = keys[: keys.index(k)]
        rows = rows.groupBy(*outer).agg(F.map_from_entries(F.collect_list(F.struct(k, "v"))).alias("v"))
    return rows


def report_document(df: DataFrame, *keys: str, **head: object) -> DataFrame:
    """One row, line: a summary table as a JSON document by_<key1> -> <key2>s -> <key3> -> row, after what `head` says. A report is small."""
    value = F.struct(*[c for c in df.columns if c not in keys])
    rows = df.select(*[F.col(k).cast("string").alias(k) for k in keys], value.alias("v"))
    for k in reversed(keys):
        rows = rows.groupBy(*keys[: keys.index(k)]).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "v")), lambda a, b: F.when(a[k] < b[k], -1).when(a[k] > b[k], 1).otherwise(0))).alias("v"))
        if k in keys[1:-1]:
            rows = rows.withColumn("v", F.struct(F.col("v").alias(f"{k}s")))
    known = [F.from_json(F.lit(json.dumps(x)), F.schema_of_json(F.lit(json.dumps(x)))).alias(n) if isinstance(x, (list, dict)) else F.lit(x).alias(n) for n, x in head.items()]
    return rows.select(F.to_json(F.struct(*known, F.col("v").alias("by_" + keys[0])), {"pretty": "true", "ignoreNullFields": "false"}).alias("line"))


def write_report(df: DataFrame, root: str, name: str, *keys: str, **head: object) -> None:
    """The report document at root/name, through the cluster's file system."""
    write_files(report_document(df, *keys, **head).select(F.lit(name).alias("name"), "line", F.lit(0).alias("o")), root, "name", "line", "o")


def side_by_side(df: DataFrame, row: str, column: str, names: Sequence[str], value: str, form: str = "%.3f") -> DataFrame:
    """row and one column per name with the formatted value, a dash where there is none."""
    made = df.groupBy(row).pivot(column, list(names)).agg(F.first(F.format_string(form, F.col(value))))
    return made.select(row, *[F.coalesce(F.col(f"`{n}`"), F.lit("—")).alias(str(n)) for n in names]).orderBy(row)


#: The columns of the tables that compare models and iterations, by the names that summaries use.
MODEL_COLUMNS = {
    "run": "run", "model": "model", "source_jsonl": "source_jsonl", "tiou_threshold": "tau", "unmatched_policy": "unmatched_policy", "f1": "mean_micro_f1",
    "f1_all": "mean_micro_f1_all", "tiou": "mean_tiou", "coverage": "mean_gt_coverage", "hit": "hit_share", "n_f1": "n_f1", "n_records_all": "n_records",
}
ITERATION_COLUMNS = {
    "run": "run", "iteration": "iter", "tiou_threshold": "tau", "unmatched_policy": "unmatched_policy", "n_files": "n_files", "n_skipped": "n_skipped", "mean_tiou_matched": "mean_tiou",
    "frac_records_with_tiou_match": "hit_share", "n_records_for_f1_avg": "n_f1", "n_records_with_tiou_match": "n_hit", "n_records_all": "n_records", "mean_micro_f1_all_records": "mean_micro_f1_all",
    **{c: c for c in ("mean_gt_coverage", "mean_pred_match_rate", "mean_subset_acc", "mean_hamming", "mean_micro_p", "mean_micro_r", "mean_micro_f1", "mean_macro_f1", "mean_num_gt", "mean_num_pred",
                      "mean_num_matched", "mean_max_tiou_per_gt", "mean_max_tiou_per_pred")},
    "chunk_pool_micro_f1": "pool_f1", "chunk_pool_micro_precision": "pool_p", "chunk_pool_micro_recall": "pool_r", "chunk_pool_accuracy": "pool_acc",
    **{f"chunk_pool_sum_{x}": f"sum_{x}" for x in ("tp", "fp", "fn", "tn")}, "n_guardrail_chunk_rows_total": "sum_n_rows",
}


def report_table(summary: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A summary under the table's column names, in their order; columns that the summary lacks are null."""
    return summary.select(*[(F.col(c) if c in summary.columns else F.lit(None).cast("string")).alias(n) for n, c in columns.items()])


def write_document(spark: SparkSession, value: object, root: str, name: str, ascii_only: bool = False) -> None:
    """One small JSON document, indented, at root/name, through the cluster's file system."""
    text = json.dumps(value, indent=2, ensure_ascii=ascii_only)
    write_files(spark.createDataFrame([(name, text, 0)], "name string, line string, o int"), root, "name", "line", "o")


def manifest(runs: DataFrame, root: str, **head: object) -> dict:
    """The manifest of a run matrix (model, dataset, done): by model its log and the files of its runs. runs is a list of names."""
    models: dict[str, list] = {}
    for r in runs.orderBy("model", "dataset").collect():  # as many rows as there are model and dataset names
        at = f"{root}/{r.model}/{r.dataset}"
        models.setdefault(r.model, []).append({"dataset": r.dataset, "raw_output_jsonl": f"{at}/raw_outputs.jsonl", "record_output_jsonl": f"{at}/record.jsonl"})
    return {**head, "models": [{"model_slug": m, "server_log": f"{root}/{m}/server.log", "runs": x} for m, x in models.items()]}


def file_system(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's file system of a path by its scheme (local without one), and the path in it."""
    return arrow_fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (arrow_fs.LocalFileSystem(), root)


def write_files(df: DataFrame, root: str, name: str, line: str, order: str) -> None:
    """One text file per value of name, at root/value, with its lines in order.

    Each file is written by one task, under a name of its own until it is whole, so a task that runs twice does no harm; a task
    holds a batch of lines. The driver has no part in it, however many files there are.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        now, out, made = None, None, set()

        def finish() -> None:
            if out is not None:
                out.close()
                fs.move(hidden, f"{base}/{now}")

        for batch in batches:
            for value, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None or value != now:
                    finish()
                    folder, _, leaf = f"{base}/{value}".rpartition("/")
                    if folder not in made:
                        fs.create_dir(folder, recursive=True)
                        made.add(folder)
                    now, hidden = value, f"{folder}/.{leaf}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(hidden, buffer_size=1 << 16)
                out.write(((text or "") + "\n").encode())
        finish()
        yield from ()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(name).alias("name"), F.col(order).alias("o"), F.col(line).alias("line")).repartition(n, "name").sortWithinPartitions("name", "o")
    rows.select("name", "line").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
