"""The evaluation of several runs at once: what each root holds, scanned, matched and summed in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.sources import records

MODELS, ITERATIONS = "model_jsonl", "iterations"


def has_models(spark: SparkSession, root: str) -> bool:
    """Whether any .jsonl file below root is no records.jsonl. Only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    return not files.select("path").where(~F.col("path").endswith("/records.jsonl")).isEmpty()


def runs(spark: SparkSession, roots: Mapping[str, str], mode: str | None = None) -> tuple[str, DataFrame]:
    """(mode, rows of run, model, rec_id, is_valid, record) of all roots by the name of their run.

    If any run has files of models, all runs are read by model, and those without have no rows; else by iteration.
    """
    mode = mode or (MODELS if any(has_models(spark, r) for r in roots.values()) else ITERATIONS)
    rows = None
    for name, root in roots.items():
        own = records.model_results(spark, root) if mode == MODELS else records.iteration_records(spark, root).withColumn("model", F.col("iter").cast("string"))
        own = own.select(F.lit(name).alias("run"), "model", F.struct(F.lit(name).alias("run"), "file", "line").alias("rec_id"), "is_valid", "record")
        rows = own if rows is None else rows.unionByName(own)
    return mode, rows


def report(spark: SparkSession, roots: Mapping[str, str], taus: Sequence[float], policy: str = "strict") -> tuple[str, DataFrame]:
    """(mode, rows by tau, run and model, by tau and run, and by tau): the summaries of all runs in one pass over their records."""
    mode, rows = runs(spark, roots)
    each = metrics.evaluate(rows, sorted(set(taus)), policy, carried=("run", "model"))
    return mode, metrics.summary_sets(each, [("tau", "run", "model"), ("tau", "run"), ("tau",)], "tau", "run", "model")
