"""Metrics over segments that keep arriving: a record is scored once it is complete, or once it is late.

`write_whole_records` keeps the rows that wait in a table from batch to batch; `gathered` holds records in keyed state, with a limit of time.

Output is written by batch number, each in a folder of its own that a repeated batch replaces: a query that was stopped between writing and
its checkpoint repeats the batch and gives the same table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.metrics import record_metrics, row_metrics

ROWS = "array<struct<i:bigint,s:double,e:double,b:int>>"
GATHERED = f"rec_id long, gt {ROWS}, pred {ROWS}, complete boolean"
#: What the state holds of a record: its rows by column, how many are expected, and the latest event time in milliseconds.
STATE = "gt array<boolean>, i array<bigint>, s array<double>, e array<double>, b array<int>, expected long, latest long"
PARTS = ("gt", "i", "s", "e", "b")


def new_lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """file and raw of lines in files that arrive under path."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))


def pooled_counts(label_rows: DataFrame, ts: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Sums of tp, fp, fn and tn by event-time window and label of a stream of label rows; later rows are dropped."""
    timed = label_rows.withWatermark(ts, late)
    return timed.groupBy(F.window(ts, window), "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def _one(key: tuple, held: dict, complete: bool) -> pd.DataFrame:
    rows = sorted(zip(*(held[p] for p in PARTS), strict=True), key=lambda r: r[1])
    side = lambda gt: [{"i": i, "s": s, "e": e, "b": b} for g, i, s, e, b in rows if bool(g) == gt]
    return pd.DataFrame([{"rec_id": key[0], "gt": side(True), "pred": side(False), "complete": complete}])


def _gather(patience: int | None):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = dict(zip((*PARTS, "expected", "latest"), state.get, strict=True))
            state.remove()
            yield _one(key, held, False)
            return
        held = dict(zip((*PARTS, "expected", "latest"), state.get, strict=True)) if state.exists else {p: [] for p in PARTS} | {"expected": 0, "latest": 0}
        held = {k: list(v) if k in PARTS else v for k, v in held.items()}
        known = set(zip(held["gt"], held["i"], strict=True))
        for batch in batches:
            for row in batch.itertuples(index=False):
                held["expected"] = max(held["expected"], int(row.expected))
                held["latest"] = max(held["latest"], int(row.ts.timestamp() * 1000))
                if (bool(row.gt), int(row.i)) not in known:  # a row that comes again counts once
                    known.add((bool(row.gt), int(row.i)))
                    for p, cast in zip(PARTS, (bool, int, float, float, int), strict=True):
                        held[p].append(cast(getattr(row, p)))
        if len(held["i"]) >= held["expected"]:
            if state.exists:
                state.remove()
            yield _one(key, held, True)
            return
        state.update(tuple(held[p] for p in PARTS) + (held["expected"], held["latest"]))
        if patience is not None:
            state.setTimeoutTimestamp(max(held["latest"] + patience, state.getCurrentWatermarkMs() + 1))

    return step


def gathered(segments: DataFrame, late: str | None = None, patience_ms: int = 0) -> DataFrame:
    """(rec_id, gt, pred, complete): each record once, when all its `expected` rows are there.

    segments: a stream of (rec_id, gt, i, s, e, b, expected, ts), expected being how many rows the record has. With `late` (how long
    rows may come after the latest event time) a record that waits for longer than patience_ms beyond it is given up and comes
    incomplete; without it records wait for ever. Rows with equal (gt, i) count once. A record is held whole in its state.
    """
    rows = segments.select("rec_id", *PARTS, "expected", "ts")
    rows = rows.withWatermark("ts", late) if late else rows
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return rows.groupBy("rec_id").applyInPandasWithState(_gather(patience_ms if late else None), GATHERED, STATE, "append", timeout)


def stream_metrics(segments: DataFrame, taus: Sequence[float] = (0.5,), policy: str = "strict", **options) -> DataFrame:
    """Record metrics of a stream of segments: what record_metrics gives for each record, once it is complete; options as in `gathered`."""
    return row_metrics(gathered(segments, **options), taus, policy, carried=("complete",))


def write_batches(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that writes each batch to path/batch=N, replacing what an earlier try of the batch left."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_whole_records(segments: DataFrame, path: str, checkpoint: str, taus: Sequence[float] = (0.5,), policy: str = "strict", **trigger) -> StreamingQuery:
    """Starts a query that writes the metrics of the records that a batch completes to path/batch=N; all others wait for later batches.

    segments as in `gathered`, without its `late`: records wait for ever. Rows that wait are a table of the batch beside the checkpoint,
    which the next batch joins with its own, so nothing is gathered by record in Python and a large record stays spread.
    Rows with equal (gt, i) count once, the first. A repeated batch replaces what its earlier try left.
    """
    waiting = f"{checkpoint.rstrip('/')}-waiting"

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("rec_id", *PARTS, "expected", F.lit(1).alias("at"))
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{waiting}/batch={number - 1}/whole=false").withColumn("at", F.lit(0)))
        once = rows.groupBy("rec_id", "gt", "i").agg(F.min(F.struct("at", "s", "e", "b")).alias("x"), F.max("expected").alias("expected")).select("rec_id", "gt", "i", "x.s", "x.e", "x.b", "expected")
        known = once.groupBy("rec_id").agg((F.count("*") >= F.max("expected")).alias("whole"))
        own, schema = f"{waiting}/batch={number}", once.drop("whole").schema
        for part in ("true", "false"):  # both folders are there, also if one has no rows
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{own}/whole={part}")
        once.join(known, "rec_id").write.mode("append").partitionBy("whole").parquet(own)
        record_metrics(spark.read.parquet(f"{own}/whole=true"), taus, policy).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number > 1:
            _drop(spark, f"{waiting}/batch={number - 2}")

    return segments.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def write_record_metrics(segments: DataFrame, path: str, checkpoint: str, taus: Sequence[float] = (0.5,), policy: str = "strict") -> StreamingQuery:
    """Starts a query that writes each batch's record metrics to path/batch=N; here a batch holds whole records, and none is gathered in state."""

    def each(batch: DataFrame, number: int) -> None:
        record_metrics(batch, taus, policy).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return segments.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
