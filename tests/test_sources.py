import json
import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources import records, sinks
from tidemark.sources.events import segments
from tidemark.streaming import live


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def payload(*spans):
    chunks = {f"chunk_{i}": {"start": s, "end": e, "guardrail": {"C1": True}} for i, (s, e) in enumerate(spans)}
    return {"intervals": {"parse_status": "ok", "parse_ok": True, "chunks": chunks, "chunk_order": list(chunks)}}


def test_lines_keep_their_numbers_and_bad_ones_stay(spark, tmp_path):
    write(tmp_path / "a.jsonl", {"jsonl_record_index": 7, "ground_truth": payload((0, 1))}, "", "{broken", "[1]", {"jsonl_record_index": "x"})
    rows = records.jsonl(spark, str(tmp_path / "a.jsonl")).orderBy("line").collect()
    assert [(r.line, r.is_valid, r.rec_idx) for r in rows] == [(0, True, 7), (2, False, 2), (3, False, 3), (4, True, 4)]
    assert rows[0].record.ground_truth.intervals.chunks["chunk_0"].guardrail == {"C1": "true"}
    with pytest.raises(Exception, match="no JSON object"):
        records.jsonl(spark, str(tmp_path / "a.jsonl"), "failfast").collect()
    counts = records.valid_counts(records.jsonl(spark, str(tmp_path / "a.jsonl"))).head()
    assert (counts.n, counts.n_bad) == (4, 2)


def test_iteration_folders_prefer_the_lines_file(spark, tmp_path):
    write(tmp_path / "iter_1" / "records.jsonl", {"iteration": 1}, "{")
    write(tmp_path / "iter_1" / "pred_5.json", {"iteration": 1})
    write(tmp_path / "iter_2" / "pred_3.json", {"iteration": 2})
    write(tmp_path / "iter_2_pred_4.json", {"iteration": 2})
    rows = records.iteration_records(spark, str(tmp_path)).collect()
    assert sorted((r.iter, r.rec_idx, r.is_valid) for r in rows) == [(1, 0, True), (1, 1, False), (2, 3, True), (2, 4, True)]


def test_model_results_are_named_by_path(spark, tmp_path):
    write(tmp_path / "m" / "d" / "record.jsonl", {"iteration": 1})
    write(tmp_path / "m" / "d" / "records.jsonl", {"iteration": 1})
    write(tmp_path / "m" / "d" / "raw_outputs.jsonl", {"x": 1})
    assert sorted(r.model for r in records.model_results(spark, str(tmp_path)).collect()) == ["m/d/raw_outputs", "m/d/record"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0.5, "a", {"z": 1, "b": 2}), (0.3, "b", {})], "tau double, model string, m map<string,int>")
    sinks.write_jsonl(df.withColumn("n", F.lit(None).cast("int")), str(tmp_path / "j"), "tau")
    lines = [json.loads(x) for p in sorted((tmp_path / "j").glob("*.json")) for x in p.read_text().splitlines()]
    assert [x["tau"] for x in lines] == [0.3, 0.5] and lines[0]["n"] is None
    sinks.write_csv(df, str(tmp_path / "c"), "tau")
    got = spark.read.option("escape", "\\").csv(str(tmp_path / "c"), header=True).orderBy("tau").collect()
    assert json.loads(got[1].m) == {"b": 2, "z": 1} and got[1].m.index("b") < got[1].m.index("z")
    sinks.write_report(df, str(tmp_path), "reports/r.json", "tau", "model", mode="model", taus=[0.3, 0.5])
    report = json.loads((tmp_path / "reports/r.json").read_text())
    assert report["taus"] == [0.3, 0.5] and list(report["by_tau"]) == ["0.3", "0.5"]
    assert report["mode"] == "model" and report["by_tau"]["0.5"]["a"]["m"] == {"z": 1, "b": 2}
    wide = sinks.side_by_side(df, "model", "tau", [0.3, 0.5], "tau").collect()
    assert [tuple(r) for r in wide] == [("a", "—", "0.500"), ("b", "0.300", "—")]


def test_record_metrics_of_a_stream(spark, sf, tmp_path):
    rows = segments(spark, sf)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.write_record_metrics(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.select("rec_id").distinct().count()
    counts = spark.readStream.schema("ts timestamp, label int, tp long, fp long, fn long, tn long").parquet(str(tmp_path / "in"))
    assert live.pooled_counts(counts, "ts").isStreaming
    assert time.time() > 0


def test_lines_stream_in(spark, tmp_path):
    write(tmp_path / "iter_1" / "records.jsonl", {"iteration": 1}, {"iteration": 1})
    q = live.new_lines(spark, str(tmp_path)).writeStream.format("memory").queryName("lines_in").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("lines_in").count() == 2


def test_records_in_state_are_scored_once_and_late_ones_given_up(spark, tmp_path):
    """Segments come in several files; a query that is stopped, and whose last batch is lost, gives the same table when it is restarted."""
    import shutil

    kind = "rec_id long, gt boolean, i long, s double, e double, b int, expected long, ts timestamp"
    at = lambda minute: f"2026-01-01 00:{minute:02d}:00"
    batches = [
        [(1, True, 1, 0.0, 4.0, 1, 3, at(0)), (2, True, 1, 0.0, 4.0, 1, 2, at(0)), (3, False, 7, 0.0, 1.0, 3, 1, at(1))],
        [(1, False, 2, 0.0, 4.0, 1, 3, at(2)), (1, True, 1, 0.0, 4.0, 1, 3, at(2))],
        [(1, False, 3, 8.0, 9.0, 2, 3, at(3)), (4, True, 1, 0.0, 1.0, 1, 9, at(3))],
        [(5, True, 1, 0.0, 1.0, 1, 1, at(50))],
        [(6, True, 1, 0.0, 1.0, 1, 1, at(55))],
    ]

    def run(n, out, state):
        for k, rows in enumerate(batches[:n]):
            if not (tmp_path / f"in{k}").exists():
                spark.createDataFrame(rows, "rec_id long, gt boolean, i long, s double, e double, b int, expected long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in*"))
        live.write_batches(live.stream_metrics(stream, (0.5,), late="10 minutes"), out, state).awaitTermination()
        got = spark.read.parquet(out)
        return sorted((r.rec_id, r.complete, r.n_gt, r.n_pred, r.n_matched) for r in got.collect())

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    want = [(1, True, 1, 2, 1), (2, False, 1, 0, 0), (3, True, 0, 1, 0), (4, False, 1, 0, 0), (5, True, 1, 0, 0), (6, True, 1, 0, 0)]
    assert run(2, out, state) == [(3, True, 0, 1, 0)]
    last = max(int(p.name) for p in (tmp_path / "state/commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "state/commits").iterdir():
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()  # as if it was killed between writing and its checkpoint
    assert run(5, out, state) == want
    assert run(5, out, state) == want
    shutil.rmtree(state)


def test_records_that_wait_are_a_table_and_no_python_state(spark, tmp_path):
    """Whole records are scored once, also where the last batch is repeated; the plan of a batch holds no Python."""
    kind = "rec_id long, gt boolean, i long, s double, e double, b int, expected long, ts timestamp"
    batches = [
        [(1, True, 1, 0.0, 4.0, 1, 3), (2, True, 1, 0.0, 4.0, 1, 2), (3, False, 7, 0.0, 1.0, 3, 1)],
        [(1, False, 2, 0.0, 4.0, 1, 3), (1, True, 1, 5.0, 9.0, 1, 3)],
        [(1, False, 3, 8.0, 9.0, 2, 3), (4, True, 1, 0.0, 1.0, 1, 9)],
        [(5, True, 1, 0.0, 1.0, 1, 1)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind.rpartition(",")[0]).withColumn("ts", F.lit(None).cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run(n):
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*[str(tmp_path / f"in[0-{n - 1}]")])
        live.write_whole_records(stream, out, state).awaitTermination()
        return sorted((r.rec_id, r.n_gt, r.n_pred, r.n_matched) for r in spark.read.parquet(out).collect())

    assert run(4) == [(1, 1, 2, 1), (3, 0, 1, 0), (5, 1, 0, 0)]
    last = max(int(p.name) for p in (tmp_path / "state/commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "state/commits").iterdir():
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()  # as if it was killed between writing and its checkpoint
    assert run(4) == [(1, 1, 2, 1), (3, 0, 1, 0), (5, 1, 0, 0)]
    assert sorted(p.name for p in (tmp_path / "state-waiting").iterdir()) == [f"batch={last - 1}", f"batch={last}"]


def test_many_small_files_are_written_by_tasks_alone(spark, tmp_path):
    root = str(tmp_path / "made")
    rows = spark.range(3000).selectExpr("concat('f', id div 3 % 10, '/n ', id div 3, '=x.txt') AS name", "if(id % 3 = 1, null, concat('l', id)) AS line", "-id AS o")
    renamed = []
    old, sinks.file_system = sinks.file_system, lambda r: renamed.append(r) or old(r)
    try:
        sinks.write_files(rows, root, "name", "line", "o")
    finally:
        sinks.file_system = old
    found = {p.relative_to(root).as_posix(): p.read_text() for p in (tmp_path / "made").rglob("*") if p.is_file()}
    assert found == {f"f{k % 10}/n {k}=x.txt": f"l{3 * k + 2}\n\nl{3 * k}\n" for k in range(1000)} and renamed == []


def test_evaluation_parses_records_once(spark, tmp_path):
    from tidemark.operators import metrics
    from tidemark.sources import records

    chunk = {"start": "0", "end": "4", "guardrail": {"C1": "true"}}
    side = {"intervals": {"chunks": {"chunk_1": chunk}, "chunk_order": ["chunk_1"]}}
    write(tmp_path / "iter_1" / "records.jsonl", {"ground_truth": side, "prediction": side}, {"ground_truth": side})
    rows = records.iteration_records(spark, str(tmp_path)).withColumn("rec_id", F.struct("iter", "rec_idx"))
    made = metrics.evaluate(rows, (0.5,), carried=("iter",))
    assert sorted((r.rec_id.rec_idx, r.n_gt, r.n_pred, r.n_matched) for r in made.collect()) == [(0, 1, 1, 1), (1, 1, 0, 0)]
    plan = made._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "text" not in plan and "from_json" not in plan and "parse_json" not in plan


def test_files_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path):
    """No file index in the driver; names, hidden ones and empty files are as Spark's own listing has them."""
    from tidemark.sources import scans

    made = ("a/frame_1.jpg", "a/frame_2.jpg", "a/b c/d+e/frame_3.jpg", "a/.hid/frame_4.jpg", "_tmp/frame_5.jpg", "_k=1/frame_6.jpg", "a/.frame_7.jpg", "frame_8.jpg", "a/x.json", "a/x%20y.safetensors", "a/x.jsonl", "a/b/empty.json")
    for x in made:
        write(tmp_path / x, *([] if "empty" in x else ["x"]))
    (tmp_path / "a/b/empty.json").write_text("")
    (tmp_path / "none").mkdir()
    for glob in ("frame_*.jpg", "*.{json,safetensors}", "*"):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(str(tmp_path))
        want = sorted(r.path.removeprefix("file:") for r in rows.select("path").collect())
        for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
            got = scans.files(spark, root, glob)
            assert sorted(r.path for r in got.collect()) == want and all(f"{r.folder}/{r.name}" == "/".join(r.path.split("/")[-2:]) for r in got.collect())
            assert "binaryFile" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.name for r in scans.files(spark, f"{tmp_path}/a*", "frame_1*").collect()] == ["frame_1.jpg"]  # a pattern
    assert scans.files(spark, f"{tmp_path}/none", "*").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scans.files(spark, f"{tmp_path}/missing", "*")
