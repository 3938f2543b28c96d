"""Functions in SQL, and result folders as a data source and as a stream."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tests.oracle import spark_rows
from tidemark.functions import catalog
from tidemark.operators import matching
from tidemark.sources import datasource, records
from tidemark.sources.events import segments


def line(i, **more):
    side = {"intervals": {"chunks": {"chunk_1": {"start": i, "end": i + 1.5, "guardrail": {"C1": True}}}, "chunk_order": ["chunk_1"]}}
    return json.dumps({"iteration": 1, "ground_truth": side, "prediction": side} | more)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "a b+c"
    for name, text in {
        "iter_1/records.jsonl": f"{line(1)}\n\n{{broken\n[1]\n{line(2, jsonl_record_index='7')}\n",
        "iter_2/records.jsonl": line(3),
        "iter_2/pred_4.json": line(4),
        "ITER_3/pred_5.json": line(5),
        "iter_3_pred_6.json": "{broken",
        "m 1/d/record.jsonl": f"{line(8)}\n{line(9, jsonl_record_index='x')}\n{{\"a\": NaN}}",
        "m2.v1.jsonl": line(10),
        "_hidden/records.jsonl": "x",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_source_reads_what_the_scan_reads(spark, folder):
    datasource.register(spark)
    read = lambda **o: datasource.with_records(spark.read.format(datasource.NAME).options(**o).load(folder))
    typed = lambda df, *c: sorted((tuple(r) for r in df.select(*c, "rec_idx", "is_valid", F.to_json("record")).collect()), key=repr)
    assert typed(read(), "iter") == typed(records.iteration_records(spark, folder), "iter")
    assert [r[:3] for r in typed(read(), "iter")] == [(1, 0, True), (1, 2, False), (1, 3, False), (1, 7, True), (2, 0, True), (3, 5, True), (3, 6, False)]
    assert typed(read(layout="models"), "model") == typed(records.model_results(spark, folder), "model")
    assert {r.model for r in read(layout="models").collect()} == {"m 1/d/record", "m2.v1"}
    with pytest.raises(Exception, match="no JSON object"):
        read(mode="failfast").collect()
    with pytest.raises(Exception, match="layout is one of"):
        read(layout="x").collect()


def test_bad_record_index_raises_in_iterations_only(spark, tmp_path):
    (tmp_path / "iter_1").mkdir()
    (tmp_path / "iter_1/records.jsonl").write_text(line(1, jsonl_record_index="x"))
    datasource.register(spark)
    for rows in (records.iteration_records(spark, str(tmp_path)), spark.read.format(datasource.NAME).load(str(tmp_path))):
        with pytest.raises(Exception, match="record index that is no number"):
            rows.collect()


def test_skipped_files_are_never_opened(spark, folder):
    import os

    datasource.register(spark)
    os.remove(f"{folder}/iter_1/records.jsonl")
    os.symlink("/nowhere", f"{folder}/iter_1/unreadable")
    os.makedirs(f"{folder}/iter_9")
    with open(f"{folder}/iter_9/records.jsonl", "w") as f:
        f.write(line(1, jsonl_record_index="raises when read"))
    rows = spark.read.format(datasource.NAME).load(folder)
    assert {r.iter for r in rows.where("iter < 9 and iter >= 2").collect()} == {2, 3}
    assert [r.rec_idx for r in rows.where("iter in (3, 4) and is_valid").collect()] == [5]
    assert rows.where("iter = 77").count() == 0
    with pytest.raises(Exception, match="no number"):
        rows.where("rec_idx = 0").collect()
    reader = datasource.RecordReader({"path": folder, "layout": "models"})
    assert list(reader.pushFilters([datasource.StringStartsWith(("model",), "m2"), datasource.EqualTo(("line",), 1)])) == [datasource.EqualTo(("line",), 1)]
    assert [f.model for t in reader.partitions() for f in t.files] == ["m2.v1"]


def test_small_files_share_a_task(monkeypatch):
    monkeypatch.setattr(datasource, "TASK_BYTES", 10)
    files = [datasource.File(str(i), n, 0, "lines") for i, n in enumerate((4, 5, 2, 30, 1))]
    assert [[f.size for f in t.files] for t in datasource.tasks(files)] == [[4, 5], [2], [30], [1]]


def test_stream_takes_each_file_once(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    datasource.register(spark)

    def run():
        rows = spark.readStream.format(datasource.NAME).option("settled", "0").load(str(root)).select("iter", "rec_idx", "is_valid")
        rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(out)).collect())

    for k in (1, 2):
        (root / f"iter_{k}").mkdir(parents=True)
        (root / f"iter_{k}/records.jsonl").write_text(line(k) + "\n{broken")
        time.sleep(0.05)
        assert run() == [(i, n, n == 0) for i in range(1, k + 1) for n in (0, 1)]
    assert len(run()) == 4


def test_functions_in_sql(spark, sf):
    segments(spark, sf).createOrReplaceTempView("seg_rows")
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("some_events")
    catalog.register(spark, "some_events")
    made = spark.sql("SELECT * FROM segments()")
    assert spark_rows(made.selectExpr("rec_id", "model_id", "iter", "CAST(gt AS INT) gt", "i", "s", "e", "b")) == spark_rows(segments(spark, sf).selectExpr("rec_id", "model_id", "iter", "CAST(gt AS INT) gt", "i", "s", "e", "b"))
    row = spark.sql("SELECT tiou(0, 4, 2, 6) a, tiou(0, 1, 1, 2) b, label_codes(5) c, recover_json_list('x [{\"a\": 1}]') d, recover_json_object('so {\"a\": 1}') e").head()
    assert (round(row.a, 6), row.b, row.c, row.d, row.e) == (0.333333, 0.0, "C1,C3", '[{"a": 1}]', '{"a": 1}')
    pairs = "SELECT * FROM VALUES (1, 1L, 1L, 0.9D), (1, 1L, 2L, 0.9D), (1, 2L, 2L, 0.5D), (1, 3L, 3L, 0.1D), (2, 1L, 2L, 0.6D), (3, 1L, 1L, CAST(NULL AS DOUBLE)) AS p(k, g, p, t)"
    got = spark.sql(f"SELECT * FROM greedy_match(TABLE({pairs}), 0.3D, 'k')").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, 0.9), (1, 2, 2, 0.5), (2, 1, 2, 0.6)]
    with pytest.raises(Exception, match="has no column"):
        spark.sql(f"SELECT * FROM greedy_match(TABLE({pairs}), 0.3D)").collect()
    spans = "SELECT * FROM VALUES ('a', 0D, 2D), ('a', 2D, 3D), ('a', 5D, 5D), ('a', 7D, 8D), ('b', NULL, 1D) AS r(k, s, e)"
    assert sorted(tuple(r) for r in spark.sql(f"SELECT * FROM merged_ranges(TABLE({spans}), 'k')").collect()) == [("a", 0.0, 3.0), ("a", 7.0, 8.0)]
    text = '[{"START_SEC": 1, "END_SEC": 2, "GUARDRAIL": {"C1": true}}, {"START_SEC": "x"}, {"START_SEC": 3, "END_SEC": 1}, 5]'
    assert [tuple(r) for r in spark.createDataFrame([(text,), ("none",), (None,)], "t string").createOrReplaceTempView("answers") or spark.sql("SELECT x.* FROM answers, LATERAL answer_intervals(t) x").collect()] == [(0, 1.0, 2.0, "", '{"C1": true}')]
    stream = spark.sql("SELECT rec_id, g, p FROM greedy_match(TABLE(SELECT g.rec_id, g.i g, p.i p, tiou(g.s, g.e, p.s, p.e) t FROM segments() g JOIN segments() p ON g.rec_id = p.rec_id AND g.gt AND NOT p.gt), 0.3D)")
    assert spark_rows(stream) == spark_rows(matching.record_matches(segments(spark, sf), 0.3).drop("t"))
