import json

import pytest
from pyspark.sql import functions as F

from tidemark.checkpoints import shared_dir
from tidemark.functions import intervals, jsonx, labels, texts
from tidemark.operators import curate, metrics
from tidemark.plans import media
from tidemark.sources import records, scans, sinks


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).head()


def test_strict_scans_raise_and_loose_ones_take_any_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"iteration": 1}\n[1]\n\n{"iteration": 2}\nnope')
    path = str(tmp_path / "a.jsonl")
    got = records.jsonl(spark, path, objects=False).orderBy("line").collect()
    assert [(r.line, r.is_valid, r.record and r.record.iteration) for r in got] == [(0, True, 1), (1, True, None), (3, True, 2), (4, False, None)]
    with pytest.raises(Exception, match="no JSON object"):
        records.jsonl(spark, path, "failfast").collect()


def test_lines_of_a_file_of_many_blocks_are_numbered_through(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("\n".join(json.dumps({"jsonl_record_index": i, "pad": "x" * 50}) for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = records.jsonl(spark, str(tmp_path / "big.jsonl"))
        assert rows.rdd.getNumPartitions() > 1 and rows.where("line != rec_idx").count() == 0 and rows.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_without_segments_or_keys_are_skipped(spark, tmp_path):
    chunk = lambda s, e, **g: {"start": s, "end": e, "guardrail": g}
    side = lambda *c: {"intervals": {"chunks": {f"c{i}": x for i, x in enumerate(c)}, "chunk_order": []}}
    rows = [
        {"ground_truth": side(chunk(0, 4, A=True, B=False)), "prediction": side(chunk(0, 4, A=True))}, {"ground_truth": side(), "prediction": side()},
        {"ground_truth": side(chunk(0, 4)), "prediction": side(chunk(0, 4))}, {"ground_truth": side(chunk("x", 4, A=1), chunk(1, 2, A="yes")), "prediction": side()},
    ]
    (tmp_path / "iter_1").mkdir()
    (tmp_path / "iter_1" / "records.jsonl").write_text("\n".join([*map(json.dumps, rows), "{"]))
    scanned = records.iteration_records(spark, str(tmp_path)).withColumn("rec_id", F.col("rec_idx").cast("long"))
    got = {r.rec_id: r for r in metrics.evaluate(scanned, [0.5], carried=("iter",)).collect()}
    assert [got[i].skip_reason for i in range(5)] == [None, "empty_gt_and_pred", "no_guardrail_keys", None, "json_load_failed"]
    assert (got[0].n_keys, got[0].tp, got[0].tn, got[0].hamming) == (2, 1, 1, 0.0)
    assert (got[3].n_gt, got[3].n_keys, got[3].tp + got[3].fn, got[3].tn) == (1, 1, 0, 1)
    row = metrics.summary_of_usable(metrics.evaluate(scanned, [0.5], carried=("iter",)), "tau", "iter").head()
    assert (row.n_files, row.n_skipped, row.n_records, row.n_f1, row.mean_micro_f1) == (5, 3, 2, 1, 1.0)
    none = metrics.summary_of_usable(metrics.evaluate(scanned.where("rec_id = 1"), [0.5], carried=("iter",)), "tau", "iter").head()
    assert (none.n_files, none.n_skipped, none.n_records, none.pool_f1, none.mean_hamming) == (1, 1, 0, 1.0, 0.0)


def test_answers_that_hold_objects(spark):
    assert jsonx.find_object('{"a": {"b": 1}} tail') == {"a": {"b": 1}} and jsonx.find_object("x {'a': None}") == {"a": None} and jsonx.find_object("none") is None
    assert jsonx.find_object('```json\n{"a": 1}\n``` {"b": 2}') == {"a": 1} and jsonx.find_object("{1, 2}") is None and jsonx.find_object(None) is None
    with pytest.raises(Exception, match="no message content"):
        spark.createDataFrame([('{"choices": []}',)], "p string").select(jsonx.message_content(F.col("p"))).collect()
    with pytest.raises(Exception, match="without a video"):
        spark.createDataFrame([("{}",)], "p string").select(jsonx.video_path(F.col("p"), strict=True)).collect()
    row = spark.createDataFrame([('DESCRIPTION: d GUARDRAIL: {"True crime": False, "C1(x)": True} EXPLANATION: ',)], "t string").select(jsonx.three_part_answer(F.col("t")).alias("p")).head().p
    assert row.labels == {"True crime": "false", "C1(x)": "true"}


def test_grid_rates_and_snaps(spark):
    with pytest.raises(Exception, match="too few places"):
        one(spark, intervals.grid_positions(F.lit(1.0), F.lit(4), 0.5, F.lit("a")))
    with pytest.raises(Exception, match="fps must be positive"):
        one(spark, intervals.time_step(F.lit(0.0)))
    got = one(spark, intervals.grid_positions(F.lit(1.0), F.lit(3), 0.5, F.lit("a")), intervals.even_dimension(F.lit(-1), F.lit(7)), intervals.output_fps(F.lit(0.2)), *intervals.snap_interval(F.lit(1.0), F.lit(1.0), F.lit(9.0), 0.5))
    assert (got.c0, got.c1, got.c2, got.c3, got.c4) == ([0.0, 0.5, 1.0], 6, 1, 1.0, 1.0)
    assert tuple(one(spark, *intervals.snap_interval(F.lit(1.1), F.lit(1.2), F.lit(9.0), 0.5))) == (1.0, 1.5)


def test_paths_titles_and_prompts(spark):
    got = one(spark, texts.full_path(F.lit("x/full/a/b/c.mp4")), texts.full_path(F.lit("dataset/clip/a/v.mp4")), texts.is_canonical(F.lit("real_qa")), texts.slug(F.lit(" ?? ")), texts.last_lines(F.lit("a\nb\nc\n"), 2),
              texts.option_title(F.lit("p"), F.lit("v"), F.lit(1), F.lit(2), F.lit(3), F.lit(0.5)), texts.clip_range(F.lit("1_2.mp4\n")), texts.http_url(F.lit("/x/y"), "/m", "h", 1))
    assert tuple(got) == (None, None, False, "plot", "b\nc", "p | v | left 1 | right 2 | GT 3 | gap 0.500", None, None)
    assert texts.boxed_sections("<box>\nC1: one\nmore\n</box> <box>\nC2: two\n</box>", ("C1", "C3"), {"C3": "d", "C9": "x"}) == {"C1": "C1: one\nmore", "C3": "d"}
    assert one(spark, labels.distinct_in_order(F.array(F.lit("b"), F.lit(""), F.lit("a"), F.lit("b")))).c0 == ["b", "a"]
    with pytest.raises(ValueError):
        labels.mask_of(F.col("x"), [str(i) for i in range(40)])


def test_choices_raise_where_there_is_none(spark):
    rows = spark.range(3)
    with pytest.raises(Exception, match="nothing to pick"):
        curate.pick(rows, rows.withColumnRenamed("id", "v"), "id", "v", F.lit(False)).collect()
    with pytest.raises(Exception, match="no attempt accepted"):
        curate.first_accepted(rows.withColumn("n", F.lit(1)), "id", "n", F.col("id") > 0).collect()
    clips = spark.createDataFrame([("a", "s", 0, "p", ["x"], [], 3.0)], "category string, benchmark string, at int, path string, labels array<string>, subcategories array<string>, duration double")
    assert scans.candidates(clips, ["a"]).count() == 1
    with pytest.raises(Exception, match="no clips to insert for b"):
        scans.candidates(clips, ["a", "b"]).collect()
    assert curate.members(rows, rows.where("id = 1"), "id").count() == 1
    assert {r.id: r.start for r in media.clip_plan(spark.createDataFrame([(1, 5.0)], "id long, duration double"), "id", 9.0).collect()} == {1: 0.0}


def test_tables_have_their_columns(spark, tmp_path):
    table = sinks.report_table(spark.createDataFrame([(1, 0.5)], "iter int, tau double"), sinks.ITERATION_COLUMNS)
    assert table.columns[:4] == ["run", "iteration", "tiou_threshold", "unmatched_policy"] and table.head().iteration == 1
    sinks.write_document(spark, {"a": "é"}, str(tmp_path), "d.json", ascii_only=True)
    assert "\\u00e9" in (tmp_path / "d.json").read_text()
    assert shared_dir(spark)


def every_beginning(text, left, right, read):
    """What the first beginning from the last gives that ends with the text's last bracket."""
    close = text.rfind(right)
    for at in range(close, -1, -1):
        if text[at] == left:
            found = read(text[at : close + 1])
            if found is not None:
                return found
    return None


def test_recovery_is_what_trying_every_bracket_gives():
    import json
    import random

    def a_list(t):
        try:
            return x if isinstance(x := json.loads(t), list) else None
        except ValueError:
            return None

    draw = random.Random(5)
    bits = ["[", "]", "{", "}", '"', "'", "\\", "a", " ", "1", ",", ":", "[1, 2]", '{"a": "b]"}', '{"a": [1, "x\\"]"]}', "{'k': 'v}'}", '"it\'s"', '[{"S": 1}]', '\\"', "{'a': \"it's\"}"]
    for _ in range(20_000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(1, 10)))
        assert jsonx.find_list(text) == every_beginning(text, "[", "]", a_list), text
        assert jsonx.find_object(text) == every_beginning(text, "{", "}", jsonx.read_object), text


def test_recovery_is_linear():
    import time

    for text in ("[" * 1_000_000, "[" * 1_000_000 + " x ]", "[1," * 300_000 + "]", "{" * 1_000_000 + "x}", "[1] " * 250_000 + "x]"):
        start = time.perf_counter()
        assert jsonx.find_list(text) is None and jsonx.find_object(text) is None
        assert time.perf_counter() - start < 1


def test_data_urls_of_long_contents_are_one_line(spark):
    import base64

    from tidemark.functions import texts

    content = b"x" * 200
    got = spark.createDataFrame([(content,)], "c binary").select(texts.data_url(F.col("c"), F.lit("a.png"))).head()[0]
    assert got == "data:image/png;base64," + base64.b64encode(content).decode()


def test_lists_are_recovered_in_small_batches(spark):
    from tidemark.functions import jsonx

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = spark.range(3 * jsonx.BATCH).select("id", F.format_string('x [{"GUARDRAIL": {"C%d(x)": true}}]', F.col("id") % 6 + 1).alias("t"))
    found = rows.select("id", jsonx.interval_categories(F.col("t")).alias("b"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == jsonx.BATCH
    assert found.where("b <> shiftleft(1, cast(id % 6 as int))").count() == 0


def test_annotations_of_many_documents(spark, sf, monkeypatch):
    from tidemark import queries_files

    roots, scan = [], queries_files.scans.annotations
    monkeypatch.setattr(queries_files.scans, "annotations", lambda s, root: roots.append(root) or scan(s, root))
    whole = sorted(map(tuple, queries_files.annotation_scan(spark, sf).collect()))
    monkeypatch.setattr(queries_files, "DOCUMENT", 100)
    assert sorted(map(tuple, queries_files.annotation_scan(spark, sf).collect())) == whole
    sizes = [r.n for r in queries_files.scans.elements(spark, roots[1], queries_files.scans.ANNOTATION, "full.json").groupBy("file").count().withColumnRenamed("count", "n").collect()]
    assert max(sizes) <= 100 < sum(sizes)
