"""Preparation by plan, both dialects of intervals, evaluation of several runs."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dialects
from tidemark.operators import compare
from tidemark.plans import evaluation, preparation
from tidemark.sources import sinks


def test_rejected_plans_alone_are_drawn_again(spark):
    plans = spark.createDataFrame([(i, [[], ["a"], ["a", "b"], ["b", "b"]][i % 4]) for i in range(80)], "sample long, labels array<string>")
    pool = spark.createDataFrame([(i, "ab"[i % 2], 1.0 + i % 9) for i in range(40)], "clip long, label string, duration double")
    safe = spark.createDataFrame([(i, 8.0 + i) for i in range(10)], "recording long, length double")
    rows = preparation.prepare(plans, pool, safe, base=10.0, longest=11.0).collect()
    assert len(rows) == 80 and max(r.attempt for r in rows) > 1 and all(r.attempt == 1 for r in rows if not r.labels)
    for r in rows:
        assert sorted(s.label for s in r.segments) == sorted(r.labels) and all(0 <= s.start < s.end <= r.seconds <= 11 for s in r.segments)
        assert all(a.end <= b.start + 0.5 for a, b in zip(r.segments, r.segments[1:], strict=False))
    made = spark.createDataFrame([(r.labels, r.segments) for r in rows], f"labels array<string>, segments {preparation.SEGMENT}")
    counts = {r.what: r.actual for r in preparation.balance(made, plans).collect()}
    assert counts == {"labels: 0": 20, "labels: 1": 20, "labels: 2": 40, "segments: a": 40, "segments: b": 60}
    with pytest.raises(Exception, match="counts differ"):
        preparation.balance(made.limit(79), plans).collect()
    with pytest.raises(ValueError, match="no valid sample after 2 attempts"):
        preparation.prepare(plans, pool, safe, base=10.0, longest=1.0, attempts=2)
    with pytest.raises(Exception, match="no clips of label"):
        preparation.prepare(spark.createDataFrame([(1, ["z"])], "sample long, labels array<string>"), pool, safe).collect()


def test_structured_intervals_come_first_and_texts_second(spark):
    chunks = {"k2": {"start": 3, "end": 1, "guardrail": {"A": "yes", "B": 0, "C": 2}}, "k1": {"START_SEC": "1", "GUARDRAIL": {"A": "no", "D": True}}, "k3": 5}
    text = "```" + json.dumps([{"START_SEC": 9, "END_SEC": "10"}, 7, {"start": "x"}]) + "```"
    cases = {
        "all": ({"intervals": {"chunks": chunks}, "supervised_span_text": text}, [(1.0, 1.0, ["D"]), (3.0, 3.0, ["A", "C"])]),
        "listed": ({"intervals": {"chunks": chunks, "chunk_order": ["k2", "k9", "k2"]}}, [(3.0, 3.0, ["A", "C"])] * 2),
        "text": ({"intervals": {"chunks": {}}, "supervised_span_text": text}, [(0.0, 0.0, []), (9.0, 10.0, [])]),
        "no list": ({"supervised_span_text": "{}"}, []), "odd": ({"intervals": 5, "supervised_span_text": "[1"}, []), "none": (None, []),
    }
    df = spark.createDataFrame([(k, json.dumps({"prediction": v[0]})) for k, v in cases.items()], "k string, raw string")
    got = df.select("k", dialects.side_intervals(F.try_parse_json("raw"), "prediction").alias("x")).collect()
    assert {r.k: [tuple(x) for x in r.x] for r in got} == {k: v[1] for k, v in cases.items()}
    turns = [{"from": "human", "value": '[{"start": 1}]'}, {"from": "gpt", "value": "[]"}, 3, {"from": "gpt", "value": '[{"start": 2, "end": 4}]'}, {"from": "gpt", "value": '[{"start": 9}]'}]
    df = spark.createDataFrame([(json.dumps({"conversations": turns}),), ("{}",), ("broken",)], "raw string")
    assert [[tuple(x) for x in r.x] for r in df.select(dialects.conversation_intervals(F.try_parse_json("raw")).alias("x")).collect()] == [[(2.0, 4.0, [])], [], []]
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("k", 2, "mid"), ("j", 1, None)], "key string, n int, v string")
    assert {r.key: r.v for r in compare.last_wins(rows, "key", "n").collect()} == {"k": "new", "j": None}


def line(s, label=True):
    side = {"intervals": {"chunks": {"c": {"start": s, "end": s + 2, "guardrail": {"A": label}}}, "chunk_order": ["c"]}}
    return json.dumps({"ground_truth": side, "prediction": side})


def test_runs_are_read_by_model_if_any_has_models(spark, tmp_path):
    def put(name, *lines):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("\n".join(lines))

    put("one/iter_1/records.jsonl", line(1), "{broken")
    put("one/iter_2/records.jsonl", line(1))
    put("two/iter_1/records.jsonl", line(2))
    roots = {n: str(tmp_path / n) for n in ("one", "two")}
    mode, rows = evaluation.report(spark, roots, (0.5,))
    got = {(r.run, r.model): (r.n_files, r.n_skipped, r.n_records, r.mean_micro_f1) for r in rows.collect()}
    assert mode == evaluation.ITERATIONS
    assert got == {("one", "1"): (2, 1, 1, 1.0), ("one", "2"): (1, 0, 1, 1.0), ("two", "1"): (1, 0, 1, 1.0), ("one", "all"): (3, 1, 2, 1.0), ("two", "all"): (1, 0, 1, 1.0), ("all", "all"): (4, 1, 3, 1.0)}
    put("two/m/x.jsonl", line(1), line(1))  # equal lines are records of their own
    mode, rows = evaluation.report(spark, roots, (0.5, 0.3, 0.5))
    found = rows.collect()
    assert mode == evaluation.MODELS and sorted({r.tau for r in found}) == [0.3, 0.5]
    assert {(r.run, r.model): r.n_files for r in found if r.tau == 0.5} == {("two", "m/x"): 2, ("two", "all"): 2, ("all", "all"): 2}
    table = sinks.side_by_side(rows.where("model <> 'all' and tau = 0.5"), "model", "run", ["one", "two"], "mean_micro_f1").collect()
    assert [tuple(r) for r in table] == [("m/x", "—", "1.000")]
