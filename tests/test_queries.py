import pytest
from pyspark.sql import functions as F

from tests.oracle import spark_rows, sql_rows
from tidemark import queries as core
from tidemark.operators import compare, matching, metrics, ranges, sizes


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_agrees_with_sql(spark, sf, name):
    assert spark_rows(core.QUERIES[name](spark, sf)) == sql_rows(core.SQL[name], sf)


def test_entry_has_a_row_per_model(spark, sf):
    assert core.entry(spark, sf).count() == 3


#: tau, model: records, hit, mean micro F1 over hits, over all, pooled tp, fp, fn, tn; made by an independent program
GOLDEN = {
    (0.3, 0): (249, 183, 0.044993, 0.037083, 61, 1341, 1333, 15085),
    (0.5, 1): (250, 116, 0.030469, 0.022138, 21, 1372, 1306, 15967),
    (0.7, 2): (250, 52, 0.012494, 0.010599, 5, 1404, 1420, 17037),
}


def test_summary_has_the_golden_values(spark):
    rows = core.model_summary_tau_sweep(spark, "/root/testdata/sf0.01").collect()
    found = {(r.tau, r.model_id): (r.n_records, r.n_hit, r.mean_micro_f1, r.mean_micro_f1_all, r.sum_tp, r.sum_fp, r.sum_fn, r.sum_tn) for r in rows}
    for k, v in GOLDEN.items():
        assert found[k] == pytest.approx(v, abs=1e-6)


def test_pooled_temporal_metrics_agree_with_a_sequential_match(spark, sf):
    from collections import defaultdict

    from tidemark.sources.events import segments

    sides = defaultdict(lambda: ([], []))
    for r in segments(spark, sf).collect():
        for j in range(6):
            if r.b >> j & 1:
                sides[j + 1][not r.gt].append((r.i, r.s, r.e))
    got = {r.label: r for r in core.temporal_category_metrics_pooled(spark, sf).collect()}
    for label, (gts, preds) in sides.items():
        pairs = []
        for g, gs, ge in gts:
            for p, ps, pe in preds:
                if (inter := min(ge, pe) - max(gs, ps)) > 0:
                    pairs.append((-inter / (max(ge, pe) - min(gs, ps)), p, g))
        for tau, n in ((1e-9, "n_any"), (0.5, "n_05"), (0.7, "n_07")):
            used_p, used_g, t = set(), set(), []
            for nt, p, g in sorted(x for x in pairs if -x[0] >= tau):
                if p not in used_p and g not in used_g:
                    used_p.add(p)
                    used_g.add(g)
                    t.append(-nt)
            assert got[label][n] == len(t)
            assert got[label]["tiou" + n[1:]] == (pytest.approx(sum(t) / len(t), abs=1e-5) if t else None)


def test_evaluation_plan_has_one_scan_one_shuffle_by_record_and_no_python(spark, sf):
    plan = core.record_metrics_strict(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning(rec_id") == 1


def test_entry_module_works_without_the_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "tidemark" / "llm" / "__pycache__").mkdir(parents=True)  # what a deleted folder may leave
    code = "import __spark_entry__ as e; assert 'greedy_match' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_frames_are_planned_for_every_event(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert core.frame_times(spark, sf).select("event_id").distinct().count() == events.select("event_id").distinct().count()


def test_large_records_are_matched_by_time_buckets(spark, sf):
    """Only small records are gathered."""
    rows = [(1, gt, 2 * k + gt, 3.0 * k + 0.1 * gt, 3.0 * k + 2 + 0.1 * gt) for k in range(3000) for gt in (0, 1)]
    df = spark.createDataFrame(rows, "rec_id long, gt int, i long, s double, e double").withColumn("gt", F.col("gt") == 1)
    assert sorted((r.g, r.p) for r in matching.record_matches(df, 0.5).collect()) == [(2 * k + 1, 2 * k) for k in range(3000)]
    small, large = sizes.split(core.hot_record(core.segments(spark, sf)), "rec_id", limit=40)
    assert small.groupBy("rec_id").count().agg(F.max("count")).head()[0] <= 40 and [r.rec_id for r in large.select("rec_id").distinct().collect()] == [-1]
    assert small.count() + large.count() == core.segments(spark, sf).count()


@pytest.mark.parametrize("limit", [0, 12])
def test_either_route_gives_the_same_rows(spark, sf, limit):
    rows = core.with_keys(core.hot_record(core.segments(spark, sf)))
    for policy, keys in (("strict", None), ("strict", "kb"), ("matched_only", "kb")):
        one, two = (metrics.record_metrics(rows, core.TAUS, policy, carried=("rec_id",)[:0], keys=keys, limit=n) for n in (10**9, limit))
        flat = lambda df: spark_rows(df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("string").alias(c) for c, t in df.dtypes]))
        assert flat(one) == flat(two)
    for order in ("gt", "pred"):
        one, two = (spark_rows(matching.matches_at(rows, [0.3, 0.7], order, n)) for n in (10**9, limit))
        assert one == two
    assert spark_rows(matching.record_best_overlaps(rows, 10**9)) == spark_rows(matching.record_best_overlaps(rows, limit))
    assert spark_rows(matching.record_pairs(rows, 0.3, 10**9)) == spark_rows(matching.record_pairs(rows, 0.3, limit))


def test_unions_and_overlaps_by_scan_against_brute_force(spark):
    import random

    draw = random.Random(3)
    rows = [(k, bool(draw.getrandbits(1)), float(s := draw.randrange(0, 4000)), float(s + draw.choice([0, 1, 2, 3, 40]) - draw.choice([0, 0, 1]))) for k in (1, 2, None) for _ in range(5 if k == 2 else 700)]
    rows += [(4, True, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "k long, gt boolean, s double, e double").repartition(3)
    for limit in (10**9, 20):
        sets = {}
        for k, side, s, e in rows:
            sets.setdefault((k, side), set()).update(range(int(s), int(e)))
        got = {(r.k, r.gt): r.d for r in ranges.merged(df, "k", "gt", limit=limit).groupBy("k", "gt").agg(F.sum(F.col("e") - F.col("s")).alias("d")).collect()}
        assert got == {key: len(x) for key, x in sets.items() if x}
        both = {r.k: (r.a, r.b, r.both) for r in ranges.shared(df, "k", limit=limit).collect()}
        assert both == {k: (len(a := sets.get((k, True), set())), len(b := sets.get((k, False), set())), len(a & b)) for k in {r[0] for r in rows}}


def test_every_page_looks_up_any_other(spark):
    rows = spark.createDataFrame([(1, ["a"]), (3, ["a"]), (5, ["b", "a"]), (7, ["c"])], "id long, keys array<string>")
    assert sorted(tuple(r) for r in compare.lookup_others(rows).collect()) == [(1, 0, 3), (3, 0, 1), (5, 1, 1)]
