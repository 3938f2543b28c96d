import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import intervals, jsonx, labels, texts
from tidemark.operators import compare, curate, matching, metrics, ranges
from tidemark.plans import media

SEGMENT = "rec_id long, gt boolean, i long, s double, e double, b int"


def tiou(a, b):
    inter = min(a[1], b[1]) - max(a[0], b[0])
    return inter / (max(a[1], b[1]) - min(a[0], b[0])) if inter > 0 else 0.0


def sequential(gt, pred, tau, order):
    pairs = [(-t, *((g, p) if order == "gt" else (p, g))) for g, x in gt.items() for p, y in pred.items() if (t := tiou(x, y)) >= tau]
    used, out = (set(), set()), []
    for _, a, b in sorted(pairs):
        if a not in used[0] and b not in used[1]:
            used[0].add(a)
            used[1].add(b)
            out.append((a, b) if order == "gt" else (b, a))
    return sorted(out)


span = st.tuples(st.integers(0, 12), st.integers(1, 8)).map(lambda x: (float(x[0]), float(x[0] + x[1])))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.lists(span, max_size=5), st.lists(span, max_size=5)), min_size=1, max_size=12), st.sampled_from(["gt", "pred"]), st.sampled_from([-1.0, 0.3, 0.5]))
def test_greedy_match_is_the_sequential_one(spark, records, order, tau):
    rows, want = [], {}
    for r, (gt, pred) in enumerate(records):
        rows += [(r, True, i, s, e, 0) for i, (s, e) in enumerate(gt)] + [(r, False, i, s, e, 0) for i, (s, e) in enumerate(pred)]
        want[r] = sequential(dict(enumerate(gt)), dict(enumerate(pred)), tau, order)
    df = spark.createDataFrame(rows, SEGMENT)
    got = {x.rec_id: sorted((m.g, m.p) for m in x.matches) for x in matching.matched(df, [tau], order=order).collect()}
    assert got == {r: m for r, m in want.items() if records[r] != ([], [])}


@settings(max_examples=4, deadline=None)
@given(st.lists(span, max_size=14), st.lists(span, max_size=14))
def test_peeling_is_the_sequential_match(spark, gt, pred):
    side = lambda x: spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate(x)], "k long, i long, s double, e double")
    pairs = matching.overlap_join(side(gt), side(pred), "k", 3.0)
    got = sorted((r.g, r.p) for r in matching.peel(pairs, "k").collect())
    assert got == sequential(dict(enumerate(gt)), dict(enumerate(pred)), 1e-9, "pred")


def test_pairs_by_length_class_are_the_pairs_by_bucket(spark):
    import random

    draw = random.Random(4)
    rows = [(draw.randrange(2), i, s := draw.uniform(0, 500), s + draw.choice([0.0, 0.01, 0.5, 1.0, 3.0, 3.0, 40.0, 300.0]) * draw.uniform(0.7, 1.3)) for i in range(1200)]
    left, right = (spark.createDataFrame(rows[k::2] + [(0, 9000 + k, 8.0, 16.0), (0, 9100 + k, -8.0, -4.0)], "k long, i long, s double, e double") for k in (0, 1))
    for tau in (0.2, 0.5, 0.7, 0.95, 1.0):
        want = sorted((r.k, r.g, r.p) for r in matching.overlap_join(left, right, "k").where(F.col("t") >= tau).collect())
        assert sorted((r.k, r.g, r.p) for r in matching.tiou_join(left, right, "k", tau).collect()) == want and want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(span, max_size=6), min_size=1, max_size=10))
def test_union_of_ranges(spark, sets):
    def union(x):
        return {t / 2 for s, e in x for t in range(int(2 * s), int(2 * e))}

    df = spark.createDataFrame([(k, s, e) for k, x in enumerate(sets) for s, e in x], "k long, s double, e double")
    got = {r.k: r.d for r in ranges.merged(df, "k").groupBy("k").agg(F.sum(F.col("e") - F.col("s")).alias("d")).collect()}
    assert got == {k: len(union(x)) / 2 for k, x in enumerate(sets) if x}
    arrays = spark.createDataFrame([(k, list(x), list(sets[0])) for k, x in enumerate(sets)], "k long, a array<struct<s:double,e:double>>, b array<struct<s:double,e:double>>")
    iou = {r.k: r.x for r in arrays.select("k", ranges.union_iou(ranges.union_of(F.col("a")), ranges.union_of(F.col("b"))).alias("x")).collect()}
    for k, x in enumerate(sets):
        a, b = union(x), union(sets[0])
        assert iou[k] == pytest.approx(1.0 if not a | b else len(a & b) / len(a | b))


def test_record_metrics_of_one_sided_and_empty_label_records(spark):
    rows = [(1, True, 1, 0.0, 4.0, 1), (2, False, 1, 0.0, 4.0, 3), (3, True, 1, 0.0, 4.0, 0), (3, False, 2, 0.0, 4.0, 0), (4, True, 1, 0.0, 2.0, 1), (4, False, 2, 9.0, 10.0, 1)]
    df = spark.createDataFrame(rows, SEGMENT)
    got = {r.rec_id: r for r in metrics.record_metrics(df, [0.5]).collect()}
    assert (got[1].fn, got[1].micro_f1, got[1].gt_coverage, got[1].pred_match_rate) == (1, 0.0, 0.0, 1.0)
    assert (got[2].fp, got[2].gt_coverage, got[2].n_rows) == (2, 1.0, 1)
    assert (got[3].micro_f1, got[3].macro_f1, got[3].tn, got[3].subset_acc, got[3].mean_tiou) == (1.0, 1.0, 6, 1.0, 1.0)
    assert (got[4].tp, got[4].fp, got[4].fn, got[4].n_matched) == (0, 1, 1, 0)
    loose = {r.rec_id: r for r in metrics.record_metrics(df, [0.5], "matched_only").collect()}
    assert (loose[1].micro_f1, loose[1].subset_acc, loose[1].hamming, loose[1].n_rows) == (1.0, 0.0, 0.0, 0)
    with pytest.raises(ValueError):
        metrics.record_metrics(df, [0.5], "other")


def test_headline_falls_back_to_all_records(spark):
    df = spark.createDataFrame([(1, True, 1, 0.0, 4.0, 1), (2, False, 1, 0.0, 4.0, 1)], SEGMENT)
    row = metrics.summary(metrics.record_metrics(df, [0.5]), "tau").head()
    assert (row.n_hit, row.mean_micro_f1, row.mean_tiou, row.pool_f1, row.pool_acc) == (0, 0.0, 0.0, 0.0, round(10 / 12, 6))


def test_coverage_cases(spark):
    shots = {"gap": [(0, 10), (12, 20)], "late": [(6, 20)], "large": [(0, 5), (11, 20)], "overlap": [(0, 10), (9, 20)], "tail": [(0, 10)]}
    rows = [(k, i, float(s), float(e), 20.0) for k, x in shots.items() for i, (s, e) in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, i long, s double, e double, d double")
    assert {r.k: r.covered for r in ranges.coverage(df, "k", "d").collect()} == {"gap": True, "late": False, "large": False, "overlap": False, "tail": False}


def test_split_takes_one_of_three_and_one_of_ten(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b" if i < 13 else "c") for i in range(14)], "id long, g string")
    got = curate.stratified_split(df, "g", "id").where("part = 'eval'").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"a": 1, "b": 1, "c": 1}
    assert curate.stratified_split(df, "g", "id").count() == 14


def test_samples_collect_their_reasons_in_order(spark):
    cols = "sample string, category string, duration double, s double, e double, b int, standard boolean, ord int, is_full boolean"
    rows = [
        ("ok", "x", 10.0, 0.0, 9.0, 1, True, 1, False), ("long", "x", 90.0, 0.0, 90.0, 0, True, 1, False), ("bad", "x", 10.0, 5.0, 2.0, 1, True, 1, False),
        ("full", "x", 10.0, None, None, 2, False, 1, True), ("full", "x", 10.0, None, None, 4, True, 2, True),
    ]
    got = {r.sample: r for r in curate.collect_samples(spark.createDataFrame(rows, cols), include_benign=False).collect()}
    assert got["ok"].reasons == [] and got["long"].reasons == ["over_duration", "benign"] and got["bad"].reasons == ["bad_clip_range", "missing_shots", "benign"]
    assert got["full"].reasons == [] and (got["full"].shots[0].e, got["full"].shots[0].b) == (10.0, 4)


def test_schedule_shift_balance_and_dispositions(spark):
    groups = spark.createDataFrame([("a",), ("b",)], "name string")
    slots = curate.schedule(groups, 2, 1, 2, [("a", "b")])
    assert sorted(len(r.labels) for r in slots.collect()) == [0, 0, 1, 1, 2, 2]
    moved = curate.shifted(spark.createDataFrame([(1, 0.0, 2.0), (1, 5.0, 1.0), (1, 6.0, 1.0)], "k long, at double, length double"), "k")
    assert sorted(r.start for r in moved.collect()) == [0.0, 7.0, 9.0]
    assert curate.assert_balanced(groups, groups, "name").count() == 2
    with pytest.raises(Exception, match="counts differ"):
        curate.assert_balanced(groups, groups.limit(1), "name").collect()
    got = curate.dispositions(spark.range(4), [("two", F.col("id") == 2), ("even", F.col("id") % 2 == 0)]).collect()
    assert [r.disposition for r in got] == ["even", "included", "two", "included"]


def test_lookup_takes_the_first_key_and_the_first_owner(spark):
    kind = "id long, keys array<string>, ordinal long"
    index = spark.createDataFrame([(10, ["a", "b"], 1), (11, ["b", "c"], 2)], kind)
    probes = spark.createDataFrame([(1, ["x", "b", "a"], 1), (2, ["c", "a"], 2), (3, ["z"], 3)], kind)
    assert {(r.id, r.hit_at, r.match) for r in compare.prioritized_lookup(probes, index).collect()} == {(1, 1, 10), (2, 0, 11)}
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "key string, n int, v string")
    assert compare.last_wins(rows, "key", "n").head().v == "new"
    pick = spark.createDataFrame([([], [1])], "a array<int>, b array<int>").select(*[c.alias(n) for n, c in zip("xy", compare.ground_truth_choice(F.col("a"), F.col("b")), strict=True)]).head()
    assert (pick.x, pick.y) == ([1], "external")
    empty = spark.createDataFrame([("k", True, 0.5, 0, 0, 0)], "parent string, label_mismatch boolean, iou_gap double, n_left int, n_right int, n_gt int")
    assert compare.filter_items(empty, parents=[]).count() == 0 and compare.filter_items(empty, parents=["k"]).count() == 1 and compare.filter_items(empty, with_intervals=True).count() == 0


NOISY = {
    'talk [x] Assistant\n[{"START_SEC": 1, "END_SEC": 2.5, "GUARDRAIL": {"C1": true}}]': [(1.0, 2.5, 1)],
    '[{"START_SEC": "3", "END_SEC": 4}] trailing words': [(3.0, 4.0, 0)],
    '[[{"START_SEC": 5, "END_SEC": 1}, {"START_SEC": 5, "END_SEC": 5}, 7, {"END_SEC": 1}]': [(5.0, 5.0, 0), (0.0, 1.0, 0)],
    '[{"START_SEC": "x", "END_SEC": 4}, {"START_SEC": 1, "END_SEC": 2, "GUARDRAIL": {"C2(any)": "false", "C6": 0, "C3": []}}]': [(1.0, 2.0, 2)],
    "no list": None,
}


def test_answers_are_recovered_from_noise(spark):
    df = spark.createDataFrame([(t,) for t in NOISY], "t string").select("t", jsonx.parse_answer(F.col("t")).alias("x"))
    assert {r.t: r.x and [(x.s, x.e, x.b) for x in r.x] for r in df.collect()} == NOISY
    payload = df.select("t", jsonx.to_payload(F.col("x")).alias("p")).where("t = 'no list'").head().p
    assert (payload.parse_ok, payload.chunks, payload.chunk_order) == (False, {}, [])
    assert jsonx.find_list("x [1] y]") is None and jsonx.find_list("[1] [2]") == [2] and jsonx.find_list(None) is None


def test_chunk_orders(spark):
    df = spark.createDataFrame([({"c10": 1, "c2": 2, "a": 3}, ["c2", "zz", "c2"])], "m map<string,int>, o array<string>")
    row = df.select(jsonx.ordered_chunks(F.col("m"), F.col("o")).alias("x"), jsonx.listed_chunks(F.col("m"), F.col("o")).alias("y"), jsonx.listed_chunks(F.col("m"), F.array().cast("array<string>")).alias("z")).head()
    assert (row.x, row.y, row.z) == ([2, 2, 3, 1], [2, 2], [1, 2, 3])
    raw = spark.createDataFrame([({"START_SEC": "5", "end": "2", "GUARDRAIL": '{"C1": "Yes", "C2": 0}'},)], "m map<string,string>")
    assert raw.select(jsonx.display_interval(F.col("m")).alias("x")).head().x.asDict() == {"s": 5.0, "e": 5.0, "labels": ["C1"]}


def test_truth_rules_and_labels(spark):
    raw = ["true", "false", "null", "0", "2", "1.5", '"x"', '""', "[]", '"yes"', '"2"']
    df = spark.createDataFrame([(x,) for x in raw], "r string").select(labels.true_number(F.col("r")).alias("n"), labels.true_python(F.col("r")).alias("p"), labels.true_word(F.col("r")).alias("w"))
    got = df.collect()
    assert [r.n for r in got] == [True, False, False, False, True, True, False, False, False, False, False]
    assert [r.p for r in got] == [True, False, False, False, True, True, True, False, False, True, True]
    assert [r.w for r in got] == [True, False, False, False, True, True, False, False, False, True, False]
    flags = json.dumps({"C2 other": True, "C2": False, "C2(x)": True})
    row = spark.createDataFrame([(flags,)], "r string").select(labels.label_bits(labels.raw_map(F.col("r"))).alias("b"), labels.is_standard(labels.raw_map(F.col("r"))).alias("s")).head()
    assert (row.b, row.s) == (0, False)


def test_times_texts_and_plans(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 2.2), (4, -1.0)], "id long, d double")
    plan = media.frame_plan(df, "id", "d", 1.0).collect()
    assert sorted((r.id, r.t) for r in plan) == [(1, 0.0), (2, 0.0), (3, 0.0), (3, 1.0), (3, 2.0), (4, 0.0)]
    path = spark.createDataFrame([("data/full/cat/a.b.mp4", "x "), ("12_30.mp4", " é-_ü !")], "p string, t string")
    row = path.select(texts.path_variants(F.col("p")).alias("v"), texts.strip(F.col("t")).alias("t"), texts.sanitize(F.col("t")).alias("z"), texts.clip_range(F.col("p")).alias("c"), texts.parent_group(F.col("p"), F.lit("none"), ("full",)).alias("g")).collect()
    assert row[0].v == ["data/full/cat/a.b.mp4", "a.b.mp4", "a.b", "full/cat/a.b.mp4"] and row[0].t == "x" and row[0].g == "data / cat" and row[0].c is None
    assert row[1].z == "é-_ü" and (row[1].c.s, row[1].c.e) == (12.0, 30.0) and row[1].g == "none"
    snaps = df.where("id = 3").select(intervals.snap(F.lit(1.25), 0.5, "floor").alias("a"), intervals.snap(F.lit(1.25), 0.5).alias("b"), intervals.snap(F.lit(1.3), 0).alias("c")).head()
    assert (snaps.a, snaps.b, snaps.c) == (1.0, 1.0, 1.3)
    pairs = spark.createDataFrame([(1, 30.0, 10.0, 3), (2, 0.0, 70.0, 1)], "id long, safe double, harmful double, b int")
    got = {r.id: r for r in media.insertion_plan(pairs, "id").collect()}
    assert sum(x.b for x in got[1].intervals) == 3 and got[1].intervals[-1].e == 40.0 and [(x.s, x.e) for x in got[2].intervals] == [(0.0, 60.0)]
    asked = media.infer(df, lambda pdf: pdf.assign(parse_ok=pdf.d > 0)[["id", "parse_ok"]], "id long, parse_ok boolean")
    again = media.retry(asked, df.select("id", F.lit(True).alias("parse_ok")).where("id = 1"), "id")
    assert {r.id: (r.parse_ok, r.retried) for r in again.collect()} == {1: (True, True), 2: (True, False), 3: (True, False), 4: (False, False)}


@pytest.mark.parametrize("order", ["pred", "gt"])
def test_spread_matching_and_best_overlaps_with_copies_and_ties_agree_with_brute_force(spark, order):
    """Few distinct times, so many intervals are equal and many overlaps tie."""
    import random

    from tidemark.operators import matching

    draw = random.Random(5)
    rows = [(k, bool(draw.getrandbits(1)), i, s := float(draw.randrange(12)), s + draw.choice([0, 1, 2, 3, 9])) for k in (1, 2) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, gt boolean, i long, s double, e double")
    want, best = [], {}
    for k in (1, 2):
        pairs = []
        for _, _, g, gs, ge in (r for r in rows if r[0] == k and r[1]):
            for _, _, p, ps, pe in (r for r in rows if r[0] == k and not r[1]):
                if (inter := min(ge, pe) - max(gs, ps)) > 0:
                    t = inter / (max(ge, pe) - min(gs, ps))
                    pairs.append((-t, *((p, g) if order == "pred" else (g, p)), g, p))
                    for side, x in ((True, g), (False, p)):
                        best[k, side, x] = max(t, best.get((k, side, x), 0))
        used = set()
        for nt, _, _, g, p in sorted(pairs):
            if ("g", g) not in used and ("p", p) not in used:
                used |= {("g", g), ("p", p)}
                want.append((k, g, p, round(-nt, 9)))
    got = [(r.k, r.g, r.p, round(r.t, 9)) for r in matching.greedy_spread(df, "k", 1e-9, order).collect()]
    assert sorted(got) == sorted(want)
    sums = {(r.k, r.gt): r.best for r in matching.best_spread(df, "k").collect()}
    assert sums == {key: pytest.approx(sum(t for (k, side, _), t in best.items() if (k, side) == key)) for key in sums} and len(sums) == 4


@pytest.mark.parametrize("held", [40, 300_000])
def test_spread_matching_is_the_same_however_it_is_dealt(spark, held):
    """Copies, ties and chains over many ranges of time; few pairs a task leave much to further turns and to rounds of best pairs."""
    import random

    from tidemark.operators import matching

    draw = random.Random(7)
    rows = [(1, bool(draw.getrandbits(1)), i, s := draw.randrange(120) / 4, s + draw.choice([0.25, 0.5, 1, 1.5, 6])) for i in range(300)]
    pairs = []
    for _, _, g, gs, ge in (r for r in rows if r[1]):
        for _, _, p, ps, pe in (r for r in rows if not r[1]):
            if (inter := min(ge, pe) - max(gs, ps)) > 0:
                pairs.append((-inter / (max(ge, pe) - min(gs, ps)), p, g))
    used, want = set(), []
    for nt, p, g in sorted(pairs):
        if ("g", g) not in used and ("p", p) not in used:
            used |= {("g", g), ("p", p)}
            want.append((g, p, round(-nt, 9)))
    df = spark.createDataFrame(rows, "k long, gt boolean, i long, s double, e double")
    got = [(r.g, r.p, round(r.t, 9)) for r in matching.greedy_spread(df, "k", 0.05, held=held).collect()]
    assert sorted(got) == sorted(x for x in want if x[2] >= 0.05)


def test_a_chain_of_worse_and_worse_pairs_needs_few_jobs(spark, monkeypatch):
    """Each pair is the best for both only once the one before it is taken: rounds of best pairs alone would be 50."""
    from tidemark.operators import matching

    wrote, write = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df, *name: wrote.append(1) or write(df, *name))
    starts = [0.0]
    for j in range(99):
        starts.append(starts[-1] + 5 + j / 50)
    df = spark.createDataFrame([(1, j % 2 == 0, j, s, s + 10) for j, s in enumerate(starts)], "k long, gt boolean, i long, s double, e double")
    got = sorted((r.g, r.p) for r in matching.greedy_spread(df, "k", 1e-9).collect())
    assert got == [(j, j + 1) for j in range(0, 100, 2)] and len(wrote) < 25
