"""Registry of the engine's own queries, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import oracle as sql
from tidemark.functions import jsonx, labels, texts
from tidemark.functions.intervals import snap_interval
from tidemark.operators import compare, curate, matching, metrics, ranges
from tidemark.plans import media
from tidemark.registry import QUERIES, SQL, Query, query, read
from tidemark.sources.events import SQL as SEG
from tidemark.sources.events import segments

TAUS = (0.3, 0.5, 0.7)


@query(f"WITH {SEG} SELECT g.rec_id, g.i AS g, p.i AS p, round({sql.tiou('g', 'p')}, 6) AS t FROM seg g JOIN seg p ON g.rec_id = p.rec_id AND g.gt AND NOT p.gt WHERE {sql.tiou('g', 'p')} >= 0.3")
def tiou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.record_pairs(segments(spark, sf_dir), 0.3).withColumn("t", F.round("t", 6))


@query(f"WITH RECURSIVE {SEG}, {sql.matches((0.5,))} SELECT rec_id, g, p, round(t, 6) AS t FROM m")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.record_matches(segments(spark, sf_dir), 0.5).withColumn("t", F.round("t", 6))


@query(f"WITH RECURSIVE {SEG}, {sql.matches((1e-9,), 'p, g')} SELECT rec_id, g, p, round(t, 6) AS t FROM m")
def greedy_match_pred_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.record_matches(segments(spark, sf_dir), 1e-9, "pred").withColumn("t", F.round("t", 6))


POOLED = "ls AS (SELECT j + 1 AS label, seg.* FROM seg, range(6) AS u(j) WHERE (b >> j) % 2 = 1)"


@query(f"WITH RECURSIVE {SEG}, {POOLED}, {sql.matches((0.7,), 'p, g', 'label', 'ls')} SELECT label, g, p, round(t, 6) AS t FROM m")
def greedy_match_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.by_label(segments(spark, sf_dir))
    return matching.greedy_spread(rows.select("label", "gt", "i", "s", "e"), "label", 0.7).withColumn("t", F.round("t", 6))


@query(f"""WITH RECURSIVE {SEG}, {sql.matches((0.5,))} SELECT rec_id, CASE WHEN gt THEN 'gt' ELSE 'pred' END AS side, i FROM seg
WHERE NOT EXISTS (SELECT 1 FROM m WHERE CASE WHEN seg.gt THEN m.g ELSE m.p END = seg.i)""")
def unmatched_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    found = matching.record_matches(rows, 0.5)
    taken = found.select("rec_id", F.lit(True).alias("gt"), F.col("g").alias("i")).union(found.select("rec_id", F.lit(False), "p"))
    return rows.join(taken, ["rec_id", "gt", "i"], "left_anti").select("rec_id", F.when(F.col("gt"), "gt").otherwise("pred").alias("side"), "i")


@query(f"{sql.record_metrics((0.5,), 'strict')} SELECT rec_id, round(max_tiou_per_gt, 6) AS per_gt, round(max_tiou_per_pred, 6) AS per_pred FROM rm")
def localization_max_tiou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.record_best_overlaps(segments(spark, sf_dir)).select("rec_id", F.round("per_gt", 6).alias("per_gt"), F.round("per_pred", 6).alias("per_pred"))


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select("tau", "rec_id", *sql.WHOLE, *[F.round(c, 6).alias(c) for c in sql.REAL])


@query(sql.record_rows(TAUS, "strict"))
def record_metrics_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.record_metrics(segments(spark, sf_dir), TAUS))


@query(sql.record_rows(TAUS, "matched_only"))
def record_metrics_matched_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.record_metrics(segments(spark, sf_dir), TAUS, "matched_only"))


def hot_record(rows: DataFrame) -> DataFrame:
    """Segments of which a tenth are one record."""
    return rows.withColumn("rec_id", F.when(F.col("i") % 20 < 2, F.lit(-1).cast("long")).otherwise(F.col("rec_id")))


@query(sql.record_rows(TAUS, "strict", hot=True))
def record_metrics_hot_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record with a tenth of all rows beside ordinary ones."""
    return rounded(metrics.record_metrics(hot_record(segments(spark, sf_dir)), TAUS))


def by_model(spark: SparkSession, sf_dir: str, policy: str = "strict", taus: tuple[float, ...] = TAUS) -> DataFrame:
    return metrics.record_metrics(segments(spark, sf_dir), taus, policy, carried=("model_id", "iter"))


@query(sql.summary(TAUS, "strict", "tau, model_id", metrics.MEANS))
def model_summary_tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(by_model(spark, sf_dir), "tau", "model_id")


@query(sql.summary(TAUS, "matched_only", "tau, model_id", metrics.MEANS))
def model_summary_matched_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(by_model(spark, sf_dir, "matched_only"), "tau", "model_id")


@query(sql.summary((0.5,), "strict", "tau, iter", metrics.MEANS))
def iteration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(by_model(spark, sf_dir, taus=(0.5,)), "tau", "iter")


@query(sql.label_pool(TAUS, "strict"))
def label_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_pool(by_model(spark, sf_dir), "tau", "model_id")


def with_keys(rows: DataFrame) -> DataFrame:
    """Segments with kb: the keys that their labels have, beside those that are true."""
    some = sum((F.when((F.col("k") + j) % 4 != 0, 1 << j).otherwise(0) for j in range(1, 6)), F.when(F.col("k") % 4 != 0, 1).otherwise(0))
    return rows.withColumn("kb", F.when(F.col("k") % 9 == 0, F.col("b")).otherwise(F.col("b").bitwiseOR(some)))


@query(f"""WITH {sql.SEG_KEYED}, r AS (SELECT rec_id, count(*) FILTER (gt AND k % 4 <> 0) AS g, count(*) FILTER (NOT gt AND k % 4 <> 0) AS p, bit_or(kb) FILTER (k % 4 <> 0) AS kb, bool_and(k <> 99) AS ok FROM seg GROUP BY rec_id)
SELECT CASE WHEN NOT ok THEN 'json_load_failed' WHEN g + p = 0 THEN 'empty_gt_and_pred' WHEN kb = 0 THEN 'no_guardrail_keys' ELSE 'usable' END AS reason, count(*) AS n FROM r GROUP BY ALL""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose kept segments (k not divisible by 4) are none or whose labels have no key; k = 99 stands for a broken line."""
    kept = F.col("k") % 4 != 0
    rows = with_keys(segments(spark, sf_dir)).groupBy("rec_id").agg(
        F.bool_and(F.col("k") != 99).alias("is_valid"), F.count(F.when(kept & F.col("gt"), 1)).alias("n_gt"), F.count(F.when(kept & ~F.col("gt"), 1)).alias("n_pred"),
        F.bit_count(F.coalesce(F.bit_or(F.when(kept, F.col("kb"))), F.lit(0))).alias("n_keys"),
    )
    return metrics.skip_reasons(rows)


@query(sql.record_rows(TAUS, "strict", True))
def record_metrics_own_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records have the labels that their own segments name."""
    return rounded(metrics.record_metrics(with_keys(segments(spark, sf_dir)), TAUS, keys="kb"))


@query(sql.label_pool(TAUS, "strict", True))
def label_pool_own_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_pool(metrics.record_metrics(with_keys(segments(spark, sf_dir)), TAUS, carried=("model_id",), keys="kb"), "tau", "model_id")


@query(sql.summary_of_usable(TAUS, "strict", "tau, model_id", metrics.MEANS))
def model_summary_of_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without skipped records; k = 99 stands for a broken line."""
    rows = with_keys(segments(spark, sf_dir))
    bad = F.bool_or(F.col("k") == 99).over(Window.partitionBy("rec_id"))
    each = metrics.record_metrics(rows.withColumn("bad", bad), TAUS, carried=("model_id", "bad"), keys="kb")
    return metrics.summary_of_usable(metrics.with_skips(each, ~F.col("bad")), "tau", "model_id")


VIDEO = f"WITH {SEG}, v AS (SELECT rec_id, coalesce(bit_or(b) FILTER (gt), 0) AS g, coalesce(bit_or(b) FILTER (NOT gt), 0) AS p FROM seg GROUP BY rec_id)"
SETS = """ SELECT CAST(j + 1 AS BIGINT) AS label, count(*) FILTER ((g >> j) % 2 = 1 AND (p >> j) % 2 = 1) AS tp, count(*) FILTER ((g >> j) % 2 = 0 AND (p >> j) % 2 = 0) AS tn,
count(*) FILTER ((g >> j) % 2 = 0 AND (p >> j) % 2 = 1) AS fp, count(*) FILTER ((g >> j) % 2 = 1 AND (p >> j) % 2 = 0) AS fn,
round(count(*) FILTER ((g >> j) % 2 = (p >> j) % 2) / count(*), 6) AS accuracy FROM {src}, range({n}) AS u(j) GROUP BY j"""


@query(VIDEO + SETS.format(src="v", n=6))
def category_set_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.set_accuracy(metrics.video_labels(segments(spark, sf_dir)))


@query(VIDEO + " SELECT count(*) AS n, round(count(*) FILTER (g = p) / count(*), 6) AS exact FROM v")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.exact_match(metrics.video_labels(segments(spark, sf_dir)))


@query("WITH v AS (SELECT CAST(quality AS INT) + 2 * toxic AS g, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END + CASE WHEN n_chars % 7 = 0 THEN 2 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id))" + SETS.format(src="v", n=2))
def label_table_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels' two columns against two rules on length."""
    g = F.col("quality") + 2 * F.col("toxic")
    p = F.when(F.col("n_chars") > 1000, 1).otherwise(0) + F.when(F.col("n_chars") % 7 == 0, 2).otherwise(0)
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.set_accuracy(rows.select(g.alias("g"), p.alias("p")), labels=2)


TEMPORAL_ROWS = """
c AS (SELECT label, count(*) FILTER (gt) AS n_gt, count(*) FILTER (NOT gt) AS n_pred FROM ls GROUP BY label),
f AS (SELECT {label} AS label, count(*) FILTER (tau < 0.1) AS n_any, count(*) FILTER (tau = 0.5) AS n_05, count(*) FILTER (tau = 0.7) AS n_07,
  CAST(sum(CAST(round(t * 1000000, 0) AS BIGINT)) FILTER (tau < 0.1) AS DOUBLE) / count(*) FILTER (tau < 0.1) / 1000000 AS a, CAST(sum(CAST(round(t * 1000000, 0) AS BIGINT)) FILTER (tau = 0.5) AS DOUBLE) / count(*) FILTER (tau = 0.5) / 1000000 AS b, CAST(sum(CAST(round(t * 1000000, 0) AS BIGINT)) FILTER (tau = 0.7) AS DOUBLE) / count(*) FILTER (tau = 0.7) / 1000000 AS d FROM m GROUP BY ALL),
y AS (SELECT label, n_gt, n_pred, coalesce(n_any, 0) AS n_any, coalesce(n_05, 0) AS n_05, coalesce(n_07, 0) AS n_07, a, b, d FROM c LEFT JOIN f USING (label)),
x AS (SELECT CAST(label AS BIGINT) AS label, n_gt, n_pred, n_any, n_05, n_07, round(n_05 / nullif(n_gt, 0), 6) AS accuracy_05, round(n_05 / nullif(n_pred, 0), 6) AS precision_05,
  round(n_07 / nullif(n_gt, 0), 6) AS accuracy_07, round(n_07 / nullif(n_pred, 0), 6) AS precision_07, round(a, 12) AS tiou_any, round(b, 12) AS tiou_05, round(d, 12) AS tiou_07 FROM y)"""
TEMPORAL = f"""WITH RECURSIVE {SEG}, ls AS (SELECT rec_id * 10 + j AS rec_id, j + 1 AS label, gt, i, s, e, b FROM seg, range(6) AS u(j) WHERE (b >> j) % 2 = 1), {sql.matches((1e-9, 0.5, 0.7), 'p, g', 'rec_id', 'ls')},""" + TEMPORAL_ROWS.format(label="rec_id % 10 + 1")
TEMPORAL_POOLED = f"WITH RECURSIVE {SEG}, {POOLED}, {sql.peeled((1e-9, 0.5, 0.7), 'p, g', 'label', 'ls')}," + TEMPORAL_ROWS.format(label="label")


@query(TEMPORAL + " SELECT * FROM x")
def temporal_category_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By record; `temporal_category_metrics_pooled` matches over all records."""
    return metrics.temporal_metrics(segments(spark, sf_dir), "record")


@query(TEMPORAL + " SELECT " + ", ".join(f"round(avg({c}), 6) AS macro_{c}" for c in ("accuracy_05", "accuracy_07", "tiou_any", "tiou_05", "tiou_07")) + " FROM x")
def temporal_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro(metrics.temporal_metrics(segments(spark, sf_dir), "record"))


@query(TEMPORAL_POOLED + " SELECT * FROM x")
def temporal_category_metrics_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all records together; tests also hold it against a sequential match."""
    return metrics.temporal_metrics(segments(spark, sf_dir), "pooled")


@query(f"WITH {SEG}, {sql.ISLANDS.format(src='seg')} SELECT rec_id, gt, count(*) AS n, round(sum(e - s), 6) AS total FROM islands GROUP BY ALL")
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ranges.merged(segments(spark, sf_dir), "rec_id", "gt")
    return made.groupBy("rec_id", "gt").agg(F.count("*").alias("n"), F.round(F.sum(F.col("e") - F.col("s")), 6).alias("total"))


ISLANDS = sql.ISLANDS.format(src="seg")
UNION_IOU = """WITH {seg}, {islands}, d AS (SELECT rec_id, sum(e - s) AS d FROM islands GROUP BY rec_id),
o AS (SELECT a.rec_id, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS o FROM islands a JOIN islands b ON a.rec_id = b.rec_id AND a.gt AND NOT b.gt AND a.s < b.e AND b.s < a.e GROUP BY ALL),
r AS (SELECT DISTINCT rec_id FROM seg)
SELECT rec_id, round(CASE WHEN d IS NULL THEN 1.0 WHEN d - coalesce(o, 0) <= 0 THEN 0.0 ELSE coalesce(o, 0) / (d - coalesce(o, 0)) END, 6) AS iou FROM r LEFT JOIN d USING (rec_id) LEFT JOIN o USING (rec_id)"""


@query(UNION_IOU.format(seg=SEG, islands=ISLANDS))
def union_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.shared(segments(spark, sf_dir), "rec_id").select("rec_id", F.round(ranges.shared_iou(), 6).alias("iou"))


def on_one_axis(rows: DataFrame) -> DataFrame:
    """All segments as one record, users and weeks one after another."""
    shift = 1000 * F.col("user_id") + 168 * F.col("iter")
    return rows.withColumns({"rec_id": F.lit(0).cast("long"), "s": F.col("s") + shift, "e": F.col("e") + shift})


@query(f"WITH {sql.SEG_LINE}, {sql.ISLANDS.format(src='seg')} SELECT rec_id, gt, count(*) AS n, round(sum(e - s), 3) AS total FROM islands GROUP BY ALL")
def merged_ranges_one_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows are one record's."""
    made = ranges.merged(on_one_axis(segments(spark, sf_dir)), "rec_id", "gt")
    return made.groupBy("rec_id", "gt").agg(F.count("*").alias("n"), F.round(F.sum(F.col("e") - F.col("s")), 3).alias("total"))


@query(UNION_IOU.format(seg=sql.SEG_LINE, islands=ISLANDS))
def union_iou_one_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows are one record's."""
    return ranges.shared(on_one_axis(segments(spark, sf_dir)), "rec_id").select("rec_id", F.round(ranges.shared_iou(), 6).alias("iou"))


@query(f"""WITH {SEG}, w AS (SELECT rec_id, i, s, e, max(e) OVER (PARTITION BY rec_id ORDER BY s, e, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r,
last_value(e) OVER (PARTITION BY rec_id ORDER BY s, e, i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM seg WHERE gt)
SELECT rec_id, bool_and(CASE WHEN r IS NULL THEN s <= 60 ELSE s - r BETWEEN 0 AND 60 END) AND greatest(0.0, 168.0 - max(l)) <= 60 + 1e-6 AS covered FROM w GROUP BY rec_id""")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the annotated intervals cover the week, with gaps of up to 60 hours."""
    return ranges.coverage(segments(spark, sf_dir).where("gt").withColumn("d", F.lit(168.0)), "rec_id", "d", 60.0)


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of models 0 and 1 for the same key (a third of the user id, and week) beside the annotations of model 0."""
    rows = segments(spark, sf_dir).withColumn("key", F.floor(F.col("user_id") / 3).cast("long") * 10 + F.col("iter"))
    part = lambda c, n: F.collect_list(F.when(c, F.struct("s", "e", "b"))).alias(n)
    side = lambda m, n: rows.where(F.col("model_id") == m).groupBy("key").agg(part(~F.col("gt"), n), *([part(F.col("gt"), "gt")] if m == 0 else []))
    return side(0, "left").join(side(1, "right"), "key")


COMPARE = f"""WITH {SEG}, k AS (SELECT user_id // 3 * 10 + iter AS key, model_id, CASE WHEN NOT gt AND model_id = 0 THEN 'left' WHEN NOT gt AND model_id = 1 THEN 'right' WHEN model_id = 0 THEN 'gt' ELSE 'none' END AS side, s, e, b FROM seg WHERE model_id < 2),
keys AS (SELECT key FROM k GROUP BY key HAVING count(DISTINCT model_id) = 2),
h AS (SELECT key AS rec_id, side AS gt, s, e, b FROM k JOIN keys USING (key) WHERE b <> 0 AND side <> 'none'), {sql.ISLANDS.format(src='h')},
n AS (SELECT rec_id, count(*) FILTER (gt = 'left') AS n_left, count(*) FILTER (gt = 'right') AS n_right, count(*) FILTER (gt = 'gt') AS n_gt,
  bit_or(b) FILTER (gt = 'left') AS lb, bit_or(b) FILTER (gt = 'right') AS rb, bit_or(b) FILTER (gt = 'gt') AS gb FROM h GROUP BY ALL),
d AS (SELECT rec_id, coalesce(sum(e - s) FILTER (gt = 'left'), 0) AS dl, coalesce(sum(e - s) FILTER (gt = 'right'), 0) AS dr, coalesce(sum(e - s) FILTER (gt = 'gt'), 0) AS dg FROM islands GROUP BY ALL),
o AS (SELECT a.rec_id, coalesce(sum(least(a.e, b.e) - greatest(a.s, b.s)) FILTER (a.gt = 'left'), 0) AS ol, coalesce(sum(least(a.e, b.e) - greatest(a.s, b.s)) FILTER (a.gt = 'right'), 0) AS orr
  FROM islands a JOIN islands b ON a.rec_id = b.rec_id AND a.gt <> 'gt' AND b.gt = 'gt' AND a.s < b.e AND b.s < a.e GROUP BY ALL),
x AS (SELECT key, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right, coalesce(n_gt, 0) AS n_gt, coalesce(lb, 0) AS left_b, coalesce(rb, 0) AS right_b, coalesce(gb, 0) AS gt_b,
  CASE WHEN coalesce(n_left, 0) + coalesce(n_gt, 0) = 0 THEN 1.0 ELSE coalesce(ol, 0) / (dl + dg - coalesce(ol, 0)) END AS left_iou,
  CASE WHEN coalesce(n_right, 0) + coalesce(n_gt, 0) = 0 THEN 1.0 ELSE coalesce(orr, 0) / (dr + dg - coalesce(orr, 0)) END AS right_iou
  FROM keys LEFT JOIN n ON n.rec_id = key LEFT JOIN d ON d.rec_id = key LEFT JOIN o ON o.rec_id = key)"""


@query(COMPARE + """ SELECT key, n_left, n_right, n_gt, round(left_iou, 6) AS left_iou, round(right_iou, 6) AS right_iou, round(abs(left_iou - right_iou), 6) AS iou_gap, left_b <> right_b AS label_mismatch,
left_b & ~gt_b AS left_fp, gt_b & ~left_b AS left_fn, right_b & ~gt_b AS right_fp, gt_b & ~right_b AS right_fn, left_b = gt_b AS left_exact, right_b = gt_b AS right_exact FROM x""")
def model_pair_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.compare_models(bundle(spark, sf_dir)).drop("left_b", "right_b", "gt_b")
    return rows.withColumns({c: F.round(c, 6) for c in ("left_iou", "right_iou", "iou_gap")})


@query(COMPARE + " SELECT key, n_left, n_right, n_gt, round(abs(left_iou - right_iou), 6) AS iou_gap FROM x WHERE left_b <> right_b AND abs(left_iou - right_iou) >= 0.05 AND n_left + n_right + n_gt > 0")
def model_pair_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.filter_items(compare.compare_models(bundle(spark, sf_dir)), mismatch_only=True, min_gap=0.05, with_intervals=True)
    return rows.select("key", "n_left", "n_right", "n_gt", F.round("iou_gap", 6).alias("iou_gap"))


@query(COMPARE + " SELECT round(avg(left_iou), 6) AS mean_iou, " + ", ".join(f"round(avg(CASE WHEN (left_b >> {j}) % 2 = (gt_b >> {j}) % 2 THEN 1.0 ELSE 0.0 END), 6) AS acc_{j + 1}" for j in range(6))
       + ", round(avg(CASE WHEN left_b = gt_b THEN 1.0 ELSE 0.0 END), 6) AS exact, count(*) AS n FROM x")
def model_pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.model_summary(compare.compare_models(bundle(spark, sf_dir)), "left")


BARE = "regexp_replace(url, '[?#].*$', '')"
NAME = "regexp_extract(rtrim({p}, '/'), '[^/]*$')"


@query(f"""WITH u AS (SELECT page_id, {BARE} AS p FROM pages), v AS (SELECT page_id, p, {NAME.format(p='p')} AS n FROM u),
w AS (SELECT page_id, CASE WHEN regexp_matches(n, '.[.][^.]+$') THEN regexp_replace(n, '[.][^.]+$', '') ELSE n END AS s, n, p FROM v),
k AS (SELECT page_id, unnest([p, n, s]) AS key, unnest([0, 1, 2]) AS pos FROM w),
d AS (SELECT page_id, key, min(pos) AS pos FROM k WHERE key <> '' GROUP BY ALL),
e AS (SELECT page_id, key, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos FROM d),
o AS (SELECT a.page_id, a.pos, min(b.page_id) AS match FROM e a JOIN e b ON a.key = b.key AND a.page_id <> b.page_id GROUP BY ALL)
SELECT page_id AS id, CAST(min(pos) AS INT) AS hit_at, arg_min(match, pos) AS match FROM o GROUP BY page_id""")
def candidate_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page looks up any other page by its url, its last part, or that part's stem, in this order."""
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), texts.path_variants(F.regexp_replace("url", r"[?#].*$", ""), ()).alias("keys"))
    return compare.lookup_others(rows)


@query("SELECT page_id, url FROM pages WHERE list_has_any(regexp_split_to_array(lower(url), '[^a-z0-9]+'), ['blog', 'spam', 'feed'])")
def marker_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").where(texts.has_marker(("blog", "spam", "feed"), F.col("url"))).select("page_id", "url")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':7'), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN rn <= least(greatest(1, ceil(n * 0.1)), CASE WHEN n = 1 THEN 1 ELSE n - 1 END) THEN 'eval' ELSE 'train' END AS part FROM r""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.stratified_split(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':7'), doc_id) AS rn FROM documents) SELECT doc_id, lang FROM r WHERE rn <= 120""")
def group_cap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.group_cap(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 120)


@query("SELECT lang, count(*) AS n, least(count(*), 120) AS kept, greatest(count(*) - 120, 0) AS dropped FROM documents GROUP BY lang")
def group_cap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.group_cap_counts(read(spark, sf_dir, "documents"), "lang", 120)


@query("""WITH p AS (SELECT doc_id, (n_chars % 900) / 10.0::DOUBLE AS safe, (n_chars % 290) / 10.0::DOUBLE AS harmful, CAST('0x' || substr(md5(doc_id || ':7'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM documents),
q AS (SELECT *, greatest(0.0, least(safe, 60 - harmful)) AS latest, least(60.0, safe + harmful) AS total FROM p),
r AS (SELECT *, CASE WHEN latest <= 1e-6 THEN 0.0 ELSE round(u * latest, 3) END AS start FROM q), z AS (SELECT *, least(total, start + harmful) AS stop FROM r)
SELECT doc_id, round(start, 3) AS start, round(total, 3) AS total, CASE WHEN stop - start > 1e-6 THEN 1 + CASE WHEN start > 1e-6 THEN 1 ELSE 0 END + CASE WHEN total - stop > 1e-6 THEN 1 ELSE 0 END ELSE 0 END AS n FROM z""")
def insertion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lengths stand for durations of safe and inserted clips."""
    rows = read(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 900).cast("double") / 10).alias("safe"), ((F.col("n_chars") % 290).cast("double") / 10).alias("harmful"), F.lit(1).alias("b"))
    made = media.insertion_plan(rows, "doc_id")
    return made.select("doc_id", F.round("start", 3).alias("start"), F.round("total", 3).alias("total"), F.coalesce(F.size("intervals"), F.lit(0)).alias("n"))


@query(f"""WITH {SEG}, p AS (SELECT rec_id, bit_or(b) AS a, count(*) AS n, count(*) FILTER (b <> 0) AS h FROM seg GROUP BY rec_id)
SELECT CAST(0 AS BIGINT) AS label, count(*) AS n_samples, CAST(sum(n) AS BIGINT) AS n_shots, count(*) FILTER (a <> 0) AS n_harmful_samples, CAST(sum(h) AS BIGINT) AS n_harmful_shots FROM p
UNION ALL SELECT j + 1, count(DISTINCT rec_id) FILTER ((b >> j) % 2 = 1), count(*) FILTER ((b >> j) % 2 = 1), count(DISTINCT rec_id) FILTER ((b >> j) % 2 = 1), count(*) FILTER ((b >> j) % 2 = 1) FROM seg, range(6) AS u(j) GROUP BY j""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.dataset_summary(segments(spark, sf_dir))


@query("""SELECT event_id, n, CAST(n AS DOUBLE) AS t, least(CAST(round_even(n * 2.0::DOUBLE, 0) AS BIGINT), greatest(CAST(floor(value * 2) AS BIGINT) - 1, 0)) AS frame
FROM events, LATERAL (SELECT unnest(range(greatest(CAST(ceil(value) AS BIGINT), 1))) AS n) u""")
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values stand for durations, at two frames a second; every event is a video."""
    return media.frame_plan(read(spark, sf_dir, "events"), "event_id", "value", 2.0)


@query(f"""WITH {SEG}, c AS (SELECT i, floor(greatest(0.0, least(s, 168.0)) / 0.5) * 0.5 AS a, ceil(greatest(0.0, least(e, 168.0)) / 0.5) * 0.5 AS b, least(e, 168.0) > least(s, 168.0) AS late FROM seg)
SELECT i, round(a, 6) AS s, round(CASE WHEN b <= a AND late THEN least(168.0, round(a + 0.5, 6)) ELSE b END, 6) AS e FROM c""")
def snapped_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = snap_interval(F.col("s"), F.col("e"), F.lit(168.0), 0.5, "floor", "ceil")
    return segments(spark, sf_dir).select("i", F.round(s, 6).alias("s"), F.round(e, 6).alias("e"))


@query(f"""WITH u AS (SELECT page_id, url, {BARE} AS p FROM pages), v AS (SELECT page_id, url, {NAME.format(p='p')} AS n FROM u),
w AS (SELECT page_id, url, CASE WHEN regexp_matches(n, '.[.][^.]+$') THEN regexp_replace(n, '[.][^.]+$', '') ELSE n END AS s FROM v),
x AS (SELECT page_id, url, s, trim(regexp_replace(s, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_') AS c FROM w)
SELECT page_id, 'inserted__' || CASE WHEN c = '' THEN 'item' ELSE c END || '__' || CAST(page_id AS VARCHAR) AS sample_id, rtrim(substr(CASE WHEN c = '' THEN 'item' ELSE c END, 1, 40), '_') || '_' || substr(sha1(s), 1, 12) AS folder FROM x""")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = texts.stem(F.regexp_replace("url", r"[?#].*$", ""))
    return read(spark, sf_dir, "pages").select("page_id", stem.alias("s")).select("page_id", texts.sample_id(F.col("s"), F.col("page_id").cast("string")).alias("sample_id"), texts.frame_directory(F.col("s")).alias("folder"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and its turns in order."""
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def first_of(turns: str, role: str) -> Column:
    return F.get(F.filter(turns, lambda t: t["role"] == role), 0)["text"]


@query("""SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), arg_min(text, turn), '') AS prompt, coalesce(arg_min(role, turn) = 'user', false) AS starts_with_user FROM conversations GROUP BY conv_id""")
def conversation_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first user turn, else the first turn, else nothing. Firsts combine before their shuffle; no conversation is gathered."""
    turn = F.struct("turn", "role", "text")
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min(turn).alias("first"), F.min(F.when(F.col("role") == "user", turn)).alias("asked"))
    return rows.select("conv_id", F.coalesce("asked.text", "first.text", F.lit("")).alias("prompt"), F.coalesce(F.col("first.role") == "user", F.lit(False)).alias("starts_with_user"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, arg_min(text, turn) FILTER (role = 'assistant') AS by_role, max(text) FILTER (n = 2) AS by_place FROM r GROUP BY conv_id""")
def conversation_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By role (the first assistant turn) and by place (the second turn)."""
    return conversations(spark, sf_dir).select("conv_id", first_of("turns", "assistant").alias("by_role"), F.get("turns", 1)["text"].alias("by_place"))


@query(f"""WITH {SEG} SELECT rec_id AS sample, count(*) AS n_shots, count(*) FILTER (b <> 0) AS n_harmful, round(round(max(e), 6), 3) AS duration,
bit_or(b) AS labels FROM seg WHERE gt GROUP BY rec_id""")
def sft_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records with their shots as a JSON answer; what is compared is read back from that answer."""
    rows = matching.records(segments(spark, sf_dir).where("gt"))
    flags = lambda b: F.map_from_arrays(F.array(*map(F.lit, labels.STANDARD)), F.array(*[labels.has(b, j) for j in range(6)]))
    answer = F.to_json(F.transform("gt", lambda x: F.struct(x["s"].alias("START_SEC"), x["e"].alias("END_SEC"), F.lit("d").alias("DESCRIPTION"), flags(x["b"]).alias("GUARDRAIL"), F.lit("e").alias("EXPLANATION"))))
    turns = F.array(F.struct(F.lit("human").alias("from"), F.lit("<video>\nList the shots.").alias("value")), F.struct(F.lit("gpt").alias("from"), answer.alias("value")))
    made = rows.select(F.col("rec_id").alias("sample"), turns.alias("conversations"))
    back = made.select("sample", jsonx.shots(F.get("conversations", 1)["value"]).alias("x"))
    return back.select("sample", F.size("x").cast("long").alias("n_shots"), F.size(F.filter("x", lambda s: s["b"] != 0)).cast("long").alias("n_harmful"),
                       F.round(F.array_max(F.transform("x", lambda s: s["e"])), 3).alias("duration"), compare.label_union(F.col("x")).alias("labels"))


@query(f"WITH {SEG} SELECT i, b, CASE WHEN b = 0 THEN '' ELSE array_to_string(list_transform(list_filter(range(6), lambda j: (b >> j) % 2 = 1), lambda j: 'C' || (j + 1)), ',') END AS codes, bit_count(b)::INT AS n FROM seg")
def guardrail_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label bits go out as JSON objects with full, short and bare keys and Python booleans, and are read back."""
    name = lambda j: F.when(F.col("i") % 3 == 0, labels.STANDARD[j]).when(F.col("i") % 3 == 1, f"C{j + 1}").otherwise(f"C{j + 1}(any)")
    pairs = [F.concat(F.lit('"'), name(j), F.lit('": '), F.when(labels.has(F.col("b"), j), "True").otherwise("False")) for j in range(6)]
    raw = F.concat(F.lit("DESCRIPTION: x GUARDRAIL: {"), F.concat_ws(", ", *pairs), F.lit("} EXPLANATION: y"))
    rows = segments(spark, sf_dir).select("i", jsonx.three_part_answer(raw)["labels"].alias("l"))
    rows = rows.select("i", labels.label_bits(F.col("l")).alias("b"))
    return rows.select("i", "b", labels.codes(F.col("b")).alias("codes"), F.bit_count("b").alias("n"))


@query(f"WITH {SEG} SELECT rec_id, count(*) AS n, round(sum(s), 4) AS s, round(sum(e), 4) AS e FROM seg WHERE NOT gt GROUP BY rec_id")
def json_list_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted intervals as JSON lists in noise, recovered; SQL says what stood there before the noise."""
    rows = matching.records(segments(spark, sf_dir).where("not gt"))
    body = F.to_json(F.transform("pred", lambda x: F.struct(x["s"].alias("START_SEC"), x["e"].alias("END_SEC"))))
    noise = F.col("rec_id") % 4
    text = F.when(noise == 0, F.concat(F.lit("some [talk] first Assistant\n"), body)).when(noise == 1, F.concat(F.lit("<think></think> ["), body)).when(noise == 2, F.concat(F.lit("Sure: "), body, F.lit(" done."))).otherwise(body)
    got = rows.select("rec_id", jsonx.parse_answer(text).alias("x"))
    sums = lambda k: F.round(F.aggregate("x", F.lit(0.0), lambda a, s: a + s[k]), 4).alias(k)
    return got.select("rec_id", F.size("x").cast("long").alias("n"), sums("s"), sums("e"))


@query(f"WITH {SEG} SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY i) - 1 AS at, round(s, 6) AS s, round(e, 6) AS e, b FROM seg WHERE gt")
def chunk_payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals to a payload of named chunks and back in their order."""
    rows = matching.records(segments(spark, sf_dir).where("gt"))
    made = F.transform("gt", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("description"), F.lit("").alias("explanation"), x["b"].alias("b")))
    payload = rows.select("rec_id", jsonx.to_payload(made).alias("p"))
    return payload.select("rec_id", F.posexplode(jsonx.ordered_chunks(F.col("p.chunks"), F.col("p.chunk_order"))).alias("at", "x")).select(
        "rec_id", F.col("at").cast("long").alias("at"), F.round("x.s", 6).alias("s"), F.round("x.e", 6).alias("e"), "x.b"
    )


@query("SELECT DISTINCT d.source AS model, p.lang AS dataset FROM documents d, (SELECT DISTINCT lang FROM documents) p WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.source = d.source AND x.lang = p.lang AND x.doc_id % 5 = 0)")
def run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with every language, but those that some document divisible by five has done."""
    docs = read(spark, sf_dir, "documents")
    name = lambda c, n: docs.select(F.col(c).alias(n)).distinct()
    done = docs.where("doc_id % 5 = 0").select(F.col("source").alias("model"), F.col("lang").alias("dataset")).distinct()
    return media.run_matrix(name("source", "model"), name("lang", "dataset"), done)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval evaluation by model at tIoU 0.5."""
    return metrics.summary(by_model(spark, sf_dir, taus=(0.5,)), "tau", "model_id")


def queries() -> dict[str, Query]:
    from tidemark import queries_files, queries_plans, queries_records, queries_sql, queries_stream  # noqa: F401  (they register theirs)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
