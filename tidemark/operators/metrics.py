"""Metrics of matched intervals and their labels: per record, per group, pooled by label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.checkpoints import cut, written
from tidemark.functions.labels import has, mask_of
from tidemark.operators import sizes
from tidemark.operators.matching import best_overlaps, greedy_spread, matched, matched_rows, matches_at, spread_best_overlaps, spread_matches
from tidemark.sources.records import segment_array


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 for a denominator of 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def label_rows(gt: Column, pred: Column, matches: Column, policy: str) -> Column:
    """Array of (g, p): the label bits that are compared. "strict" holds unmatched intervals against no labels."""
    made = lambda g, p: F.struct(g.cast("int").alias("g"), p.cast("int").alias("p"))
    rows = F.transform(matches, lambda m: made(m["gb"], m["pb"]))
    if policy == "matched_only":
        return rows
    gs, ps = F.transform(matches, lambda m: m["g"]), F.transform(matches, lambda m: m["p"])
    free_g = F.transform(F.filter(gt, lambda x: ~F.array_contains(gs, x["i"])), lambda x: made(x["b"], F.lit(0)))
    free_p = F.transform(F.filter(pred, lambda x: ~F.array_contains(ps, x["i"])), lambda x: made(F.lit(0), x["b"]))
    return F.concat(rows, free_g, free_p)


def record_metrics(
    segments: DataFrame, taus: Sequence[float], policy: str = "strict", labels: int = 6, carried: Sequence[str] = (), keys: str | None = None,
    limit: int = sizes.LIMIT,
) -> DataFrame:
    """One row per tau and record with its counts and metrics, and an array of (tp, fp, fn, tn) by label.

    Ratios without any positive count as perfect (1); label rows without rows give 0 for subset and hamming; coverage of
    an empty side is 1. Every record has all labels, or with `keys` (a bit mask of the keys that a segment's labels have)
    those that any of its segments has: only they count as true negatives and as decisions; n_keys says how many they are.
    Carried columns are the same in all of a record's rows. Records of over `limit` intervals are matched and counted without
    gathering them (taus must be over 0 for that), with the same result.
    """
    if policy not in ("strict", "matched_only"):
        raise ValueError(f"policy is strict or matched_only, not {policy}")
    small, large = sizes.split(segments, "rec_id", limit=limit) if min(taus) > 0 else (segments, None)
    rows = gathered_counts(small, taus, policy, labels, carried, keys)
    if large is not None:
        rows = rows.unionByName(spread_counts(large, taus, policy, labels, carried, keys))
    return finished(rows)


def gathered_counts(segments: DataFrame, taus: Sequence[float], policy: str, labels: int, carried: Sequence[str], keys: str | None) -> DataFrame:
    """The counts of record_metrics, by expressions on a row for each record."""
    return counted(matched(segments, taus, *carried, keys=keys), policy, labels, carried, keys)


def row_metrics(rows: DataFrame, taus: Sequence[float], policy: str = "strict", labels: int = 6, carried: Sequence[str] = ()) -> DataFrame:
    """record_metrics of rows that hold a record each (rec_id, carried, gt, pred: arrays of (i, s, e, b)); no shuffle, so streams can take it too."""
    return finished(counted(matched_rows(rows, taus), policy, labels, carried, None))


def counted(rows: DataFrame, policy: str, labels: int, carried: Sequence[str], keys: str | None) -> DataFrame:
    """The counts of rows with their matches."""
    has_key = (lambda j: has(F.col(keys), j)) if keys else (lambda j: F.lit(True))
    n_keys = F.bit_count(keys) if keys else F.lit(labels)
    rows = rows.withColumn("rows", label_rows(F.col("gt"), F.col("pred"), F.col("matches"), policy))

    def count(test) -> Column:
        return F.size(F.filter("rows", test)).cast("long")

    def counts_of(j: int) -> Column:
        return F.struct(
            count(lambda r: has(r["g"], j) & has(r["p"], j)).alias("tp"),
            count(lambda r: ~has(r["g"], j) & has(r["p"], j)).alias("fp"),
            count(lambda r: has(r["g"], j) & ~has(r["p"], j)).alias("fn"),
            F.when(has_key(j), count(lambda r: ~has(r["g"], j) & ~has(r["p"], j))).otherwise(0).alias("tn"),
        )

    by_label = F.array(*map(counts_of, range(labels)))
    def total(bits) -> Column:
        return F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + F.bit_count(bits(r["g"], r["p"])))

    on_gt, on_pred = best_overlaps(F.col("gt"), F.col("pred"))
    return rows.select(
        "tau", "rec_id", *carried,
        F.size("gt").cast("long").alias("n_gt"), F.size("pred").cast("long").alias("n_pred"), F.size("matches").cast("long").alias("n_matched"),
        F.aggregate("matches", F.lit(0.0), lambda a, m: a - m["nt"]).alias("t_sum"),
        F.size("rows").cast("long").alias("n_rows"), count(lambda r: r["g"] == r["p"]).alias("n_equal"),
        on_gt.alias("max_tiou_per_gt"), on_pred.alias("max_tiou_per_pred"), by_label.alias("by_label"),
        total(lambda g, p: g.bitwiseAND(p)).alias("tp"),
        total(lambda g, p: g.bitwiseOR(p).bitwiseXOR(g)).alias("fp"),
        total(lambda g, p: g.bitwiseOR(p).bitwiseXOR(p)).alias("fn"), n_keys.cast("long").alias("n_keys"),
    )


def spread_counts(segments: DataFrame, taus: Sequence[float], policy: str, labels: int, carried: Sequence[str], keys: str | None) -> DataFrame:
    """The counts of record_metrics for records of any size: matches and best overlaps level by level, labels met by joins, sums that combine."""
    every = F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau")
    found = cut(spread_matches(segments, taus, "gt"))
    own = segments.select(every, "rec_id", "gt", "i", "b")
    g = own.where("gt").select("tau", "rec_id", F.col("i").alias("g"), F.col("b").alias("gb")).join(found.drop("t"), ["tau", "rec_id", "g"], "left")
    p = own.where("not gt").select("tau", "rec_id", F.col("i").alias("p"), F.col("b").alias("pb"))
    rows = g.join(p, ["tau", "rec_id", "p"], "full" if policy == "strict" else "inner").select("tau", "rec_id", *[F.coalesce(f"{x}b", F.lit(0)).alias(x) for x in "gp"])

    x, y = F.col("g"), F.col("p")
    tests = {"tp": lambda a, b: a & b, "fp": lambda a, b: ~a & b, "fn": lambda a, b: a & ~b, "tn": lambda a, b: ~a & ~b}
    sums = rows.groupBy("tau", "rec_id").agg(
        F.count("*").alias("n_rows"), F.count_if(x == y).alias("n_equal"), F.sum(F.bit_count(x.bitwiseAND(y))).alias("tp"),
        F.sum(F.bit_count(x.bitwiseOR(y).bitwiseXOR(x))).alias("fp"), F.sum(F.bit_count(x.bitwiseOR(y).bitwiseXOR(y))).alias("fn"),
        *[F.count_if(test(has(x, j), has(y, j))).alias(f"{n}_{j}") for j in range(labels) for n, test in tests.items()],
    )
    met = found.groupBy("tau", "rec_id").agg(F.count("*").alias("n_matched"), F.sum("t").alias("t_sum"))
    mask = [F.coalesce(F.bit_or(keys), F.lit(0)).alias("_keys")] if keys else [F.lit((1 << labels) - 1).alias("_keys")]
    sides = segments.groupBy("rec_id", *carried).agg(F.count_if("gt").alias("n_gt"), F.count_if(~F.col("gt")).alias("n_pred"), *mask)
    base = sides.select("*", every).join(spread_best_overlaps(segments), "rec_id").join(met, ["tau", "rec_id"], "left").join(sums, ["tau", "rec_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    counts_of = lambda j: F.struct(*[(zero(f"{n}_{j}") if n != "tn" else F.when(has(F.col("_keys"), j), zero(f"{n}_{j}")).otherwise(0)).alias(n) for n in tests])
    return base.select(
        "tau", "rec_id", *carried, "n_gt", "n_pred", zero("n_matched").alias("n_matched"), F.coalesce("t_sum", F.lit(0.0)).alias("t_sum"),
        zero("n_rows").alias("n_rows"), zero("n_equal").alias("n_equal"), F.col("per_gt").alias("max_tiou_per_gt"), F.col("per_pred").alias("max_tiou_per_pred"),
        F.array(*map(counts_of, range(labels))).alias("by_label"), *[zero(n).alias(n) for n in ("tp", "fp", "fn")],
        (F.bit_count("_keys") if keys else F.lit(labels)).cast("long").alias("n_keys"),
    )


def finished(rows: DataFrame) -> DataFrame:
    """The ratios of record_metrics from its counts."""
    c = F.col
    rows = rows.withColumn("tn", c("n_rows") * c("n_keys") - c("tp") - c("fp") - c("fn"))
    none = c("tp") + c("fp") + c("fn") == 0
    rows = rows.withColumns(
        {
            "micro_p": F.when(none, 1.0).otherwise(ratio(c("tp"), c("tp") + c("fp"))),
            "micro_r": F.when(none, 1.0).otherwise(ratio(c("tp"), c("tp") + c("fn"))),
            "scores": F.transform(
                F.filter("by_label", lambda x: x["tp"] + x["fp"] + x["fn"] > 0), lambda x: 2.0 * x["tp"] / (2 * x["tp"] + x["fp"] + x["fn"])
            ),
        }
    )
    return rows.withColumns(
        {
            "micro_f1": F.when(none, 1.0).otherwise(f1(c("micro_p"), c("micro_r"))),
            "macro_f1": F.when(F.size("scores") == 0, 1.0).otherwise(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / F.size("scores")),
            "mean_tiou": ratio(c("t_sum"), c("n_matched")),
            "gt_coverage": F.when(c("n_gt") == 0, 1.0).otherwise(ratio(c("n_matched"), c("n_gt"))),
            "pred_match_rate": F.when(c("n_pred") == 0, 1.0).otherwise(ratio(c("n_matched"), c("n_pred"))),
            "subset_acc": ratio(c("n_equal"), c("n_rows")),
            "hamming": ratio(c("fp") + c("fn"), c("n_rows") * c("n_keys")),
        }
    ).drop("scores", "t_sum")


MEANS = {
    "mean_gt_coverage": "gt_coverage", "mean_pred_match_rate": "pred_match_rate", "mean_subset_acc": "subset_acc", "mean_hamming": "hamming",
    "mean_micro_p": "micro_p", "mean_micro_r": "micro_r", "mean_micro_f1_all": "micro_f1", "mean_macro_f1": "macro_f1", "mean_num_gt": "n_gt",
    "mean_num_pred": "n_pred", "mean_num_matched": "n_matched", "mean_max_tiou_per_gt": "max_tiou_per_gt", "mean_max_tiou_per_pred": "max_tiou_per_pred",
}


def summary(metrics: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """One row per key: means over records, the headline F1 over records with a match (over all if none has one), pooled counts."""
    return summed(metrics.groupBy(*keys), keys, digits)


def summary_sets(metrics: DataFrame, sets: Sequence[Sequence[str]], *keys: str, total: str = "all", digits: int = 6) -> DataFrame:
    """summary_of_usable for several sets of the keys in one pass; keys that a set leaves out read `total` (taus: null)."""
    usable = F.col("skip_reason").isNull()
    rows = metrics.select(*keys, "skip_reason", *[F.when(usable, F.col(c)).alias(c) for c in dict.fromkeys([*MEANS.values(), "n_matched", "mean_tiou", "tp", "fp", "fn", "tn", "n_rows"])])
    made = summed(rows.groupingSets([[F.col(c) for c in x] for x in sets], *keys), keys, digits, [F.count("*").alias("n_files"), F.count("skip_reason").alias("n_skipped")])
    return filled(made, keys).na.fill(total, [k for k in keys if dict(made.dtypes)[k] == "string"])


def summed(grouped, keys: Sequence[str], digits: int, more: Sequence[Column] = ()) -> DataFrame:
    """The aggregates of grouped record metrics, and what follows from them. Rows of nulls count for nothing."""
    c = F.col
    hit = c("n_matched") > 0
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    rows = grouped.agg(
        F.count("n_matched").alias("n_records"), F.count(F.when(hit, 1)).alias("n_hit"),
        mean(F.when(hit, c("mean_tiou"))).alias("mean_tiou"),
        F.coalesce(F.avg(F.when(hit, c("micro_f1"))), F.avg("micro_f1")).alias("mean_micro_f1"),
        *[mean(c(v)).alias(k) for k, v in MEANS.items()],
        *[F.sum(x).alias(f"sum_{x}") for x in ("tp", "fp", "fn", "tn", "n_rows")], *more,
    )
    none = c("sum_tp") + c("sum_fp") + c("sum_fn") == 0
    p, r = ratio(c("sum_tp"), c("sum_tp") + c("sum_fp")), ratio(c("sum_tp"), c("sum_tp") + c("sum_fn"))
    bits = c("sum_tp") + c("sum_fp") + c("sum_fn") + c("sum_tn")
    rows = rows.withColumns(
        {
            "hit_share": ratio(c("n_hit"), c("n_records")),
            "pool_p": F.when(none, 1.0).otherwise(p), "pool_r": F.when(none, 1.0).otherwise(r), "pool_f1": F.when(none, 1.0).otherwise(f1(p, r)),
            "pool_acc": F.when(bits == 0, 1.0).otherwise(ratio(c("sum_tp") + c("sum_tn"), bits)),
        }
    )
    return rows.select(*[F.round(x, digits).alias(x) if t == "double" and x not in keys else c(x) for x, t in rows.dtypes])


def with_skips(metrics: DataFrame, valid: Column | None = None) -> DataFrame:
    """metrics (with n_keys) with skip_reason, null for usable records: the first rule that holds."""
    reason = F.when(~valid, "json_load_failed") if valid is not None else F.when(F.lit(False), "")
    reason = reason.when(F.col("n_gt") + F.col("n_pred") == 0, "empty_gt_and_pred").when(F.col("n_keys") == 0, "no_guardrail_keys")
    return metrics.withColumn("skip_reason", reason)


def summary_of_usable(metrics: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """summary over the records without skip_reason, with n_files (all), n_skipped, and n_f1: how many the headline F1 is the mean of.

    Keys whose records are all skipped stay, with zeros.
    """
    counts = metrics.groupBy(*keys).agg(F.count("*").alias("n_files"), F.count("skip_reason").alias("n_skipped"))
    made = summary(metrics.where("skip_reason is null"), *keys, digits=digits)
    return filled(counts.join(made, list(keys), "left"), keys)


def filled(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries with n_f1, and what keys without usable records read."""
    rows = rows.withColumn("n_f1", F.when(F.col("n_hit") > 0, F.col("n_hit")).otherwise(F.col("n_records")))
    ones = [c for c in ("pool_p", "pool_r", "pool_f1", "pool_acc") if c in rows.columns]
    return rows.na.fill(1.0, ones).na.fill(0, [c for c, t in rows.dtypes if c not in keys and t in ("bigint", "double")])


def label_universe(segments: DataFrame) -> list[str]:
    """All keys of the segments' labels, in order: a bounded list (a bit mask holds 31)."""
    return sorted(r.k for r in segments.select(F.explode(F.map_keys("labels")).alias("k")).distinct().limit(32).collect())


def evaluate(rows: DataFrame, taus: Sequence[float], policy: str = "strict", carried: Sequence[str] = (), universe: Sequence[str] | None = None) -> DataFrame:
    """Metrics of scanned records (rec_id, carried, is_valid, record) with their own label keys, and skip_reason.

    Every record stays, also without segments. Labels are numbered by their place in the universe of keys. The records are parsed once,
    to a written table that all later steps read.
    """
    rows = written(rows.select("rec_id", *carried, "is_valid", segment_array().alias("segments")), "parsed")
    found = rows.where("is_valid").select("rec_id", *carried, F.inline("segments"))
    names = label_universe(found) if universe is None else list(universe)
    coded = found.select("rec_id", *carried, "gt", "i", "s", "e", mask_of(F.col("labels"), names).alias("b"), mask_of(F.col("labels"), names, True).alias("kb"))
    made = record_metrics(coded, taus, policy, max(len(names), 1), carried, "kb").drop(*carried)
    every = rows.select("rec_id", *carried, "is_valid", F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau")).join(made, ["tau", "rec_id"], "left")
    every = every.na.fill(0, [c for c, t in made.dtypes if t == "bigint" and c != "rec_id"])
    return with_skips(every, F.col("is_valid"))


def label_pool(metrics: DataFrame, *keys: str, labels: int = 6, digits: int = 6) -> DataFrame:
    """keys, label (1, 2, ...; null for all labels): pooled counts, F1 and accuracy; one pass sums every label by key.

    Labels that no record of a key has show counts of zero.
    """
    names = ("tp", "fp", "fn", "tn")
    sums = metrics.groupBy(*keys).agg(*[F.sum(F.col("by_label")[j][x]).alias(f"{x}_{j}") for j in range(labels) for x in names])
    row = lambda j: F.struct(F.lit(j + 1).alias("label"), *[F.col(f"{x}_{j}").alias(x) for x in names])
    every = F.struct(F.lit(None).cast("int").alias("label"), *[sum((F.col(f"{x}_{j}") for j in range(1, labels)), F.col(f"{x}_0")).alias(x) for x in names])
    made = sums.select(*keys, F.inline(F.array(*map(row, range(labels)), every)))
    c = F.col
    return made.select(
        *keys, c("label").cast("long").alias("label"), "tp", "fp", "fn", "tn",
        F.round(F.when(c("tp") + c("fp") + c("fn") == 0, 1.0).otherwise(ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))), digits).alias("f1"),
        F.round(F.when(c("tp") + c("fp") + c("fn") + c("tn") == 0, 1.0).otherwise(ratio(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn"))), digits).alias("accuracy"),
    )


def set_accuracy(results: DataFrame, labels: int = 6, digits: int = 6) -> DataFrame:
    """label, tp, tn, fp, fn, accuracy over rows of label bits (g, p)."""
    rows = results.select(F.explode(F.array(*[F.struct(F.lit(j + 1).cast("long").alias("label"), has(F.col("g"), j).alias("g"), has(F.col("p"), j).alias("p")) for j in range(labels)])).alias("x")).select("x.*")
    tests = {"tp": "g and p", "tn": "not g and not p", "fp": "p and not g", "fn": "g and not p"}
    made = rows.groupBy("label").agg(*[F.count(F.when(F.expr(t), 1)).alias(n) for n, t in tests.items()], F.count("*").alias("n"))
    return made.select("label", *tests, F.round(ratio(F.col("tp") + F.col("tn"), F.col("n")), digits).alias("accuracy"))


def exact_match(results: DataFrame, digits: int = 6) -> DataFrame:
    """n, exact: how many rows of label bits (g, p) agree on all labels, and their share."""
    return results.agg(F.count("*").alias("n"), F.round(ratio(F.count(F.when(F.col("g") == F.col("p"), 1)), F.count("*")), digits).alias("exact"))


def video_labels(segments: DataFrame, *keys: str) -> DataFrame:
    """Per record: g and p, the union of the label bits of either side."""
    side = lambda c: F.coalesce(F.bit_or(F.when(c, F.col("b"))), F.lit(0))
    return segments.groupBy("rec_id", *keys).agg(side(F.col("gt")).alias("g"), side(~F.col("gt")).alias("p"))


def by_label(segments: DataFrame, labels: int = 6) -> DataFrame:
    """A row of each segment for each of its labels."""
    each = F.filter(F.array(*[F.when(has(F.col("b"), j), F.lit(j + 1).cast("long")) for j in range(labels)]), lambda x: x.isNotNull())
    return segments.withColumn("label", F.explode(each))


def temporal_metrics(segments: DataFrame, scope: str = "pooled", labels: int = 6, digits: int = 6) -> DataFrame:
    """Per label: interval counts, matches, accuracy, precision and mean tIoU for any overlap, 0.5 and 0.7.

    scope "pooled" matches the intervals of a label over all records together (level by level, by peeling); "record"
    matches inside each record. A ratio without denominator is null.
    """
    rows = by_label(segments, labels)
    counts = rows.groupBy("label").agg(F.count(F.when(F.col("gt"), 1)).alias("n_gt"), F.count(F.when(~F.col("gt"), 1)).alias("n_pred"))
    names = {"any": 1e-9, "05": 0.5, "07": 0.7}
    if scope == "pooled":
        at = F.explode(F.array(*[F.struct(F.lit(n).alias("at"), F.lit(tau).alias("tau")) for n, tau in names.items()]))
        matched_once = cut(greedy_spread(rows.select("label", "gt", "i", "s", "e"), "label", min(names.values())))
        found = matched_once.select("label", "t", at.alias("x")).where("t >= x.tau").select("label", "x.at", "t")
    else:
        own = rows.withColumn("rec_id", F.struct("rec_id", "label"))
        at = F.element_at(F.create_map(*[F.lit(x) for n, tau in names.items() for x in (float(tau), n)]), F.col("tau"))
        found = matches_at(own, list(names.values()), "pred").select(F.col("rec_id.label").alias("label"), at.alias("at"), "t")
    made = found.groupBy("label").agg(*[a for n in names for a in (F.count(F.when(F.col("at") == n, 1)).alias(f"n_{n}"), (mean_of_millionths(F.when(F.col("at") == n, F.col("t")))).alias(f"tiou_{n}"))])
    every = segments.sparkSession.range(1, labels + 1).select(F.col("id").alias("label"))
    rows = every.join(counts, "label", "left").join(made, "label", "left").na.fill(0, ["n_gt", "n_pred", "n_any", "n_05", "n_07"])
    c = F.col
    return rows.select(
        "label", "n_gt", "n_pred", "n_any", "n_05", "n_07",
        *[F.round(ratio_or_null(c(f"n_{n}"), c(s)), digits).alias(f"{k}_{n}") for n in ("05", "07") for k, s in (("accuracy", "n_gt"), ("precision", "n_pred"))],
        *[F.round(f"tiou_{n}", 12).alias(f"tiou_{n}") for n in names],
    )


def mean_of_millionths(t: Column) -> Column:
    """Aggregate: the mean of t rounded to millionths, summed as whole numbers so that the order of rows has no say."""
    return F.try_divide(F.sum(F.round(t * 1_000_000, 0).cast("long")).cast("double"), F.count(t)) / 1_000_000


def macro(temporal: DataFrame, digits: int = 6) -> DataFrame:
    """Means over the labels of what temporal_metrics gives, nulls left out."""
    return temporal.agg(*[F.round(F.avg(x), digits).alias(f"macro_{x}") for x in ("accuracy_05", "accuracy_07", "tiou_any", "tiou_05", "tiou_07")])


def skip_reasons(records: DataFrame) -> DataFrame:
    """reason, n: why records are not usable, by the first rule that holds. records: is_valid, n_gt, n_pred, n_keys."""
    reason = F.when(~F.col("is_valid"), "json_load_failed").when(F.col("n_gt") + F.col("n_pred") == 0, "empty_gt_and_pred").when(F.col("n_keys") == 0, "no_guardrail_keys").otherwise("usable")
    return records.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
