"""Curation: splits, caps and samples by a seeded hash order, schedules, plans of inserted intervals, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import has


def hash_order(id_col: str, seed: int) -> Column:
    """A seeded order that any engine can repeat: MD5 of ``id:seed``."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def ranked(rows: DataFrame, group: str, id_col: str, seed: int) -> DataFrame:
    """rows with rn (1, 2, ... in hash order) and cnt, per group.

    A hot group is not gathered in one task: ranks come from 256 hash ranges of each group, whose counts are summed first.
    """
    keyed = rows.withColumns({"_h": hash_order(id_col, seed)}).withColumn("_r", F.substring("_h", 1, 2))
    sizes = keyed.groupBy(group, "_r").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "_r", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"), F.sum("_c").over(Window.partitionBy(group)).alias("cnt"))
    own = Window.partitionBy(group, "_r").orderBy("_h", id_col)
    here = F.row_number().over(own)
    return keyed.withColumn("_n", here).join(sizes.select(F.col(group).alias("_g"), F.col("_r").alias("_q"), "_b", "cnt"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_q"))).withColumn("rn", F.col("_n") + F.col("_b")).drop("_h", "_r", "_n", "_b", "_g", "_q")


def stratified_split(rows: DataFrame, group: str, id_col: str, ratio: float = 0.1, seed: int = 7) -> DataFrame:
    """rows with part: eval for the first ceil(ratio * n) of each group in hash order, at least one, at most n - 1 (one for n = 1)."""
    n = F.least(F.greatest(F.lit(1), F.ceil(F.col("cnt") * ratio)), F.when(F.col("cnt") == 1, F.lit(1)).otherwise(F.col("cnt") - 1))
    return ranked(rows, group, id_col, seed).withColumn("part", F.when(F.col("rn") <= n, "eval").otherwise("train")).drop("rn", "cnt")


def group_cap(rows: DataFrame, group: str, id_col: str, cap: int, seed: int = 7) -> DataFrame:
    """At most cap rows of each group, the first in hash order."""
    return ranked(rows, group, id_col, seed).where(F.col("rn") <= cap).drop("rn", "cnt")


def group_cap_counts(rows: DataFrame, group: str, cap: int) -> DataFrame:
    """group, n, kept, dropped."""
    made = rows.groupBy(group).agg(F.count("*").alias("n"))
    return made.select(group, "n", F.least("n", F.lit(cap)).alias("kept"), F.greatest(F.col("n") - cap, F.lit(0)).alias("dropped"))


def schedule(groups: DataFrame, none: int, single: int, pair: int, pairs: Sequence[tuple[str, str]], seed: int = 7) -> DataFrame:
    """slot, labels: `none` empty rows, `single` rows of each group of (name) and `pair` rows of each pair, in seeded hash order."""
    spark = groups.sparkSession
    times = lambda df, n: df.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(n)))) if n else df.withColumn("_", F.lit(1)).limit(0)
    kind = "array<string>"
    empty = spark.range(1).select(F.array().cast(kind).alias("labels"))
    two = spark.createDataFrame([(list(p),) for p in pairs], f"labels {kind}")
    made = times(empty, none).unionByName(times(groups.select(F.array("name").alias("labels")), single)).unionByName(times(two, pair))
    named = made.select("labels", F.concat_ws(":", F.array_join("labels", ","), F.col("_").cast("string")).alias("_id"), F.lit(0).alias("_all"))
    return ranked(named, "_all", "_id", seed).select(F.col("rn").alias("slot"), "labels")


def shifted(inserted: DataFrame, key: str) -> DataFrame:
    """Insertions (key, at, length) with start: where each lies once the earlier ones have pushed it."""
    before = Window.partitionBy(key).orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1)
    return inserted.withColumn("start", F.col("at") + F.coalesce(F.sum("length").over(before), F.lit(0.0)))


def dataset_summary(shots: DataFrame, key: str = "rec_id", labels: int = 6) -> DataFrame:
    """label (0 for all), n_samples with it, n_shots with it; for 0 also how many samples and shots carry any label.

    Labels without rows count 0.
    """
    per = shots.groupBy(key).agg(F.bit_or("b").alias("any"), F.count("*").alias("shots"), F.count(F.when(F.col("b") != 0, 1)).alias("harmful"),
                                 *[F.count(F.when(has(F.col("b"), j), 1)).alias(f"l{j}") for j in range(labels)])
    one = per.agg(F.count("*").alias("n"), F.count(F.when(F.col("any") != 0, 1)).alias("hn"), F.coalesce(F.sum("shots"), F.lit(0)).alias("s"), F.coalesce(F.sum("harmful"), F.lit(0)).alias("hs"),
                  *[x for j in range(labels) for x in (F.count(F.when(has(F.col("any"), j), 1)).alias(f"n{j}"), F.coalesce(F.sum(f"l{j}"), F.lit(0)).alias(f"s{j}"))])
    row = lambda label, n, s, hn, hs: F.struct(F.lit(label).cast("long").alias("label"), F.col(n).alias("n_samples"), F.col(s).alias("n_shots"), F.col(hn).alias("n_harmful_samples"), F.col(hs).alias("n_harmful_shots"))
    rows = [row(0, "n", "s", "hn", "hs"), *[row(j + 1, f"n{j}", f"s{j}", f"n{j}", f"s{j}") for j in range(labels)]]
    return one.select(F.inline(F.array(*rows)))


def first_where(value: Column, order: Column, test: Column) -> Column:
    """Aggregate: the value of the first row, by order, that passes the test."""
    return F.min_by(F.when(test, value), F.when(test, order))


def dispositions(rows: DataFrame, rules: Sequence[tuple[str, Column]], kept: str = "included") -> DataFrame:
    """rows with disposition: the name of the first rule that holds, else kept."""
    made = F.lit(kept)
    for name, rule in reversed(rules):
        made = F.when(rule, F.lit(name)).otherwise(made)
    return rows.withColumn("disposition", made)


def assert_balanced(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, expected, actual; raises when run if any count differs."""
    count = lambda df, n: df.groupBy(F.col(key).alias(key)).agg(F.count("*").alias(n))
    both = count(expected, "expected").join(count(actual, "actual"), key, "full_outer").na.fill(0, ["expected", "actual"])
    same = F.assert_true(F.col("expected") == F.col("actual"), F.concat(F.lit("counts differ for "), F.col(key).cast("string")))
    return both.where(same.isNull())


def collect_samples(clips: DataFrame, max_duration: float = 60.0, max_gap: float = 5.0, include_benign: bool = True) -> DataFrame:
    """One row per sample with its shots and why it is excluded (reasons in rule order, empty if it stays).

    clips: sample, category, duration, s, e, b, standard (bool), ord, is_full (the whole video's own row).
    The whole video's row stands in as the only shot where no clip has a range.
    """
    shot = F.struct("s", "e", "b")
    clip = ~F.col("is_full")
    rows = clips.groupBy("sample").agg(
        F.max("category").alias("category"), F.max("duration").alias("duration"),
        F.sort_array(F.collect_list(F.when(clip & F.col("s").isNotNull() & (F.col("e") > F.col("s")), shot))).alias("shots"),
        F.bool_or(clip & ~(F.coalesce(F.col("e") > F.col("s"), F.lit(False)))).alias("bad_range"),
        F.bool_or(clip & ~F.col("standard")).alias("bad_schema"),
        first_where(F.col("b"), F.col("ord"), F.col("is_full") & F.col("standard")).alias("full_b"),
    )
    whole = F.array(F.struct(F.lit(0.0).alias("s"), F.round("duration", 6).alias("e"), F.col("full_b").alias("b")))
    rows = rows.withColumn("shots", F.when(F.col("bad_range"), F.slice("shots", 1, 0)).when((F.size("shots") == 0) & F.col("full_b").isNotNull(), whole).otherwise(F.col("shots")))
    step = lambda a, x: F.struct((a["ok"] & (x["s"] - a["reach"] >= 0) & (x["s"] - a["reach"] <= max_gap)).alias("ok"), F.greatest(a["reach"], x["e"]).alias("reach"))
    start = lambda s: F.struct((s[0]["s"] <= max_gap).alias("ok"), s[0]["e"].alias("reach"))
    run = F.aggregate(F.slice("shots", 2, F.greatest(F.size("shots") - 1, F.lit(0))), start(F.col("shots")), step)
    covered = (F.size("shots") > 0) & run["ok"] & (F.greatest(F.lit(0.0), F.col("duration") - F.try_element_at("shots", F.lit(-1))["e"]) <= max_gap + 1e-6)
    rules = {
        "over_duration": F.col("duration") > max_duration, "bad_clip_range": F.col("bad_range"), "nonstandard_clip": F.col("bad_schema"),
        "missing_shots": F.size("shots") == 0, "bad_coverage": (F.size("shots") > 0) & ~covered,
        "benign": F.lit(not include_benign) & F.forall("shots", lambda x: x["b"] == 0),
    }
    reasons = F.filter(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    return rows.select("sample", "category", "duration", "shots", reasons.alias("reasons"))


def schedule_summary(slots: DataFrame) -> DataFrame:
    """what, n: the slots, those with 0, 1 and 2 labels, and how often each label is planned."""
    by = slots.groupBy(F.concat(F.lit("insert_"), F.size("labels").cast("string")).alias("what")).agg(F.count("*").alias("n"))
    each = slots.select(F.explode("labels").alias("l")).groupBy(F.concat("l", F.lit("_segments")).alias("what")).agg(F.count("*").alias("n"))
    return slots.agg(F.lit("num_samples").alias("what"), F.count("*").alias("n")).unionByName(by).unionByName(each)


def frequencies(rows: DataFrame, *columns: str) -> DataFrame:
    """what, value, n: how often each value of each column occurs; one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).groupBy("what", "value").agg(F.count("*").alias("n"))


def pick(rows: DataFrame, pool: DataFrame, id_col: str, pool_id: str, good: Column, seed: int = 7) -> DataFrame:
    """rows with pick: a seeded choice among the pool's good rows, each as likely. Bad rows can't be drawn, so none is drawn again.

    Good rows are numbered in hash order (counts by hash range first); a row takes the number that its own hash gives.
    """
    numbered = ranked(pool.where(good).select(F.col(pool_id).alias("pick"), F.lit(0).alias("_all")), "_all", "pick", seed).select("pick", "rn", "cnt")
    n = numbered.agg(F.coalesce(F.max("cnt"), F.lit(1)).alias("_m"))
    drawn = F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("long")
    asked = rows.join(F.broadcast(n), F.lit(True)).withColumn("rn", F.pmod(drawn, F.col("_m")) + 1).drop("_m")
    found = asked.join(numbered.drop("cnt"), "rn", "left").drop("rn")
    stop = F.raise_error(F.lit("nothing to pick from")).cast(numbered.schema["pick"].dataType)
    return found.withColumn("pick", F.coalesce("pick", stop))


def first_accepted(attempts: DataFrame, id_col: str, number: str, ok: Column, limit: int = 50) -> DataFrame:
    """The first accepted of each id's first `limit` attempts, by number; raises when run for an id without one."""
    held = F.struct(*[c for c in attempts.columns if c != id_col])
    tried = F.col(number) <= limit
    rows = attempts.groupBy(id_col).agg(F.min_by(F.when(tried & ok, held), F.when(tried & ok, F.col(number))).alias("_x"))
    stop = F.raise_error(F.concat(F.lit("no attempt accepted for "), F.col(id_col).cast("string")))
    return rows.select(id_col, F.coalesce("_x", stop.cast(rows.schema["_x"].dataType)).alias("_x")).select(id_col, "_x.*")


def zip_positions(positions: Column, clips: Column) -> Column:
    """Array of (at, clip): the n-th position with the n-th clip, by position."""
    return F.array_sort(F.transform(positions, lambda p, i: F.struct(p.alias("at"), F.get(clips, i).alias("clip"))))


def members(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the allowed ones."""
    return rows.join(allowed.select(key).distinct(), key, "left_semi")


def parent_groups(rows: DataFrame) -> DataFrame:
    """Annotated rows (ord, category, video, answer) by whole recording: its first usable answer of the whole, its clips, and what was skipped.

    Returns parent, category, full (the first standard answer of the whole that has its texts), clips (path, answer: the
    first of each path, by path), incomplete (a clip's answer didn't parse, isn't standard, or lacks texts) and counts.
    """
    from tidemark.functions import jsonx, texts
    from tidemark.functions.labels import is_standard

    parsed = jsonx.three_part_answer(F.col("answer"))
    rows = rows.withColumns({"parent": texts.full_path(F.col("video")), "is_clip": F.col("video").startswith("dataset/clip/"), "p": parsed})
    rows = rows.where("parent is not null").withColumns({"good": jsonx.clip_answer(F.col("p")), "standard": F.coalesce(is_standard(F.col("p.labels")), F.lit(False))})
    fine = F.col("standard") & F.col("good").isNotNull()
    bad_clip = F.col("is_clip") & ~fine
    firsts = rows.where(F.col("is_clip") & fine).groupBy("parent", "video").agg(F.min_by("good", "ord").alias("good"))
    clips = firsts.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct(F.col("video").alias("path"), F.col("good.description").alias("description"), F.col("good.explanation").alias("explanation")))).alias("clips"))
    whole = ~F.col("is_clip") & F.col("p").isNotNull()
    made = rows.groupBy("parent").agg(
        F.min_by("category", "ord").alias("category"), first_where(F.col("good"), F.col("ord"), whole & fine).alias("full"), F.bool_or(bad_clip).alias("incomplete"),
        F.count_if(whole).alias("full_records_seen"), F.count_if(F.col("is_clip") & fine).alias("clip_records_seen"),
        F.count_if(F.col("p").isNull()).alias("skipped_unparseable_response"), F.count_if(F.col("is_clip") & F.col("p").isNotNull() & ~F.col("standard")).alias("skipped_nonstandard_clip_response"),
    )
    return made.join(clips, "parent", "left")


def harmful_source(video: Column, duration: Column, shots: Column, longest: float) -> Column:
    """Why a record can't give a clip to insert, null if it can: its folder must end in _benchmark, its duration and shots must do."""
    place = F.try_element_at(F.split(video, "/"), F.lit(-2))
    rules = {
        "wrong_folder": ~F.coalesce(place.endswith("_benchmark"), F.lit(False)), "wrong_duration": ~F.coalesce((duration > 0) & (duration <= longest), F.lit(False)),
        "no_shots": shots.isNull(), "no_harm": ~F.exists(shots, lambda x: x["b"] != 0),
    }
    why = F.when(F.lit(False), "")
    for name, rule in rules.items():
        why = why.when(rule, name)
    return why
