"""Queries over written files: what the scans read is first written to the shared folder, so SQL can say what must come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import oracle as sql
from tidemark.checkpoints import cut, scratch
from tidemark.functions import dialects, labels
from tidemark.operators import compare, matching, metrics
from tidemark.plans import evaluation, media
from tidemark.registry import query, read
from tidemark.sources import datasource, records, scans, sinks
from tidemark.sources.events import SQL as SEG
from tidemark.sources.events import segments


def broken_line(good: Column, i: Column) -> Column:
    """Some lines that are no objects, and blank ones."""
    return F.when(i % 97 == 0, "{broken").when(i % 89 == 0, "[1, 2]").when(i % 83 == 0, "  ").otherwise(good)


LINES = """WITH l AS (SELECT event_id AS i, event_id % 97 = 0 AS a, event_id % 97 <> 0 AND event_id % 89 = 0 AS b, event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 = 0 AS c FROM events)"""


@query(LINES + """ SELECT count(*) FILTER (NOT c) AS n, count(*) FILTER (a OR b) AS n_bad, count(*) FILTER (a) AS n_bad_json, CAST(sum(i) FILTER (NOT a AND NOT b AND NOT c) AS BIGINT) AS index_sum, count(*) AS n_lines FROM l""")
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, some broken, some blank: lenient, and lenient about what isn't an object; numbers count all lines."""
    path = scratch(spark, "lines")
    i = F.col("event_id")
    good = F.to_json(F.struct(i.cast("string").alias("jsonl_record_index"), F.lit(1).alias("iteration")))
    read(spark, sf_dir, "events").select(broken_line(good, i).alias("value"), i).orderBy("event_id").select("value").write.text(path)
    out = scratch(spark, "scanned")
    counts = records.scan_to(spark, path, out)
    return spark.read.parquet(out).agg(F.sum("rec_idx").cast("long").alias("index_sum"), *[F.lit(v).cast("long").alias(k) for k, v in counts.items()])


@query("SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents")
def strict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines with their nulls, and read back by the strict scan."""
    path = scratch(spark, "strict")
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source"))
    sinks.write_jsonl(rows, path, "doc_id")
    return records.jsonl(spark, path, "failfast", rows.schema).select("record.*")


def with_keys(rows: DataFrame) -> DataFrame:
    from tidemark.queries import with_keys as add

    return add(rows)


def eval_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, iter, model_id, line: evaluation records as JSON; broken where a segment has k = 99."""
    rows = with_keys(segments(spark, sf_dir))
    named = F.map_from_entries(F.filter(F.array(*[F.when(labels.has(F.col("kb"), j), F.struct(F.lit(n).alias("key"), labels.has(F.col("b"), j).alias("value"))) for j, n in enumerate(labels.STANDARD)]), lambda x: x.isNotNull()))
    rows = rows.withColumn("x", F.struct("i", F.col("s").alias("start"), F.col("e").alias("end"), named.alias("guardrail")))
    side = lambda c: F.sort_array(F.collect_list(F.when(c, F.struct(F.col("x.i"), F.struct("x.start", "x.end", F.to_json("x.guardrail").alias("g")).alias("y")))))
    recs = rows.groupBy("rec_id", "iter", "model_id").agg(F.bool_or(F.col("k") == 99).alias("bad"), side(F.col("gt")).alias("g"), side(~F.col("gt")).alias("p"))

    def payload(c: str) -> Column:
        key = lambda i: F.concat(F.lit("chunk_"), (i + 1).cast("string"))
        chunk = lambda x: F.struct(x["y"]["start"].alias("start"), x["y"]["end"].alias("end"), F.from_json(x["y"]["g"], "map<string,boolean>").alias("guardrail"))
        return F.struct(F.map_from_entries(F.transform(c, lambda x, i: F.struct(key(i), chunk(x)))).alias("chunks"), F.transform(c, lambda x, i: key(i)).alias("chunk_order"))

    body = F.struct(F.col("iter").alias("iteration"), F.struct(payload("g").alias("intervals")).alias("ground_truth"), F.struct(payload("p").alias("intervals")).alias("prediction"))
    return recs.select("rec_id", "iter", "model_id", F.when(F.col("bad"), "{broken").otherwise(F.to_json(body)).alias("line"))


def iteration_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of results by iteration, the last one in the old layout of a file per record."""
    root = scratch(spark, "iterations")
    made = cut(eval_lines(spark, sf_dir))
    at = lambda form, *c: F.format_string(form, *c)
    last = F.col("iter") == 4
    sinks.write_files(made.where(~last).withColumn("name", at("iter_%d/records.jsonl", "iter")), root, "name", "line", "rec_id")
    sinks.write_files(made.where(last).withColumn("name", F.when(F.col("rec_id") % 20 < 10, at("iter_%d/pred_%d.json", "iter", "rec_id")).otherwise(at("iter_%d_pred_%d.json", "iter", "rec_id"))), root, "name", "line", "rec_id")
    return root


@query(f"""WITH {SEG}, r AS (SELECT rec_id, iter, bool_or(k = 99) AS bad, count(*) FILTER (gt) AS g, count(*) FILTER (NOT gt) AS p FROM seg GROUP BY ALL)
SELECT CAST(iter AS INT) AS iter, count(*) AS n, count(*) FILTER (bad) AS n_bad, CAST(coalesce(sum(g) FILTER (NOT bad), 0) AS BIGINT) AS n_gt, CAST(coalesce(sum(p) FILTER (NOT bad), 0) AS BIGINT) AS n_pred FROM r WHERE iter >= 2 GROUP BY iter""")
def record_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder read by its own format; the filter on iterations leaves files unopened."""
    datasource.register(spark)
    rows = datasource.with_records(spark.read.format(datasource.NAME).load(iteration_folder(spark, sf_dir)).where("iter >= 2"))
    n = lambda side: F.sum(F.when(F.col("is_valid"), F.size(f"record.{side}.intervals.chunk_order")).otherwise(0)).cast("long")
    return rows.groupBy("iter").agg(F.count("*").alias("n"), F.count_if(~F.col("is_valid")).alias("n_bad"), n("ground_truth").alias("n_gt"), n("prediction").alias("n_pred"))


@query(sql.summary_of_usable((0.5,), "strict", "tau, iter", metrics.MEANS))
def evaluated_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of results by iteration, the last one in the old layout of a file per record, scanned and evaluated with the records' own labels."""
    root = iteration_folder(spark, sf_dir)
    rows = records.iteration_records(spark, root).withColumn("rec_id", F.struct("iter", "rec_idx"))
    return metrics.summary_of_usable(metrics.evaluate(rows, (0.5,), carried=("iter",)), "tau", "iter")


@query(f"WITH {SEG}, r AS (SELECT rec_id, model_id, iter, bool_or(k = 99) AS bad FROM seg GROUP BY ALL) SELECT 'm' || model_id || '/w' || iter || '/record' AS model, count(*) AS n, count(*) FILTER (bad) AS n_bad FROM r GROUP BY ALL")
def model_result_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by model and week; files named records.jsonl are left out."""
    root = scratch(spark, "models")
    made = cut(eval_lines(spark, sf_dir))
    name = lambda form: made.withColumn("name", F.format_string(form, "model_id", "iter"))
    sinks.write_files(name("m%d/w%d/record.jsonl").unionByName(name("m%d/w%d/records.jsonl")), root, "name", "line", "rec_id")
    return records.valid_counts(records.model_results(spark, root), "model")


@query(sql.summary_of_usable((0.3, 0.5), "strict", "tau, model_id", metrics.MEANS).replace(
    "SELECT z.*, n_files, n_skipped, CASE WHEN n_hit > 0 THEN n_hit ELSE n_records END AS n_f1 FROM",
    "SELECT 'run' AS run, CAST(model_id AS VARCHAR) AS model, 'm.jsonl' AS source_jsonl, tau AS tiou_threshold, 'strict' AS unmatched_policy, mean_micro_f1 AS f1, mean_micro_f1_all AS f1_all, mean_tiou AS tiou, mean_gt_coverage AS coverage, hit_share AS hit, CASE WHEN n_hit > 0 THEN n_hit ELSE n_records END AS n_f1, n_records AS n_records_all FROM",
))
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison table of models under its own column names, written as CSV and read back."""
    from tidemark.queries import model_summary_of_usable

    rows = model_summary_of_usable(spark, sf_dir).where("tau < 0.6")
    named = rows.withColumns({"run": F.lit("run"), "model": F.col("model_id").cast("string"), "source_jsonl": F.lit("m.jsonl"), "unmatched_policy": F.lit("strict")})
    table = sinks.report_table(named, sinks.MODEL_COLUMNS)
    path = scratch(spark, "model-table")
    sinks.write_csv(table, path, "tiou_threshold", "run", "model")
    return spark.read.schema(table.schema).csv(path, header=True)


REPORT = sql.summary_of_usable((0.3, 0.5), "strict", "tau, run, model", metrics.MEANS).replace(
    "\nc AS (SELECT tau, run, model,", """
runs AS (SELECT 'by_model' AS run, 'm' || model_id AS model, * FROM rm UNION ALL SELECT 'by_week', 'w/' || iter, * FROM rm),
c AS (SELECT tau, run, model,""").replace("FROM rm GROUP BY tau, run, model", "FROM runs GROUP BY SETS").replace("FROM rm WHERE ok GROUP BY tau, run, model", "FROM runs WHERE ok GROUP BY SETS").replace(
    "SELECT tau, run, model,", "SELECT runs.tau AS tau, coalesce(runs.run, 'all') AS run, coalesce(runs.model, 'all') AS model,").replace(
    "GROUP BY SETS", "GROUP BY GROUPING SETS ((runs.tau, runs.run, runs.model), (runs.tau, runs.run), (runs.tau))")


def run_roots(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Three runs: results by model, results by week beside an iteration folder, and an iteration folder alone."""
    made = cut(eval_lines(spark, sf_dir))
    at = lambda form, *c: made.withColumn("name", F.format_string(form, *c))
    roots = {name: scratch(spark, name) for name in ("by_model", "by_week", "iterations_only")}
    sinks.write_files(at("m%d.jsonl", "model_id"), roots["by_model"], "name", "line", "rec_id")
    sinks.write_files(at("w/%d.jsonl", "iter").unionByName(at("iter_%d/records.jsonl", "iter")), roots["by_week"], "name", "line", "rec_id")
    sinks.write_files(at("iter_%d/records.jsonl", "iter"), roots["iterations_only"], "name", "line", "rec_id")
    return roots


@query(REPORT)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several runs in one pass: one has files of models, so all are read by model. By tau, run and model, with totals."""
    mode, rows = evaluation.report(spark, run_roots(spark, sf_dir), (0.5, 0.3))
    assert mode == evaluation.MODELS
    return rows


@query(f"{REPORT.split('SELECT z.*')[0]} SELECT tau, run, model, z.mean_micro_f1, z.n_records, n_files FROM c JOIN z USING (tau, run, model) WHERE model <> 'all'")
def evaluation_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as a JSON document through the cluster's file system, read back."""
    mode, rows = evaluation.report(spark, run_roots(spark, sf_dir), (0.3, 0.5))
    root = scratch(spark, "report")
    leaves = rows.where("model <> 'all'").withColumnRenamed("tau", "threshold")
    sinks.write_report(leaves, root, "report.json", "threshold", "run", "model", tiou_thresholds=[0.3, 0.5], unmatched_policy="strict", mode=mode)
    row = "struct<mean_micro_f1:double,n_records:bigint,n_files:bigint>"
    back = spark.read.text(root, wholetext=True).select(F.from_json("value", f"mode string, by_threshold map<string,struct<runs:map<string,map<string,{row}>>>>").alias("d")).where("d.mode = 'model_jsonl'")
    found = back.select(F.explode("d.by_threshold").alias("tau", "x")).select("tau", F.explode("x.runs").alias("run", "y")).select("tau", "run", F.explode("y").alias("model", "v"))
    return found.select(F.col("tau").cast("double").alias("tau"), "run", "model", "v.*")


RESULTS = f"""WITH {SEG}, p AS (SELECT rec_id, count(*) AS n, round(sum(round(s, 5)), 5) AS s, round(sum(round(e, 5)), 5) AS e, CAST(sum(bit_count(b)) AS BIGINT) AS labels FROM seg WHERE NOT gt GROUP BY rec_id),
g AS (SELECT rec_id, count(*) AS n, round(sum(round(s, 5)), 5) AS s, CAST(sum(bit_count(b)) AS BIGINT) AS labels FROM seg WHERE gt GROUP BY rec_id), r AS (SELECT DISTINCT rec_id FROM seg)
SELECT 'r' || rec_id AS key, coalesce(p.n, 0) AS n_left, coalesce(p.s, 0) AS left_s, coalesce(p.e, 0) AS left_e, coalesce(p.labels, 0) AS left_labels, coalesce(p.n, 0) AS n_right, round(coalesce(p.s + p.n, 0), 5) AS right_s,
  coalesce(g.n, 1) AS n_gt, coalesce(g.s, 99) AS gt_s, coalesce(g.labels, 0) AS gt_labels FROM r LEFT JOIN p USING (rec_id) LEFT JOIN g USING (rec_id)"""


def dialect_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set, name, n, line): result sets left and right as JSON lines by file, right with each key twice, the first time wrong, and the annotations as conversations."""
    rows = segments(spark, sf_dir).withColumns({"s": F.round("s", 5), "e": F.round("e", 5)})
    recs = matching.records(rows)
    flags = lambda b: F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.struct(F.concat(F.lit("C"), (j + 1).cast("string")), F.when(F.pmod(F.call_function("shiftright", b, j), F.lit(2)) == 1, "true").otherwise("0"))))
    lower = lambda x, more: F.struct((x["s"] + more).alias("start"), (x["e"] + more).alias("end"), flags(x["b"]).alias("guardrail"))
    upper = lambda x, more: F.struct((x["s"] + more).alias("START_SEC"), (x["e"] + more).cast("string").alias("END_SEC"), flags(x["b"]).alias("GUARDRAIL"))
    key = lambda i: F.concat(F.lit("chunk_"), i.cast("string"))

    def side(more: float) -> Column:
        chunks = F.map_from_entries(F.transform("pred", lambda x, i: F.struct(key(i), lower(x, more))))
        text = F.concat(F.lit("```"), F.to_json(F.transform("pred", lambda x: upper(x, more))), F.lit("```"))
        return F.struct(
            F.struct(F.when(F.col("rec_id") % 3 < 2, chunks).alias("chunks"), F.when(F.col("rec_id") % 3 == 0, F.transform("pred", lambda x, i: key(i))).alias("chunk_order")).alias("intervals"),
            F.when(F.col("rec_id") % 3 == 2, text).alias("supervised_span_text"),
        )

    line = lambda **x: F.to_json(F.struct(F.concat(F.lit("r"), F.col("rec_id").cast("string")).alias("key"), *[v.alias(k) for k, v in x.items()]))
    turn = lambda who, v: F.struct(F.lit(who).alias("from"), v.alias("value"))
    told = F.array(turn("human", F.lit("[]")), turn("gpt", F.lit("[]")), turn("gpt", F.to_json(F.transform("gt", lambda x: upper(x, 0.0)))), turn("gpt", F.lit('[{"start": 99}]')))
    one = lambda name, n, text: F.struct(F.lit(name).alias("set"), F.lit(n).alias("n"), text.alias("line"))
    sets = F.array(one("left", 0, line(prediction=side(0.0))), one("right", 0, line(prediction=side(7.0))), one("right", 1, line(prediction=side(1.0))), one("truth", 0, line(conversations=told)))
    return recs.select(F.inline(sets), "rec_id").withColumn("name", F.format_string("%s/%d.jsonl", "set", F.col("rec_id") % 8))


@query(RESULTS)
def joined_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result sets and the annotations from JSON lines of either dialect; of repeated keys the last line counts on the right."""
    root = scratch(spark, "dialects")
    sinks.write_files(cut(dialect_lines(spark, sf_dir)).withColumn("o", F.col("rec_id") * 2 + F.col("n")), root, "name", "line", "o")

    def scanned(name: str, found) -> DataFrame:
        rows = records.lines(spark, f"{root}/{name}").withColumn("v", F.try_parse_json("raw"))
        return rows.select(F.try_variant_get("v", "$.key", "string").alias("key"), F.struct("file", "line").alias("at"), found(F.col("v")).alias(name))

    predicted = lambda v: dialects.side_intervals(v, "prediction")
    both = scanned("left", predicted).drop("at").join(compare.last_wins(scanned("right", predicted), "key", "at").drop("at"), "key")
    rows = both.join(scanned("truth", dialects.conversation_intervals).drop("at"), "key")
    total = lambda c, k: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x[k]), 5)
    labels_of = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.size(x["labels"])).cast("long")
    n = lambda c: F.size(c).cast("long")
    return rows.select("key", n("left").alias("n_left"), total("left", "s").alias("left_s"), total("left", "e").alias("left_e"), labels_of("left").alias("left_labels"), n("right").alias("n_right"),
                       total("right", "s").alias("right_s"), n("truth").alias("n_gt"), total("truth", "s").alias("gt_s"), labels_of("truth").alias("gt_labels"))


CLIPS = """WITH c AS (SELECT event_id AS id, 'C' || (1 + user_id % 3) AS category, CASE WHEN user_id % 5 = 0 THEN 'benign_set' ELSE 'set' || user_id % 2 END AS benchmark, event_id % 7 <> 0 AS labelled, event_id % 11 <> 0 AS here, value AS d FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY category, benchmark ORDER BY id) - 1 AS n FROM c)"""


def clip_folder(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder of clip lists by category, and the media table of the files that exist. Every event is a clip."""
    root = scratch(spark, "clips")
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    path = F.format_string("video/%d.mp4", "event_id")
    item = F.struct(path.alias("video_path"), F.when(F.col("event_id") % 7 != 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("labels"))
    name = F.format_string("real/C%d/%s.json", 1 + F.col("user_id") % 3, F.when(F.col("user_id") % 5 == 0, "benign_set").otherwise(F.concat(F.lit("set"), (F.col("user_id") % 2).cast("string"))))
    lists = e.groupBy(name.alias("name")).agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", item.alias("item")))), lambda x: x["item"]).alias("items"))
    sinks.write_files(lists.select("name", F.to_json("items").alias("line"), F.lit(0).alias("o")), root, "name", "line", "o")
    return root, e.where("event_id % 11 <> 0").select(F.concat(F.lit(root + "/"), path).alias("path"), F.col("value").alias("duration"))


@query(CLIPS + """, s AS (SELECT category, benchmark, n, category || '__' || benchmark || '__' || CASE WHEN n < 10000 THEN right('0000' || n, 4) ELSE n::VARCHAR END AS sample_id, CASE WHEN NOT here THEN 'excluded_missing_video' WHEN d > 60 THEN 'excluded_over_duration' ELSE 'included' END AS disposition,
CASE WHEN contains(benchmark, 'benign') OR NOT labelled THEN '' ELSE category END AS gt FROM f) SELECT sample_id, disposition, gt FROM s""")
def bench_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip of every list with its id, disposition and ground truth."""
    root, media_table = clip_folder(spark, sf_dir)
    rows = scans.bench_samples(scans.clip_lists(spark, root, media_table), ("C1", "C2", "C3"), 60.0)
    return rows.select("sample_id", "disposition", F.array_join("gt", ",").alias("gt"))


@query(CLIPS + """, s AS (SELECT category, benchmark, n, here AND d <= 60 AS ok, NOT here AS gone, contains(benchmark, 'benign') OR NOT labelled AS benign, count(*) FILTER (here AND d <= 60) OVER (ORDER BY category, benchmark, n) AS c, row_number() OVER (ORDER BY category, benchmark, n) AS r FROM f),
k AS (SELECT * FROM s WHERE r <= coalesce((SELECT min(r) FROM s WHERE c = 100), 1000000000000))
SELECT count(*) FILTER (ok) AS included, count(*) FILTER (NOT gone AND NOT ok) AS excluded_over_duration, count(*) FILTER (gone) AS excluded_missing_video, count(*) FILTER (ok AND benign) AS num_benign, count(*) FILTER (ok AND NOT benign) AS num_harmful,
count(*) FILTER (ok AND category = 'C1') AS c1 FROM k""")
def first_bench_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan counts that stops at its hundredth sample (the limit is the feature)."""
    root, media_table = clip_folder(spark, sf_dir)
    rows = cut(scans.bench_samples(scans.clip_lists(spark, root, media_table), ("C1", "C2", "C3"), 60.0))
    made = scans.bench_summary(scans.until_full(rows, F.col("disposition") == "included", ("category", "benchmark", "at"), 100))
    return made.withColumn("c1", F.coalesce(F.try_element_at("by_category", F.lit("C1")), F.lit(0))).drop("by_category")


@query(CLIPS + " SELECT category, count(*) AS n, round(sum(d), 4) AS d FROM f WHERE NOT contains(benchmark, 'benign') AND labelled AND here AND d <= 30 GROUP BY category")
def clips_to_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, media_table = clip_folder(spark, sf_dir)
    rows = scans.candidates(scans.clip_lists(spark, root, media_table), ("C1", "C2", "C3"), 30.0)
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("d"))


#: Ids of events whose annotations are one document by category.
DOCUMENT = 30_000


@query("""SELECT 'c' || user_id % 3 AS category, count(*) AS n, count(*) FILTER (event_id % 5 = 0 OR event_id % 7 = 0) AS n_invalid, count(*) FILTER (event_id % 5 <> 0 AND event_id % 7 <> 0) AS n_usable FROM events GROUP BY ALL""")
def annotation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations by folder; derived folders are left out, rows without a video or with one turn are invalid."""
    root = scratch(spark, "annotations")
    turn = lambda who, v: F.struct(F.lit(who).alias("from"), v.alias("value"))
    i = F.col("event_id")
    two = F.array(turn("human", F.lit("?")), turn("gpt", i.cast("string")))
    item = F.struct(F.when(i % 5 != 0, F.format_string("dataset/full/%d.mp4", i)).alias("video"), F.when(i % 7 == 0, F.slice(two, 1, 1)).otherwise(two).alias("conversations"))
    # a document is one task's work, so there are more of them in a larger table, not larger ones
    lists = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("c"), F.floor(i / DOCUMENT).alias("d")).agg(F.collect_list(item).alias("items"))
    names = F.explode(F.array(F.format_string("d%d/c%d/full.json", "d", "c"), F.format_string("d%d/c%d_qa/full.json", "d", "c"), F.format_string("d%d/c%d_binary/full.json", "d", "c")))
    sinks.write_files(lists.select(names.alias("name"), F.to_json("items").alias("line"), F.lit(0).alias("o")), root, "name", "line", "o")
    rows = scans.annotations(spark, root)
    usable = F.col("disposition") == "usable"
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if(~usable).alias("n_invalid"), F.count_if(usable).alias("n_usable"))


@query("""WITH p AS (SELECT page_id % 40 AS f, count(*) AS n FROM pages GROUP BY ALL)
SELECT 'safe' AS what, 'v' || f AS folder, 1 AS n FROM p UNION ALL SELECT 'long', 'v' || f, 1 FROM p WHERE f >= 20 UNION ALL SELECT 'frames', 'v' || f, n FROM p UNION ALL SELECT 'model', 'run_iter' || f, f FROM p WHERE f % 3 = 0""")
def media_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe videos, those that are long enough, frames by folder, and folders that hold model exports (n: their iteration)."""
    root = scratch(spark, "media")
    f = F.col("page_id") % 40
    rows = read(spark, sf_dir, "pages").select("page_id", f.alias("f"))
    one = rows.select("f").distinct()
    name = lambda df, form, *c: df.select(F.format_string(form, *c).alias("name"), F.lit("x").alias("line"), F.lit(0).alias("o"))
    every = name(one, "v%d/content.mp4", "f").unionByName(name(rows, "v%d/frame_%05d.jpg", "f", "page_id")).unionByName(name(one, "run_iter%d/config.json", "f"))
    every = every.unionByName(name(one.where("f % 3 = 0"), "run_iter%d/model-00001.safetensors", "f"))
    sinks.write_files(every, root, "name", "line", "o")
    safe = scans.safe_videos(spark, root).withColumn("folder", scans.folder(F.col("path")))
    lengths = scans.safe_videos(spark, root).withColumn("duration", F.regexp_extract("path", r"/v(\d+)/", 1).cast("double"))
    long = scans.safe_videos(spark, root, lengths, 20.0).withColumn("folder", scans.folder(F.col("path")))
    row = lambda df, what, n: df.select(F.lit(what).alias("what"), "folder", n.cast("int").alias("n"))
    models = scans.model_folders(spark, root).withColumnRenamed("slug", "folder")
    return row(safe, "safe", F.lit(1)).union(row(long, "long", F.lit(1))).union(row(scans.frames(spark, root), "frames", F.size("paths"))).union(row(models, "model", F.col("iter")))


@query("SELECT DISTINCT d.source AS model, p.lang AS dataset, '/out/' || d.source || '/' || p.lang || '/record.jsonl' AS record FROM documents d, (SELECT DISTINCT lang FROM documents) p")
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of every source as a model with every language as a dataset, as one JSON document, read back."""
    docs = read(spark, sf_dir, "documents")
    runs = media.run_matrix(docs.select(F.col("source").alias("model")).distinct(), docs.select(F.col("lang").alias("dataset")).distinct())
    made = sinks.manifest(runs, "/out", base_url="http://localhost")
    back = spark.createDataFrame([(m["model_slug"], r["dataset"], r["record_output_jsonl"]) for m in made["models"] for r in m["runs"]], "model string, dataset string, record string")
    return back


@query(f"WITH {SEG} SELECT rec_id, count(*) FILTER (gt) AS n_gt, count(*) FILTER (NOT gt) AS n_pred, round(sum(s), 4) AS s FROM seg GROUP BY rec_id HAVING NOT bool_or(k = 99)")
def scanned_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of records read from one file per record."""
    rows = cut(eval_lines(spark, sf_dir))
    parsed = rows.select("rec_id", F.from_json("line", records.EVAL).alias("record")).where("record.ground_truth is not null")
    found = records.segments_of(parsed, "rec_id")
    same = matching.records(found.withColumn("b", labels.mask_of(F.col("labels"), labels.STANDARD)))
    return same.select("rec_id", F.size("gt").cast("long").alias("n_gt"), F.size("pred").cast("long").alias("n_pred"), F.round(F.aggregate(F.concat("gt", "pred"), F.lit(0.0), lambda a, x: a + x["s"]), 4).alias("s"))
