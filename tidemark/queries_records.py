"""Queries over record shapes, answers, paths and plans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dialects, intervals, jsonx, labels, texts
from tidemark.operators import compare, curate, matching, sizes
from tidemark.plans import media, shapes
from tidemark.registry import query, read
from tidemark.sources.events import SQL as SEG
from tidemark.sources.events import segments

CODES = "array_to_string(list_transform(list_filter(range(6), lambda j: ({b} >> j) % 2 = 1), lambda j: 'C' || (j + 1)), ',')"


def shots(column: str):
    """Intervals (s, e, b) with texts."""
    return F.transform(column, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("seen").alias("description"), F.lit("why").alias("explanation"), x["b"].alias("b")))


@query(f"""WITH {SEG} SELECT rec_id::VARCHAR AS id, count(*) AS num_shots, count(*) FILTER (b <> 0) AS num_harmful, count(*) FILTER (b = 0) AS num_benign, round(max(e), 3) AS duration, bit_or(b) AS labels,
'user,assistant' AS roles, 'c' || rec_id % 4 AS category, round(min(s), 6) AS first_start FROM seg WHERE gt GROUP BY rec_id""")
def training_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole training records as JSON lines, read back."""
    rows = matching.records(segments(spark, sf_dir).where("gt")).withColumn("shots", shots("gt"))
    made = shapes.training_record(
        F.col("rec_id").cast("string"), "shots", F.concat(F.lit("/v/"), "rec_id"), F.concat(F.lit("v/"), "rec_id"), F.lit("List the shots."), F.col("shots"),
        F.array_max(F.transform("shots", lambda x: x["e"])), F.concat(F.lit("c"), (F.col("rec_id") % 4).cast("string")),
    )
    rows = rows.select(made.alias("r"))
    back = rows.select(F.from_json(F.to_json("r"), rows.schema["r"].dataType).alias("r"))
    told = jsonx.shots(F.get("r.conversations", 1)["value"])
    return back.select(
        "r.id", F.col("r.metadata.num_shots").cast("long").alias("num_shots"), F.col("r.metadata.num_harmful_shots").cast("long").alias("num_harmful"), F.col("r.metadata.num_benign_shots").cast("long").alias("num_benign"),
        F.col("r.metadata.duration_sec").alias("duration"), compare.label_union(told).alias("labels"), F.array_join(F.transform("r.messages", lambda m: m["role"]), ",").alias("roles"),
        F.col("r.metadata.source_category").alias("category"), F.array_min(F.transform(told, lambda x: x["s"])).alias("first_start"),
    )


@query("""WITH p AS (SELECT doc_id, lang, source, (n_chars % 900) / 10.0::DOUBLE AS safe, (n_chars % 290) / 10.0::DOUBLE AS harmful, CAST('0x' || substr(md5(doc_id || ':7'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM documents),
q AS (SELECT *, greatest(0.0, least(safe, 60 - harmful)) AS latest, least(60.0, safe + harmful) AS total FROM p),
r AS (SELECT *, CASE WHEN latest <= 1e-6 THEN 0.0 ELSE round(u * latest, 3) END AS start FROM q), z AS (SELECT *, least(total, start + harmful) AS stop FROM r)
SELECT doc_id, CAST(1 + CASE WHEN start > 1e-6 THEN 1 ELSE 0 END + CASE WHEN total - stop > 1e-6 THEN 1 ELSE 0 END AS BIGINT) AS num_shots, CAST(1 AS BIGINT) AS num_harmful, round(start, 3) AS insert_start, round(stop, 3) AS insert_end,
round(total, 3) AS duration, 'inserted_real_' || lang || '_' || source AS category FROM z WHERE stop - start > 1e-6""")
def inserted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of clips inserted into safe ones; text lengths stand for durations."""
    chars = F.col("n_chars")
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", ((chars % 900).cast("double") / 10).alias("safe"), ((chars % 290).cast("double") / 10).alias("harmful"), F.lit(5).alias("b"))
    rows = media.insertion_plan(rows, "doc_id").where("intervals is not null").withColumn("shots", shots("intervals"))
    made = shapes.inserted_record(
        F.col("doc_id").cast("string"), "shots", F.lit("/v/new.mp4"), F.lit("v/new.mp4"), F.lit("List the shots."), F.col("shots"), F.col("total"), F.lit("/v/safe.mp4"), F.lit("/v/harm.mp4"), F.lit("real"), F.col("lang"), F.col("source")
    )
    m = rows.select("doc_id", made["metadata"].alias("m"))
    return m.select("doc_id", F.col("m.num_shots").cast("long").alias("num_shots"), F.col("m.num_harmful_shots").cast("long").alias("num_harmful"), F.col("m.insert_start_sec").alias("insert_start"),
                    F.col("m.insert_end_sec").alias("insert_end"), F.col("m.duration_sec").alias("duration"), F.col("m.source_category").alias("category"))


@query("""SELECT doc_id, n_chars % 5 AS n_images, rtrim(repeat('<image> ', CAST(n_chars % 5 AS INT))) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || 'Look' END AS human, 'reply' AS reply,
CAST(n_chars % 5 AS VARCHAR) AS num_frames, source, 'v/' || doc_id AS source_video, rtrim(substr('d' || doc_id, 1, 40), '_') || '_' || substr(sha1('d' || doc_id), 1, 12) AS frame_dir FROM documents""")
def image_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records on frames instead of videos; the old metadata's count of frames is overwritten."""
    d = read(spark, sf_dir, "documents")
    turn = lambda who, v: F.struct(F.lit(who).alias("from"), F.lit(v).alias("value"))
    old = F.create_map(F.lit("source"), F.col("source"), F.lit("num_frames"), F.lit("?"))
    record = F.struct(F.concat(F.lit("d"), "doc_id").alias("id"), F.concat(F.lit("v/"), "doc_id").alias("video"), F.array(turn("human", "<video>\nLook"), turn("gpt", "reply")).alias("conversations"), old.alias("metadata"))
    images = F.transform(F.slice(F.sequence(F.lit(1), F.lit(5)), 1, (F.col("n_chars") % 5).cast("int")), lambda i: F.format_string("frame_%04d.jpg", i))
    rows = d.select("doc_id", "n_chars", record.alias("r"), images.alias("i"))
    made = rows.select("doc_id", shapes.image_record(F.col("r"), F.when(F.col("doc_id") % 3 != 0, "Look"), F.col("i"), texts.frame_directory(F.col("r.id"))).alias("x"))
    m = F.col("x.metadata")
    return made.select("doc_id", F.size("x.images").cast("long").alias("n_images"), F.get("x.conversations", 0)["value"].alias("human"), F.get("x.conversations", 1)["value"].alias("reply"), m["num_frames"].alias("num_frames"), m["source"].alias("source"),
                       m["source_video"].alias("source_video"), m["frame_dir"].alias("frame_dir"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, gt, raw: predicted intervals as answers, every fifth one without a list."""
    rows = matching.records(segments(spark, sf_dir))
    body = shapes.answer(shots("pred"))
    raw = F.when(F.col("rec_id") % 5 == 4, "I can't tell.").when(F.col("rec_id") % 5 == 3, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise(body)
    return rows.select("rec_id", shots("gt").alias("gt"), raw.alias("raw"))


@query(f"""WITH {SEG}, r AS (SELECT rec_id, rec_id % 5 <> 4 AS ok, count(*) FILTER (gt) AS g, count(*) FILTER (NOT gt) AS p, coalesce(bit_or(b) FILTER (gt), 0) AS gb, coalesce(bit_or(b) FILTER (NOT gt), 0) AS pb FROM seg GROUP BY rec_id)
SELECT rec_id, ok AS parse_ok, CASE WHEN ok THEN NULL ELSE 'no JSON list of intervals' END AS note, CASE WHEN ok THEN p ELSE 0 END AS n_pred, g AS n_gt, rec_id % 7 = 0 AS used_retry, CASE WHEN ok THEN p ELSE 0 END AS n_wire,
{CODES.format(b="gb")} AS gt_codes, CASE WHEN ok THEN {CODES.format(b="pb")} ELSE '' END AS pred_codes, ends_with(CASE WHEN rec_id % 7 = 0 THEN 'larger budget.' ELSE 'left out.' END, 'budget.') AS says_retry FROM r""")
def answer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-output, evaluation and prediction records of answers."""
    parsed = answers(spark, sf_dir).withColumn("pred", jsonx.parse_answer(F.col("raw")))
    retried = F.col("rec_id") % 7 == 0
    payload, gt_payload = jsonx.to_payload(F.col("pred")), jsonx.to_payload(F.col("gt"))
    record = F.struct(F.col("rec_id").cast("string").alias("id"), F.concat(F.lit("v/"), "rec_id").alias("video"))
    some = F.coalesce("pred", F.array().cast("array<struct<s:double,e:double,description:string,explanation:string,b:int>>"))
    rows = parsed.select(
        "rec_id",
        shapes.raw_output_record(F.col("rec_id"), F.lit("in.jsonl"), record, F.lit("List."), F.col("raw"), payload, F.col("pred"), payload["parse_note"], retried).alias("o"),
        shapes.baseline_record(F.col("rec_id"), F.lit("in.jsonl"), record, F.col("raw"), payload, shapes.answer(F.col("gt")), gt_payload, retried).alias("b"),
        shapes.prediction_record(record, F.lit("v"), F.lit("f"), F.lit(1), F.col("raw"), payload["parse_note"], F.col("gt"), some).alias("p"),
    )
    size = lambda c: F.size(c).cast("long")
    return rows.select(
        "rec_id", F.col("b.prediction.intervals.parse_ok").alias("parse_ok"), F.col("o.parse_error").alias("note"), size("b.prediction.intervals.chunk_order").alias("n_pred"), size("b.ground_truth.intervals.chunks").alias("n_gt"),
        "o.used_retry", size("o.prediction_intervals").alias("n_wire"), F.array_join("p.gt_categories", ",").alias("gt_codes"), F.array_join("p.pred_categories", ",").alias("pred_codes"), F.col("b.prediction.note").endswith("budget.").alias("says_retry"),
    )


@query(f"WITH {SEG}, r AS (SELECT DISTINCT rec_id FROM seg) SELECT count(*) AS n, count(*) FILTER (rec_id % 5 = 4 AND rec_id % 2 = 0) AS n_parse_errors, count(*) FILTER (rec_id % 5 = 4 AND rec_id % 2 = 1) AS n_retried FROM r")
def retried_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without a list are asked for again; odd records then answer."""
    first = answers(spark, sf_dir).select("rec_id", jsonx.parse_answer(F.col("raw")).isNotNull().alias("parse_ok"))
    again = media.retry(first, first.where("not parse_ok and rec_id % 2 = 1").withColumn("parse_ok", F.lit(True)), "rec_id")
    return media.answer_counts(again)


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE regexp_replace(coalesce(text || chr(10), '') || role, '^\\s+', '') END AS said FROM conversations""")
def message_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat completions whose content is a text or a list of parts."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    reply = lambda content: F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    many = F.array(part("text", F.col("text")), part("image", F.lit("no")), part("output_text", F.lit("")), part("output_text", F.col("role")))
    rows = read(spark, sf_dir, "conversations").withColumn("p", F.when(F.col("turn") % 2 == 0, reply(F.coalesce("text", F.lit("")))).otherwise(reply(many)))
    return rows.select("conv_id", "turn", jsonx.message_content(F.col("p")).alias("said"))


@query("SELECT page_id, CASE WHEN page_id % 3 < 2 THEN url END AS video FROM pages")
def video_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The video of a record stands in it, in its first message, or nowhere."""
    parts = lambda v: F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("video")), F.struct(F.lit("video").alias("type"), v.alias("video")))
    messages = F.array(F.struct(F.lit("user").alias("role"), parts(F.when(F.col("page_id") % 3 == 1, F.col("url"))).alias("content")))
    record = F.to_json(F.struct(F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise("  ").alias("video"), messages.alias("messages")))
    return read(spark, sf_dir, "pages").select("page_id", jsonx.video_path(record).alias("video"))


@query(f"WITH {SEG} SELECT i, CASE WHEN i % 5 = 4 THEN NULL ELSE k END AS k FROM seg")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in answers: fenced, in words, as Python literals, after another brace, or none."""
    k, n = F.col("k").cast("string"), F.col("i") % 5
    text = F.when(n == 0, F.concat(F.lit("So:\n```json\n{\"k\": "), k, F.lit("}\n``` as said"))).when(n == 1, F.concat(F.lit("It is {'k': "), k, F.lit(", 'ok': True, 'x': None}"))).when(n == 2, F.concat(F.lit("{ no {\"k\": "), k, F.lit("} end")))
    text = text.when(n == 3, F.concat(F.lit("{\"k\": "), k, F.lit("}"))).otherwise(F.lit("none {here"))
    rows = segments(spark, sf_dir).select("i", jsonx.recover_json_object(text).alias("o"))
    return rows.select("i", F.get_json_object("o", "$.k").cast("int").alias("k"))


@query(f"WITH {SEG} SELECT i, CASE WHEN i % 5 < 4 THEN 1 END AS n_strict, CASE WHEN i % 5 < 2 THEN 1 END AS n_plain FROM seg")
def strict_and_plain_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as they are, in backticks, after words, behind a language name, or broken; the plain form takes the first two."""
    n, body = F.col("i") % 5, F.concat(F.lit('[{"START_SEC": '), F.col("k").cast("string"), F.lit("}]"))
    text = F.when(n == 0, body).when(n == 1, F.concat(F.lit("```"), body, F.lit("```"))).when(n == 2, F.concat(F.lit("Well: "), body)).when(n == 3, F.concat(F.lit("```json\n"), body, F.lit("```"))).otherwise(F.lit("[1, 2"))
    rows = segments(spark, sf_dir).select("i", jsonx.raw_objects(jsonx.recover_json_list(text)).alias("s"), jsonx.plain_json_list(text).alias("p"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return rows.select("i", size("s").alias("n_strict"), size("p").alias("n_plain"))


@query(f"""WITH {SEG}, p AS (SELECT i, 'c' || user_id % 4 AS c, 'v' || user_id AS v, CAST(floor(s) AS BIGINT) AS a, CAST(floor(e) AS BIGINT) AS b FROM seg)
SELECT i, CASE WHEN b > a THEN CAST(a AS DOUBLE) END AS s, CASE WHEN b > a THEN CAST(b AS DOUBLE) END AS e, 'dataset/full/' || c || '/target/' || v || '.mp4' AS whole, c || '__' || a || '_' || b AS sample, '/data/clip/' || c || '/' || v || '/' || a || '_' || b || '.mp4' AS at FROM p""")
def clip_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time range, whole recording, id and place of clips, from their paths."""
    path = F.format_string("dataset/clip/c%d/v%d/%d_%d.mp4", F.col("user_id") % 4, F.col("user_id"), F.floor("s"), F.floor("e"))
    rows = segments(spark, sf_dir).select("i", path.alias("p")).withColumn("r", texts.clip_range(F.col("p")))
    return rows.select("i", "r.s", "r.e", texts.full_path(F.col("p")).alias("whole"), texts.path_sample_id(F.col("p")).alias("sample"), texts.absolute_path("/data", F.col("p")).alias("at"))


def three_parts(described, explained):
    """An answer in three parts with all labels; Python's booleans."""
    flags = [F.concat(F.lit(f'"{n}": '), F.when(labels.has(F.col("b"), j), "True").otherwise("False")) for j, n in enumerate(labels.STANDARD)]
    return F.concat(F.lit("DESCRIPTION: "), described, F.lit("\nGUARDRAIL: {"), F.concat_ws(", ", *flags), F.lit("}\nEXPLANATION: "), explained)


@query(f"""WITH {SEG} SELECT i, true AS standard, k % 5 <> 0 AND k % 7 <> 0 AS details, (k % 5 <> 0 AND k % 7 <> 0) OR b = 0 AS kept, CASE WHEN (k % 5 <> 0 AND k % 7 <> 0) OR b = 0 THEN CASE WHEN k % 5 = 0 THEN 'None' ELSE 'seen True' END END AS description,
b AS whole_bits FROM seg""")
def clip_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-part answers without texts count as None if they are harmless and go otherwise."""
    text = three_parts(F.when(F.col("k") % 5 == 0, "").otherwise("seen True"), F.when(F.col("k") % 7 == 0, "").otherwise("why"))
    rows = segments(spark, sf_dir).select("i", text.alias("t")).select("i", "t", jsonx.three_part_answer(F.col("t")).alias("p")).withColumn("c", jsonx.clip_answer(F.col("p")))
    return rows.select("i", labels.is_standard(F.col("p.labels")).alias("standard"), jsonx.has_details(F.col("p")).alias("details"), F.col("c").isNotNull().alias("kept"), "c.description", jsonx.full_categories(F.col("t")).alias("whole_bits"))


@query(f"WITH {SEG} SELECT rec_id, CASE WHEN rec_id % 5 <> 4 THEN coalesce(bit_or(b) FILTER (NOT gt), 0) END AS found FROM seg GROUP BY rec_id")
def bench_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label bits of all intervals in an answer, null without a list."""
    return answers(spark, sf_dir).select("rec_id", jsonx.interval_categories(F.col("raw")).alias("found"))


@query(f"""WITH {SEG} SELECT i, CASE WHEN i % 3 = 0 THEN b ELSE 0 END AS exact, b AS prefixed, bit_count(b)::INT AS n_true, 7 AS n_keys, CASE WHEN i % 3 = 0 THEN 'C1(Sexual Content)' ELSE 'C1(x)' END AS first_key FROM seg""")
def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by exact key, by prefix and as vectors over the union of keys."""
    key = lambda j: F.when(F.col("i") % 3 == 0, labels.STANDARD[j]).otherwise(f"C{j + 1}(x)")
    flags = F.map_from_arrays(F.array(*[key(j) for j in range(6)]), F.array(*[F.when(labels.has(F.col("b"), j), "true").otherwise("false") for j in range(6)]))
    rows = segments(spark, sf_dir).select("i", flags.alias("m")).withColumn("keys", labels.key_union(F.array("m", F.create_map(F.lit("other"), F.lit("true")))))
    vector = labels.vectorize(F.col("m"), F.col("keys"))
    return rows.select("i", labels.exact_bits(F.col("m")).alias("exact"), labels.prefix_bits(F.col("m")).alias("prefixed"), F.size(F.filter(vector, lambda x: x)).alias("n_true"), F.size("keys").alias("n_keys"), F.get("keys", 0).alias("first_key"))


@query("""WITH e AS (SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events)
SELECT event_id, CASE WHEN k > 0 THEN 1.0 / (k / 4.0::DOUBLE) END AS step, CASE WHEN k > 0 THEN round(128 / (k / 4.0::DOUBLE), 6) END AS longest, CASE WHEN k = 0 THEN 30 ELSE greatest(1, least(60, CAST(round_even(k / 4.0::DOUBLE, 0) AS INT))) END AS fps,
(CASE WHEN k <= 5 THEN 9 ELSE k - 5 END) // 2 * 2 AS even FROM e""")
def rates_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time steps, frame budgets, output rates and even dimensions from a number of each event."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = read(spark, sf_dir, "events").select("event_id", k.alias("k"), (k / F.lit(4.0)).alias("fps"))
    some = F.when(F.col("k") > 0, F.col("fps"))
    return rows.select(
        "event_id", F.when(F.col("k") > 0, intervals.time_step(F.when(F.col("k") > 0, F.col("fps")).otherwise(1.0))).alias("step"), intervals.duration_for_frames(some, F.lit(128)).alias("longest"),
        intervals.output_fps(F.col("fps")).alias("fps"), intervals.even_dimension(F.col("k") - 5, F.lit(9)).alias("even"),
    )


@query(f"""WITH {SEG}, c AS (SELECT i, least(greatest(s, 0), 168.0) AS s, least(greatest(e, 0), 168.0) AS e FROM seg), g AS (SELECT i, s, e, least(168.0, round(round_even(s / 0.75::DOUBLE, 0) * 0.75, 6)) AS a, least(168.0, round(round_even(e / 0.75::DOUBLE, 0) * 0.75, 6)) AS b FROM c)
SELECT i, a AS s, CASE WHEN e > s AND b <= a THEN least(168.0, round(a + 0.75, 6)) ELSE b END AS e FROM g""")
def snapped_to_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = intervals.snap_interval(F.col("s"), F.col("e"), F.lit(168.0), 0.75)
    return segments(spark, sf_dir).select("i", s.alias("s"), e.alias("e"))


@query("""WITH d AS (SELECT doc_id, 5 + n_chars % 50 AS d, n_chars % 4 AS n FROM documents), g AS (SELECT doc_id, n, u.i, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || ':' || u.i), u.i) AS r FROM d, LATERAL (SELECT unnest(range(2 * d + 1)) AS i) u),
t AS (SELECT doc_id, i / 2.0::DOUBLE AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS clip FROM g WHERE r <= n)
SELECT doc_id, clip, pos, pos + 1.5 * clip AS start FROM t""")
def grid_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions drawn from a time grid without repeats, zipped with clips, and where they lie once earlier ones pushed them."""
    rows = read(spark, sf_dir, "documents").select("doc_id", intervals.grid_positions((5 + F.col("n_chars") % 50).cast("double"), (F.col("n_chars") % 4).cast("int"), 0.5, F.col("doc_id").cast("string")).alias("p"))
    zipped = curate.zip_positions(F.col("p"), F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))
    each = rows.select("doc_id", F.inline(zipped)).withColumn("length", F.lit(1.5))
    return curate.shifted(each, "doc_id").select("doc_id", "clip", F.col("at").alias("pos"), "start")


@query("""WITH g AS (SELECT page_id, row_number() OVER (ORDER BY md5(page_id || ':7'), page_id) AS rn, count(*) OVER () AS m FROM pages WHERE length(html) > 2000)
SELECT doc_id, page_id AS pick FROM documents JOIN g ON rn = CAST('0x' || substr(md5(doc_id || ':7'), 1, 8) AS BIGINT) % m + 1""")
def picked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded choice among the pages that can be used (here: of over 2,000 characters)."""
    return curate.pick(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "pages").select("page_id", "html"), "doc_id", "page_id", F.length("html") > 2000)


@query(f"""WITH {SEG}, a AS (SELECT rec_id % 10 AS id, i, k, row_number() OVER (PARTITION BY rec_id % 10 ORDER BY i) AS n FROM seg) SELECT id, min(n) AS n, arg_min(i, n) AS i FROM a WHERE n <= 50 AND k % 2 = 0 GROUP BY id""")
def accepted_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of at most 50 attempts that is accepted (k even)."""
    rows = segments(spark, sf_dir).select((F.col("rec_id") % 10).alias("id"), "i", "k")
    tried = sizes.running(sizes.dealt(rows, ["id"], "i"), ["id"], "i", n=(F.sum, F.lit(1), True)).withColumn("n", F.col("n").cast("long"))
    return curate.first_accepted(tried, "id", "n", F.col("k") % 2 == 0).select("id", "n", "i")


@query("SELECT 'lang' AS what, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def frequency_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.frequencies(read(spark, sf_dir, "documents"), "lang", "source")


@query(f"""WITH {SEG}, r AS (SELECT rec_id, max(e) AS d, count(*) AS n, bit_or(b) AS b FROM seg WHERE NOT gt GROUP BY rec_id)
SELECT CASE WHEN rec_id % 4 = 0 THEN 'wrong_folder' WHEN NOT (d > 0 AND d <= 120) THEN 'wrong_duration' WHEN rec_id % 5 = 4 THEN 'no_shots' WHEN b = 0 THEN 'no_harm' ELSE 'included' END AS disposition, count(*) AS n FROM r GROUP BY ALL""")
def source_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why predicted recordings can't give clips to insert, by the first rule that holds."""
    rows = matching.records(segments(spark, sf_dir).where("not gt")).withColumns({"shots": shots("pred"), "d": F.array_max(F.transform("pred", lambda x: x["e"]))})
    video = F.concat(F.lit("/d/real/c/"), F.when(F.col("rec_id") % 4 == 0, "x").otherwise("x_benchmark"), F.lit("/v.mp4"))
    given = jsonx.shots(F.when(F.col("rec_id") % 5 != 4, shapes.answer(F.col("shots"))))
    why = F.coalesce(curate.harmful_source(video, F.col("d"), given, 120.0), F.lit("included"))
    return rows.groupBy(why.alias("disposition")).agg(F.count("*").alias("n"))


@query(f"""WITH {SEG}, a AS (SELECT i, 'dataset/full/c' || user_id % 4 || '/target/v' || user_id || '.mp4' AS parent, 'c' || user_id % 4 AS category, k % 3 <> 0 AS clip, k % 10 <> 9 AS ok, k % 5 <> 0 OR b = 0 AS fine, CAST(floor(s) AS BIGINT) AS st FROM seg)
SELECT parent, arg_min(category, i) AS category, arg_min('seen ' || i, i) FILTER (NOT clip AND ok AND fine) AS whole, count(DISTINCT st) FILTER (clip AND ok AND fine) AS n_clips, bool_or(clip AND NOT (ok AND fine)) AS incomplete,
count(*) FILTER (NOT clip AND ok) AS full_seen, count(*) FILTER (clip AND ok AND fine) AS clips_seen, count(*) FILTER (NOT ok) AS unparseable FROM a GROUP BY parent""")
def whole_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of clips and of whole recordings, grouped by recording: the first good answer of each, and what was skipped."""
    clip = F.col("k") % 3 != 0
    user = F.col("user_id")
    path = F.when(clip, F.format_string("dataset/clip/c%d/v%d/%d_999.mp4", user % 4, user, F.floor("s"))).otherwise(F.format_string("dataset/full/c%d/target/v%d.mp4", user % 4, user))
    answer = F.when(F.col("k") % 10 != 9, three_parts(F.concat(F.lit("seen "), F.col("i").cast("string")), F.when(F.col("k") % 5 == 0, "").otherwise("why"))).otherwise("nothing")
    rows = segments(spark, sf_dir).select(F.col("i").alias("ord"), F.concat(F.lit("c"), (user % 4).cast("string")).alias("category"), path.alias("video"), answer.alias("answer"))
    made = curate.parent_groups(rows)
    return made.select("parent", "category", F.col("full.description").alias("whole"), F.coalesce(F.size("clips"), F.lit(0)).cast("long").alias("n_clips"), "incomplete", F.col("full_records_seen").alias("full_seen"),
                       F.col("clip_records_seen").alias("clips_seen"), F.col("skipped_unparseable_response").alias("unparseable"))


@query("""WITH p AS (SELECT page_id, '/media/a b/' || regexp_replace(url, '^.*://', '') || 'é ~x.MP4' AS p, url FROM pages), q AS (SELECT page_id, url, p, replace(url_encode(p), '%2F', '/') AS q FROM p)
SELECT page_id, printf('%.1f%%', page_id / 8.0 * 100) AS share, CASE WHEN trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'plot' ELSE trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') END AS slug, 'file://' || q AS file, 'http://h:80/' || substr(q, 8) AS http,
printf('%.2fs - %.2fs | a, b', page_id / 4.0, page_id / 2.0) AS title FROM q""")
def titles_and_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/media/a b/"), F.regexp_replace("url", "^.*://", ""), F.lit("é ~x.MP4"))
    n = F.col("page_id")
    return read(spark, sf_dir, "pages").select(
        "page_id", texts.percent(n / 8).alias("share"), texts.slug(F.col("url")).alias("slug"), texts.file_url(path).alias("file"), texts.http_url(path, "/media", "h", 80).alias("http"),
        texts.interval_title(n / 4, n / 2, F.array(F.lit("a"), F.lit("b"))).alias("title"),
    )


@query("SELECT page_id, 'data:image/' || CASE WHEN page_id % 2 = 0 THEN 'jpeg' ELSE 'png' END || ';base64,' || base64(encode(url)) AS url FROM pages")
def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("page_id") % 2 == 0, "frame.JPG").otherwise("frame.png")
    return read(spark, sf_dir, "pages").select("page_id", texts.data_url(F.encode("url", "utf-8"), name).alias("url"))


@query(f"WITH {SEG} SELECT model_id, '/media/m' || model_id AS root FROM seg GROUP BY model_id")
def common_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder that all media of a model share."""
    path = F.format_string("/media/m%d/u%d/%d.mp4", "model_id", "user_id", "i")
    return segments(spark, sf_dir).select("model_id", path.alias("p")).groupBy("model_id").agg(texts.common_root(F.col("p")).alias("root"))


@query("""WITH l AS (SELECT DISTINCT lang FROM documents), n AS (SELECT count(*) AS n FROM l) SELECT 'num_samples' AS what, 3 + 4 * n + 2 AS n FROM n UNION ALL SELECT 'insert_0', 3 UNION ALL SELECT 'insert_1', 4 * n FROM n UNION ALL SELECT 'insert_2', 2
UNION ALL SELECT lang || '_segments', 4 + CASE WHEN lang IN ('en', 'de') THEN 2 ELSE 0 END FROM l""")
def insertion_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule over the languages as groups, summarized, and held against itself for balance."""
    groups = read(spark, sf_dir, "documents").select(F.col("lang").alias("name")).distinct()
    slots = curate.schedule(groups, 3, 4, 2, [("en", "de")])
    made = curate.schedule_summary(slots)
    same = curate.assert_balanced(made, made, "what").select("what")
    return made.join(same, "what").select("what", "n")


COMPARED = f"""WITH {SEG}, k AS (SELECT user_id // 3 * 10 + iter AS key, model_id, gt, b FROM seg),
n AS (SELECT key, count(*) FILTER (NOT gt AND model_id = 0 AND b <> 0) AS n_left, count(*) FILTER (NOT gt AND model_id = 1 AND b <> 0) AS n_right, count(*) FILTER (gt AND model_id = 0 AND b <> 0) AS n_own,
  count(*) FILTER (gt AND model_id = 2 AND b <> 0) AS n_outer, count(*) FILTER (model_id = 0) AS has0, count(*) FILTER (model_id = 1) AS has1, count(*) FILTER (gt AND model_id = 2) AS has2 FROM k GROUP BY key),
x AS (SELECT key, n_left, n_right, CASE WHEN n_outer > 0 THEN n_outer ELSE n_own END AS n_gt, CASE WHEN has2 > 0 AND CASE WHEN n_outer > 0 THEN n_outer ELSE n_own END > 0 THEN 'external' ELSE 'embedded' END AS source, key % 11 = 0 AS marked FROM n WHERE has0 > 0 AND has1 > 0)"""


@query(COMPARED + " SELECT * FROM x")
def comparison_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' results by key, with ground truth from a third set, met by its first key that is known, else their own."""
    rows = segments(spark, sf_dir).withColumn("key", F.floor(F.col("user_id") / 3).cast("long") * 10 + F.col("iter"))
    part = lambda c, n: F.collect_list(F.when(c & (F.col("b") != 0), F.struct("s", "e", "b"))).alias(n)
    of = lambda m, *parts: rows.where(F.col("model_id") == m).groupBy("key").agg(*parts)
    pairs = of(0, part(~F.col("gt"), "left"), part(F.col("gt"), "own")).join(of(1, part(~F.col("gt"), "right")), "key")
    outer = rows.where("gt and model_id = 2").groupBy("key").agg(part(F.lit(True), "outer"))
    path = lambda c: F.concat(F.lit("data/full/"), c.cast("string"), F.lit(".mp4"))
    index = outer.select(F.col("key").alias("id"), texts.path_variants(path(F.col("key"))).alias("keys"), F.col("key").alias("ordinal"))
    probes = pairs.select(F.col("key").alias("id"), texts.path_variants(F.concat(F.lit("/mnt/"), path(F.col("key")))).alias("keys"))
    hits = compare.prioritized_lookup(probes, index).select(F.col("id").alias("key"), "match")
    met = pairs.join(hits, "key", "left").join(outer.withColumnRenamed("key", "match"), "match", "left")
    chosen, source = compare.ground_truth_choice(F.col("outer"), F.col("own"))
    marked = texts.has_marker(("special",), F.when(F.col("key") % 11 == 0, "a Special-case").otherwise("specials"))
    size = lambda c: F.size(c).cast("long")
    return met.select("key", size("left").alias("n_left"), size("right").alias("n_right"), size(chosen).alias("n_gt"), source.alias("source"), marked.alias("marked"))


@query(COMPARED + ", y AS (SELECT key, greatest(n_left, n_right, n_gt) AS most FROM x WHERE NOT marked) SELECT key, most FROM y ORDER BY most DESC, key LIMIT 20")
def most_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's top 20: most intervals first, marked ones hidden."""
    rows = comparison_bundle(spark, sf_dir).where("not marked")
    return compare.rank_items(rows).limit(20).select("key", F.greatest("n_left", "n_right", "n_gt").alias("most"))


@query("""WITH p AS (SELECT page_id AS i, 'data/full/g' || page_id % 7 || '/h/' || page_id || '.mp4' AS video FROM pages),
k AS (SELECT *, CASE WHEN i % 3 = 0 THEN 'id-' || i WHEN i % 3 = 1 THEN 'dataset/c' || i % 5 || '/v' || i || '.mp4' WHEN i % 5 <> 4 THEN video ELSE 'record_' || i END AS key FROM p)
SELECT i AS page_id, key, CASE WHEN i % 5 <> 4 THEN 'g' || i % 7 || ' / h' ELSE key END AS parent, CASE WHEN i % 4 > 0 THEN 'cat' || i % 4 ELSE '' END AS category FROM k""")
def record_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, parent group and source category of records that name themselves in different ways, one for each page."""
    i = F.col("page_id")
    text = lambda form, *c: F.format_string(form, *c)
    record = F.struct(
        F.when(i % 3 == 0, text("id-%d", i)).alias("id"), F.when(i % 5 != 4, text("data/full/g%d/h/%d.mp4", i % 7, i)).otherwise(" ").alias("video"), i.alias("jsonl_record_index"),
        F.struct(F.when(i % 4 > 0, text("cat%d", i % 4)).otherwise(" ").alias("source_category"), F.when(i % 3 == 1, text("dataset\\c%d\\v%d.mp4", i % 5, i)).alias("video_relative_path")).alias("metadata"),
        F.struct(F.lit(5).alias("id")).alias("gt_record"),
    )
    rows = read(spark, sf_dir, "pages").select("page_id", F.try_parse_json(F.to_json(record)).alias("v"))
    rows = rows.select("page_id", dialects.primary_key(F.col("v")).alias("key"), dialects.video_of(F.col("v")).alias("video"), dialects.source_category(F.col("v")).alias("category"))
    return rows.select("page_id", "key", texts.parent_group(F.col("video"), F.col("key"), ("data", "full", "videos", "target", "dataset")).alias("parent"), "category")
