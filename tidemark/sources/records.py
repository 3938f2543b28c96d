"""Scans of JSON-lines records and of result folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = T.MapType(T.StringType(), T.StringType())
CHUNK = T.StructType(
    [T.StructField("start", T.StringType()), T.StructField("end", T.StringType()), T.StructField("description", T.StringType()),
     T.StructField("guardrail", LABELS), T.StructField("explanation", T.StringType())]
)
PAYLOAD = T.StructType(
    [T.StructField("parse_status", T.StringType()), T.StructField("parse_ok", T.BooleanType()), T.StructField("chunks", T.MapType(T.StringType(), CHUNK)),
     T.StructField("chunk_order", T.ArrayType(T.StringType())), T.StructField("parse_note", T.StringType())]
)
SIDE = T.StructType([T.StructField("supervised_span_text", T.StringType()), T.StructField("note", T.StringType()), T.StructField("intervals", PAYLOAD)])
EVAL = T.StructType(
    [T.StructField("iteration", T.IntegerType()), T.StructField("jsonl_record_index", T.StringType()), T.StructField("gt_jsonl", T.StringType()),
     T.StructField("ground_truth", SIDE), T.StructField("prediction", SIDE)]
)
ITER_FILE = r"(?i)/iter_(\d+)/records\.jsonl$"
OLD_FILES = (r"(?i)/iter_(\d+)/pred_(\d+)\.json$", r"(?i)/iter_(\d+)_pred_(\d+)\.json$")


def decoded(path) -> F:
    """A file's path as it is named; _metadata has it percent-encoded."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def lines(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None, blank: bool = False) -> DataFrame:
    """file, line (0-based, blank lines count), raw: the lines that are not blank, or with `blank` all.

    Lines are numbered within their blocks of a file; the sums of the blocks before come from the blocks' counts, so a
    large file is not gathered in one task.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    at = F.monotonically_increasing_id()
    rows = reader.text(path).select(decoded(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("_block"), at.alias("_at"), F.col("value").alias("raw"))
    blocks = rows.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # the ids of a block's lines follow one another: a task reads them in order
    numbered = rows.join(blocks, ["file", "_block"]).withColumn("line", (F.col("_before") + F.col("_at") - F.col("_first")).cast("int"))
    return (numbered if blank else numbered.where(F.trim("raw") != "")).select("file", "line", "raw")


def is_object(raw) -> F:
    return F.coalesce(F.expr("schema_of_variant(try_parse_json(raw))").startswith("OBJECT"), F.lit(False))


def jsonl(spark: SparkSession, path: str, mode: str = "permissive", schema: T.StructType = EVAL, objects: bool = True, strict_index: bool = False, **options) -> DataFrame:
    """file, line, is_valid, rec_idx, record of each line.

    permissive keeps lines that are no JSON objects as rows with is_valid false; failfast raises for them when run.
    objects=False takes any JSON value as valid; record is null where that is no object. rec_idx is the record's
    jsonl_record_index where that is a number, else the line; with strict_index one that is no number raises.
    """
    if mode not in ("permissive", "failfast"):
        raise ValueError(f"mode is permissive or failfast, not {mode}")
    rows = lines(spark, path, **options).withColumn("is_valid", is_object("raw") if objects else F.try_parse_json("raw").isNotNull())
    record = F.when(F.col("is_valid"), F.from_json("raw", schema))
    if mode == "failfast":
        record = record.otherwise(F.raise_error(F.concat(F.lit("no JSON object in "), "file", F.lit(" line "), F.col("line").cast("string"))))
    rows = rows.withColumn("record", record)
    index = F.col("line")
    if "jsonl_record_index" in schema.fieldNames():
        own = F.col("record.jsonl_record_index")
        index = F.coalesce(own.try_cast("int"), index)
        if strict_index:
            wrong = F.raise_error(F.concat(F.lit("a record index that is no number in "), "file", F.lit(" line "), F.col("line").cast("string")))
            index = F.when(own.isNotNull() & own.try_cast("int").isNull(), wrong.cast("int")).otherwise(index)
    return rows.select("file", "line", "is_valid", index.alias("rec_idx"), "record")


def scan_to(spark: SparkSession, path: str, out: str) -> dict[str, int]:
    """Writes the valid records below path (file, line, rec_idx, record) to out; returns the counts of lines, of those that are not blank, not
    valid, and no JSON at all, observed in the pass that writes."""
    from tidemark.sources.sinks import write_observed

    filled = F.trim("raw") != ""
    rows = lines(spark, path, blank=True).withColumns({"is_valid": is_object("raw"), "json": F.try_parse_json("raw").isNotNull()})
    found = rows.withColumn("record", F.when(F.col("is_valid"), F.from_json("raw", EVAL)))
    index = F.coalesce(F.col("record.jsonl_record_index").try_cast("int"), F.col("line"))
    kept = lambda df: df.where("is_valid").select("file", "line", index.alias("rec_idx"), "record")
    return write_observed(found, out, kept, n_lines=F.count(F.lit(1)), n=F.count_if(filled), n_bad=F.count_if(filled & ~F.col("is_valid")), n_bad_json=F.count_if(filled & ~F.col("json")))


def whole_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """file, is_valid, record of each file that holds one JSON document."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    rows = rows.select(decoded(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("raw")).withColumn("is_valid", is_object("raw"))
    return rows.select("file", "is_valid", F.when(F.col("is_valid"), F.from_json("raw", EVAL)).alias("record"))


def segments_of(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, gt, i (place in its side), s, e, labels (raw values): the intervals of both sides of records (keys, record)."""
    return rows.select(*keys, F.inline(segment_array()))


def segment_array() -> F:
    """Array of (gt, i, s, e, labels): the intervals of both sides of `record`.

    Chunks come in their listed order, then the others by name; those whose times are no numbers are left out.
    """
    from tidemark.functions.jsonx import ordered_chunks
    from tidemark.functions.texts import let

    def side(record, name: str, gt: bool):
        intervals = record[name]["intervals"]
        good = F.filter(ordered_chunks(intervals["chunks"], intervals["chunk_order"]), lambda x: x["start"].try_cast("double").isNotNull() & x["end"].try_cast("double").isNotNull())
        return F.transform(good, lambda x, i: F.struct(F.lit(gt).alias("gt"), i.cast("long").alias("i"), x["start"].cast("double").alias("s"), x["end"].cast("double").alias("e"), F.coalesce(x["guardrail"], F.create_map().cast("map<string,string>")).alias("labels")))

    none = F.array().cast("array<struct<gt:boolean,i:bigint,s:double,e:double,labels:map<string,string>>>")
    # a lambda's variable, so a record is parsed once, however often its parts are used
    return let(F.col("record"), lambda r: F.concat(F.coalesce(side(r, "ground_truth", True), none), F.coalesce(side(r, "prediction", False), none)))


def iteration_records(spark: SparkSession, root: str) -> DataFrame:
    """iter, rec_idx, is_valid, record, file, line: iter_N/records.jsonl, and the one-file-per-record layouts of iterations without it.

    A record index that is no number raises.
    """
    new = jsonl(spark, root, recursive=True, glob="records.jsonl", strict_index=True).withColumn("iter", F.regexp_extract("file", ITER_FILE, 1).try_cast("int")).where("iter is not null")
    a, b = OLD_FILES
    part = lambda g: F.coalesce(F.regexp_extract("file", a, g).try_cast("int"), F.regexp_extract("file", b, g).try_cast("int"))
    old = whole_files(spark, root).withColumns({"iter": part(1), "rec_idx": part(2)}).where("iter is not null").dropDuplicates(["file"])
    old = old.join(new.select("iter").distinct(), "iter", "left_anti")
    cols = ["iter", "rec_idx", "is_valid", "record", "file", "line"]
    return new.select(cols).unionByName(old.withColumn("line", F.lit(0)).select(cols))


def model_results(spark: SparkSession, root: str) -> DataFrame:
    """model, rec_idx, is_valid, record, file, line of every .jsonl file below root but records.jsonl; model is its path without suffix."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    rows = jsonl(spark, root, recursive=True, glob="*.jsonl").where(~F.col("file").endswith("/records.jsonl"))
    model = F.regexp_replace(F.expr("substring(file, instr(file, base) + length(base))"), r"\.[^./]+$", "")
    rows = rows.withColumn("base", F.lit(base + "/"))
    return rows.select(model.alias("model"), "rec_idx", "is_valid", "record", "file", "line")


def valid_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n, n_bad."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(~F.col("is_valid"), 1)).alias("n_bad"))
