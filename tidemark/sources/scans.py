"""Scans of folders: JSON documents, annotations, clip lists, media files, model exports.

A document is read whole by one task and spread over rows by its elements; what is scanned at scale is many documents.
Durations come from a media table (path, duration), which also says which files exist.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoints import written
from tidemark.sources import sinks
from tidemark.sources.records import decoded

#: Names in a batch of a listing.
LISTED = 10_000

ANNOTATION = "array<struct<video:string,conversations:array<struct<`from`:string,value:string>>>>"
CLIP = "array<struct<video_path:string,labels:array<string>,subcategories:array<string>,video_content:string,violate_reason:string>>"


def folder(file: Column, up: int = 1) -> Column:
    """The name of the file's folder, or of one further up."""
    return F.try_element_at(F.split(file, "/"), F.lit(-1 - up))


def documents(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """file, is_valid, value of each JSON document below path, read by the schema; value is null where it doesn't parse."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    rows = rows.select(decoded(F.col("_metadata.file_path")).alias("file"), "value")
    return rows.select("file", F.try_parse_json("value").isNotNull().alias("is_valid"), F.from_json("value", schema).alias("value"))


def elements(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """file, at (0-based), item of each element of the lists in the documents below path."""
    return documents(spark, path, schema, glob).select("file", F.posexplode("value").alias("at", "item"))


def annotations(spark: SparkSession, root: str) -> DataFrame:
    """category (folder), at, video, answer, n_turns of root/*/full.json, but folders of derived kinds.

    disposition says why a row is unusable: skipped_invalid_record without a video or with fewer than two turns.
    """
    from tidemark.functions.texts import is_canonical

    rows = elements(spark, root, ANNOTATION, "full.json").withColumn("category", folder(F.col("file"))).where(is_canonical(F.col("category")))
    turns = F.coalesce(F.size("item.conversations"), F.lit(0))
    bad = (F.coalesce(F.col("item.video"), F.lit("")) == "") | (turns < 2)
    return rows.select(
        "category", "at", F.col("item.video").alias("video"), F.get("item.conversations", 1)["value"].alias("answer"), turns.alias("n_turns"),
        F.when(bad, "skipped_invalid_record").otherwise("usable").alias("disposition"),
    )


def clip_lists(spark: SparkSession, root: str, media: DataFrame) -> DataFrame:
    """category, benchmark, at, path, labels, subcategories, duration (null: no such file) of root/real/<category>/*.json."""
    rows = elements(spark, f"{root.rstrip('/')}/real", CLIP)
    named = rows.select(
        folder(F.col("file")).alias("category"), F.regexp_replace(folder(F.col("file"), 0), r"\.json\z", "").alias("benchmark"), "at",
        F.concat(F.lit(root.rstrip("/") + "/"), "item.video_path").alias("path"), "item.labels", "item.subcategories",
    )
    return named.join(media.select("path", "duration"), "path", "left")


def candidates(clips: DataFrame, categories: Sequence[str], longest: float | None = None) -> DataFrame:
    """Clips that can be inserted: labelled, not of a benign list, existing, not too long. Raises when run if a category has none."""
    rows = clips.where(F.col("category").isin(*categories) & ~F.col("benchmark").contains("benign") & (F.coalesce(F.size("labels"), F.lit(0)) > 0) & F.col("duration").isNotNull())
    rows = rows if longest is None else rows.where(F.col("duration") <= longest)
    wanted = clips.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    empty = wanted.join(rows.select("category").distinct(), "category", "left_anti")
    stop = empty.select(F.raise_error(F.concat(F.lit("no clips to insert for "), "category")).cast("string").alias("category"))
    return rows.unionByName(stop, allowMissingColumns=True)


def bench_samples(clips: DataFrame, categories: Sequence[str], longest: float) -> DataFrame:
    """Every clip with its disposition, id and ground truth (its category, unless it is of a benign list or has no labels)."""
    rows = clips.where(F.col("category").isin(*categories))
    benign = F.col("benchmark").contains("benign") | (F.coalesce(F.size("labels"), F.lit(0)) == 0)
    why = F.when(F.col("duration").isNull(), "excluded_missing_video").when(F.col("duration") > longest, "excluded_over_duration").otherwise("included")
    return rows.withColumns({
        "disposition": why, "sample_id": F.format_string("%s__%s__%04d", "category", "benchmark", "at"),
        "gt": F.when(benign, F.array().cast("array<string>")).otherwise(F.array("category")),
    })


def until_full(rows: DataFrame, kept: Column, order: Sequence[str], limit: int) -> DataFrame:
    """The rows, in order, up to the limit-th kept one: what a scan sees that stops there. All, if fewer are kept."""
    key = F.struct(*order)
    last = rows.where(kept).select(key.alias("_k")).orderBy("_k").limit(limit).agg(F.when(F.count("*") == limit, F.max("_k")).alias("_k"))
    return rows.join(F.broadcast(last), F.col("_k").isNull() | (key <= F.col("_k"))).drop("_k")


def bench_summary(samples: DataFrame) -> DataFrame:
    """One row: counts by disposition, of harmful and benign included samples, and by category as a map."""
    kept = F.col("disposition") == "included"
    by = samples.where(kept).groupBy("category").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"))
    names = ("included", "excluded_over_duration", "excluded_missing_video")
    one = samples.agg(
        *[F.count_if(F.col("disposition") == n).alias(n) for n in names],
        F.count_if(kept & (F.size("gt") == 0)).alias("num_benign"), F.count_if(kept & (F.size("gt") > 0)).alias("num_harmful"),
    )
    return one.join(F.broadcast(by), F.lit(True))


def alternatives(glob: str) -> list[str]:
    """The globs without braces that a glob with {a,b} stands for."""
    found = re.search(r"\{([^{}]*)\}", glob)
    return [y for x in found[1].split(",") for y in alternatives(glob[: found.start()] + x + glob[found.end() :])] if found else [glob]


def is_hidden(name: str) -> bool:
    """Names that Spark's readers pass over too."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def entries(fs: arrow_fs.FileSystem, path: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what a folder holds, but empty files, as Spark's readers do. A local folder is read bit by bit."""
    if isinstance(fs, arrow_fs.LocalFileSystem):
        with os.scandir(path) as found:
            yield from ((x.name, x.is_dir()) for x in found if x.is_dir() or (x.is_file() and x.stat().st_size))
    else:
        found = fs.get_file_info(arrow_fs.FileSelector(path))
        yield from ((x.base_name, x.type == arrow_fs.FileType.Directory) for x in found if x.type == arrow_fs.FileType.Directory or x.size)


def files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, folder, name of the files below root whose names fit; contents are not read.

    Folders are listed by tasks, level by level, through Arrow's file systems, so the driver holds no names, however many files there are.
    A root that isn't a folder there (a pattern, or a store that Arrow doesn't reach) is listed by Spark, in the driver.
    """
    try:
        fs, base = sinks.file_system(root)
        known = fs.get_file_info(base).type == arrow_fs.FileType.Directory
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        known = False
    if known:
        top = os.path.abspath(base) if isinstance(fs, arrow_fs.LocalFileSystem) else re.sub(r"\A[a-z0-9]+:/*(?=/)", "", root).rstrip("/")
        path = F.concat(F.lit(top), "at")
        rows = listed(spark, root, glob)
    else:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        path = F.regexp_replace("path", r"\A[a-z0-9]+:/*(?=/)", "")
    return rows.select(path.alias("path"), folder(path).alias("folder"), folder(path, 0).alias("name"))


def listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """at: what follows root in the paths of the files below it whose names fit, written level by level."""
    fits = [re.compile(fnmatch.translate(x)) for x in alternatives(glob)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = sinks.file_system(root)
        for at in (x for batch in batches for x in batch.column(0).to_pylist()):
            found = ((f"{at}/{n}", is_folder) for n, is_folder in entries(fs, f"{base.rstrip('/')}{at}/") if not is_hidden(n) and (is_folder or any(x.match(n) for x in fits)))
            while part := list(islice(found, LISTED)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names=["at", "is_folder"])

    n, level, out = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.createDataFrame([("",)], "at string").coalesce(1), None
    while True:
        found = written(level.mapInArrow(run, "at string, is_folder boolean"), "listing")
        out = found if out is None else out.unionByName(found)
        level = found.where("is_folder").select("at")
        if level.isEmpty():
            return out.where("not is_folder").select("at")
        level = level.repartition(n)


def safe_videos(spark: SparkSession, root: str, media: DataFrame | None = None, shortest: float = 0.0) -> DataFrame:
    """path of every <folder>/content.mp4; with a media table also its duration, at least the shortest."""
    rows = files(spark, root, "content.mp4").select("path")
    return rows if media is None else rows.join(media.select("path", "duration"), "path").where(F.col("duration") >= shortest)


def frames(spark: SparkSession, root: str) -> DataFrame:
    """folder, paths: the frame images of each folder, in order."""
    return files(spark, root, "frame_*.jpg").groupBy("folder").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def model_folders(spark: SparkSession, root: str) -> DataFrame:
    """slug, path, iter of every folder below root that holds a model export (a config and weights); iter is the number its name ends in."""
    rows = files(spark, root, "*.{json,safetensors}")
    weights = (F.col("name") == "model.safetensors.index.json") | F.col("name").rlike(r"\Amodel-.*\.safetensors\z")
    kept = rows.groupBy(F.regexp_replace("path", r"/[^/]*\z", "").alias("path"), F.col("folder").alias("slug")).agg(F.bool_or(F.col("name") == "config.json").alias("c"), F.bool_or(weights).alias("w")).where("c and w")
    return kept.select("slug", "path", F.regexp_extract("slug", r"iter(\d+)\z", 1).try_cast("int").alias("iter"))
