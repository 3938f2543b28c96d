"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A text's words (A-Z lower-cased, cut at white space) form five-word shingles; the sketch holds the k smallest distinct
XXH64-based shingle hashes in order. Sketches of parts merge into the sketch of the whole (the k smallest of their
union), and two sketches estimate resemblance, containment and the number of distinct shingles.

Defined results: a null or empty text has no words, an empty sketch and an empty fingerprint; two empty sketches have
likeness 1, an empty and another 0. A text of fewer than five words is one shingle. Equal texts have equal fingerprints.
Repeated rows are each fingerprinted; rows without a doc_id come first in the order of documents, and rows with equal
doc_id follow the order of their texts. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, let, partitions

WIDTH, K = 5, 128


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Array of the hashes of the text's shingles, repeats included."""
    words = F.split(F.trim(F.regexp_replace(ascii_lower(text), r"[\x09-\x0D ]+", " ")), " ")
    hashed = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))
    # get() beyond the end is null, which xxhash64 skips: the first entry of a short text hashes all its words
    made = lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, width)])), 1, F.greatest(F.size(h) - (width - 1), F.lit(1)))
    return let(hashed, made)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among those of either text."""
    return let(
        F.struct(merge(a, b, k).alias("u"), F.array_intersect(a, b).alias("i")),
        lambda x: F.when(F.size(x["u"]) == 0, 1.0).otherwise(F.size(F.array_intersect(x["u"], x["i"])) / F.size(x["u"])),
    )


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """16 hex digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merge_sketches(parts: DataFrame, key: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """key, sketch: the sketch of all parts of each key. Each task keeps k hashes of a key at most before the shuffle."""
    hashes = parts.select(F.col(f"`{key}`").alias("_key"), F.explode(f"`{sketch_col}`").alias("h")).distinct()
    least = hashes.withColumn("n", F.row_number().over(Window.partitionBy("_key").orderBy("h"))).where(F.col("n") <= k)
    return least.groupBy("_key").agg(F.sort_array(F.collect_list("h")).alias("sketch")).withColumnRenamed("_key", key)


def _count_up_to(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at most value, by binary search."""
    if not bounds:
        return F.lit(0)
    steps, step = [], 1
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    held = F.array(*[F.lit(b).cast("long") for b in bounds])
    return let(
        held,
        lambda b: F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda at, s: F.when(F.coalesce(F.get(b, at + s - 1) <= value, F.lit(False)), at + s).otherwise(at),
        ),
    )


def with_next(rows: DataFrame) -> tuple[DataFrame, Window]:
    """rows (_id, text) with next_text by ascending _id, and the window that leads to it.

    Rows are dealt into ranges of _id whose bounds are ids of the table; the first row of each range is also a row
    (turn 1) at the end of the range before, and the very first at the end of the last, so one shuffle of the texts
    finds every neighbour. Rows with turn 1 are to be dropped at the end.
    """
    n = 4 * partitions(rows.sparkSession)
    shares = F.array(*[F.lit((i + 1) / n) for i in range(n - 1)])
    seen = rows.agg(F.percentile_approx("_id", shares, 16 * n).alias("b"), F.min("_id").alias("least"), F.count("*").alias("n"), F.count("_id").alias("with_id")).head()
    bounds = sorted({int(x) for x in seen.b or [] if x is not None and x > seen.least})
    at = F.coalesce(_count_up_to(bounds, F.col("_id")), F.lit(0))
    first = F.col("_id").isNull() if seen.with_id < seen.n else F.col("_id") == F.lit(seen.least)
    bound = F.get(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("at") - 1) if bounds else F.lit(None).cast("long")
    places = F.concat(
        F.array(F.struct(F.col("at").alias("range"), F.lit(0).alias("turn"))),
        F.when(F.col("_id") == bound, F.array(F.struct((F.col("at") - 1).alias("range"), F.lit(1).alias("turn")))).otherwise(F.array()),
        F.when(first, F.array(F.struct(F.lit(len(bounds)).alias("range"), F.lit(2).alias("turn")))).otherwise(F.array()),
    )
    dealt = rows.withColumn("at", at).select("_id", "text", F.inline(places))
    window = Window.partitionBy("range").orderBy("turn", F.asc_nulls_first("_id"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(window)), window


def fingerprint_documents(documents: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (its last quarter replaced from the next document), and their likeness."""
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    led, window = with_next(rows)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))
    made = led.select("range", "turn", "_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    made = made.select("range", "turn", "_id", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text"), k).alias("own"), sketch(F.col("edited"), k).alias("other"))
    made = made.withColumn("following", F.lead("own").over(window)).where("turn = 0")
    return made.select(
        F.col("_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("following"), k).alias("near_next"),
        containment(F.col("own"), F.col("other"), k).alias("held_by_edited"),
        distinct_shingles(F.col("own"), k).alias("n_shingles"),
    )
