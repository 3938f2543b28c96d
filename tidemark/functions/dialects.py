"""Intervals of records in either dialect, read from VARIANT by the schema at hand: structured ones first, else those in a text.

An interval is (s, e, labels): its times under ``start`` and ``end`` or ``START_SEC`` and ``END_SEC`` (a missing start is 0, a missing end the
start, and an end is never before its start), its labels those of ``guardrail`` or ``GUARDRAIL`` that are true. Intervals come by start and end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.labels import true_word
from tidemark.functions.texts import let, path_variants, strip

NONE = "array<struct<s:double,e:double,labels:array<string>>>"


def _none() -> Column:
    return F.array().cast(NONE)


def _first(x: Column, *names: str) -> Column:
    """The first of the members that is there, as text."""
    return F.coalesce(*[F.try_variant_get(x, f"$.{n}", "string") for n in names])


def is_object(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))


def interval(x: Column) -> Column:
    """A VARIANT object as (s, e, labels)."""
    flags = F.coalesce(*[F.try_variant_get(x, f"$.{n}", "map<string,variant>") for n in ("guardrail", "GUARDRAIL")])
    names = F.coalesce(F.map_keys(F.map_filter(flags, lambda k, v: true_word(F.to_json(v)))), F.array().cast("array<string>"))
    times = F.struct(F.coalesce(_first(x, "start", "START_SEC").try_cast("double"), F.lit(0.0)).alias("s"), _first(x, "end", "END_SEC").try_cast("double").alias("e"))
    return let(times, lambda t: F.struct(t["s"].alias("s"), F.greatest(t["s"], t["e"]).alias("e"), names.alias("labels")))


def intervals(items: Column) -> Column:
    """An array of VARIANT: its objects as intervals, in order; empty for null."""
    return F.coalesce(F.array_sort(F.transform(F.filter(items, is_object), interval)), _none())


def structured(side: Column) -> Column:
    """The intervals of a side's chunks: those that its order lists, or all where it lists none."""
    both = F.struct(F.try_variant_get(side, "$.intervals.chunks", "map<string,variant>").alias("chunks"), F.try_variant_get(side, "$.intervals.chunk_order", "array<string>").alias("order"))
    some = lambda x: F.when(F.coalesce(F.size(x["order"]), F.lit(0)) > 0, F.transform(x["order"], lambda k: F.try_element_at(x["chunks"], k))).otherwise(F.map_values(x["chunks"]))
    return let(both, lambda x: intervals(some(x)))


def listed(text: Column) -> Column:
    """The intervals of a text that is a JSON list, but for backticks around it; none for any other."""
    bare = let(strip(text), lambda t: F.when(t.startswith("```"), F.regexp_replace(t, "^`+|`+$", "")).otherwise(t))
    return intervals(F.try_variant_get(F.try_parse_json(bare), "$", "array<variant>"))


def nonempty(first: Column, second: Column) -> Column:
    """The first array, or the second where it is empty."""
    return let(first, lambda x: F.when(F.size(x) > 0, x).otherwise(second))


def side_intervals(record: Column, side: str) -> Column:
    """The intervals of a side (prediction or ground_truth) of a record given as VARIANT: structured, else in its text."""
    own = F.try_variant_get(record, f"$.{side}", "variant")
    return let(own, lambda x: nonempty(structured(x), listed(F.try_variant_get(x, "$.supervised_span_text", "string"))))


def conversation_intervals(record: Column) -> Column:
    """The intervals of the first answering turn of a conversation that has any."""
    turns = F.try_variant_get(record, "$.conversations", "array<variant>")
    answers = F.filter(turns, lambda t: F.coalesce(F.try_variant_get(t, "$.from", "string") == "gpt", F.lit(False)))
    found = F.filter(F.transform(answers, lambda t: listed(F.try_variant_get(t, "$.value", "string"))), lambda x: F.size(x) > 0)
    return F.coalesce(F.get(found, 0), _none())


def text_at(record: Column, *path: str) -> Column:
    """A member of a VARIANT that is a text and not blank; null for anything else."""
    at = "$." + ".".join(path)
    value = F.try_variant_get(record, at, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.when(strip(F.try_variant_get(record, at, "string")) != "", F.try_variant_get(record, at, "string")))


def primary_key(record: Column) -> Column:
    """What names a record: its annotation's id, its own, else the path that it is about, else its number."""
    path = F.coalesce(*[text_at(record, *p) for p in (("metadata", "video_relative_path"), ("gt_record", "video"), ("video",))])
    number = F.coalesce(F.try_variant_get(record, "$.jsonl_record_index", "string"), F.lit("unknown"))
    return F.coalesce(text_at(record, "gt_record", "id"), text_at(record, "id"), F.get(path_variants(path, ()), 0), F.concat(F.lit("record_"), number))


def video_of(*records: Column) -> Column:
    """The first video of the records, annotations first."""
    return F.coalesce(*[x for r in records for x in (text_at(r, "gt_record", "video"), text_at(r, "video"))])


def source_category(*records: Column) -> Column:
    """The first source category that is not blank, else the empty text."""
    return F.coalesce(*[text_at(r, "metadata", "source_category") for r in records], F.lit(""))
