"""JSON lists in noisy text, and interval payloads in either dialect.

Only the recovery of a JSON value from noise needs Python: it relies on a strict parser that rejects what follows the value. It is
linear in the text, an Arrow-batched UDF that gives the list's objects back as JSON text; everything after it is column functions.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.labels import label_bits, prefix_bits, raw_map, true_python, true_word
from tidemark.functions.texts import after_marker, let, strip

MAPS = "array<map<string,string>>"
#: Texts that a Python worker holds at once.
BATCH = 500


BRACKET_OR_QUOTE = re.compile(r"""["'\[\]{}]""")
FENCE, FENCE_END = re.compile(r"```(?:json)?\s*(?=\{)"), re.compile(r"\}\s*```")


def opening(text: str, close: int) -> int:
    """Where the bracket opens that ends at close, or -1: the only place where a value ending there can begin.

    Goes back from close, which stands outside any string: there a quote is a string's end, and the string reaches back to the
    nearest such quote that no odd number of backslashes escapes. So the text is read once, and only open brackets are kept.
    """
    back = text[close::-1]
    expected: list[str] = []
    at = 0
    while found := BRACKET_OR_QUOTE.search(back, at):
        sign, here = found[0], found.start()
        at = here + 1
        if sign in "\"'":
            while (at := back.find(sign, at) + 1) and (len(back[at : at + 64]) - len(back[at : at + 64].lstrip("\\"))) % 2:
                pass
            if not at:
                return -1
        elif sign in "]}":
            expected.append("[" if sign == "]" else "{")
        elif expected.pop() != sign:
            return -1
        elif not expected:
            return close - here
    return -1


def find_list(text: str | None) -> list | None:
    """The strict JSON list that ends at the text's last ], wherever it begins; null without one.

    It is what one finds by trying every [ from last to first: no other can be the beginning.
    """
    close = -1 if text is None else text.rfind("]")
    at = opening(text, close) if close >= 0 else -1
    if at < 0:
        return None
    try:
        value = json.loads(text[at : close + 1])
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, list) else None


def read_object(text: str) -> dict | None:
    """A dictionary written as JSON, else as a Python literal."""
    for read in (json.loads, ast.literal_eval):
        try:
            value = read(text)
        except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
            continue
        return value if isinstance(value, dict) else None
    return None


def find_object(text: str | None) -> dict | None:
    """The object in the first fence, else the one that ends at the text's last }. JSON, else a Python literal."""
    if text is None:
        return None
    fence = FENCE.search(text)
    end = FENCE_END.search(text, fence.end()) if fence else None
    if end and (found := read_object(text[fence.end() : end.start() + 1])) is not None:
        return found
    close = text.rfind("}")
    at = opening(text, close) if close >= 0 else -1
    return read_object(text[at : close + 1]) if at >= 0 else None


@F.pandas_udf(T.StringType())
def recover_json_object(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The object in a model's answer as JSON text; null if it holds none."""
    for batch in texts:
        yield batch.map(lambda t: None if (found := find_object(t)) is None else json.dumps(found, default=str), na_action="ignore")


def objects_of(value: list | None) -> str | None:
    """The list's objects as JSON text, keys in document order."""
    return None if value is None else json.dumps([x for x in value if isinstance(x, dict)], ensure_ascii=False)


@F.pandas_udf(T.StringType())
def recover_json_list(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: objects_of(find_list(t)), na_action="ignore")


def listed(text: Column) -> Column:
    """recover_json_list in batches of BATCH texts: a worker holds a batch of texts and what it found in them, whatever the table's size."""
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return recover_json_list(text)


def plain_json_list(text: Column) -> Column:
    """The text, without outer backticks, if it is a JSON list of objects; else null."""
    bare = F.when(strip(text).startswith("```"), F.regexp_replace(strip(text), "^`+|`+$", "")).otherwise(strip(text))
    return F.when(bare.startswith("[") & bare.endswith("]"), F.from_json(bare, MAPS))


def raw_objects(list_json: Column) -> Column:
    """A JSON list's objects as maps of raw values; other elements are null."""
    return F.from_json(list_json, MAPS)


def shots(list_json: Column) -> Column:
    """Array of (s, e, description, explanation, b) from wire-form objects in the list.

    Times that are missing are 0; objects with times that are no numbers, or with end < start, are dropped.
    """
    time = lambda x, k: F.when(F.map_contains_key(x, k), F.try_element_at(x, F.lit(k)).try_cast("double")).otherwise(F.lit(0.0))
    made = F.transform(
        F.filter(raw_objects(list_json), lambda x: x.isNotNull()),
        lambda x: F.struct(
            F.round(time(x, "START_SEC"), 6).alias("s"), F.round(time(x, "END_SEC"), 6).alias("e"),
            F.coalesce(F.try_element_at(x, F.lit("DESCRIPTION")), F.lit("")).alias("description"),
            F.coalesce(F.try_element_at(x, F.lit("EXPLANATION")), F.lit("")).alias("explanation"),
            F.coalesce(label_bits(raw_map(F.try_element_at(x, F.lit("GUARDRAIL")))), F.lit(0)).alias("b"),
        ),
    )
    return F.filter(made, lambda x: x["s"].isNotNull() & x["e"].isNotNull() & (x["e"] >= x["s"]))


def parse_answer(text: Column) -> Column:
    """Array of shots of a model's answer; null if it holds no JSON list."""
    return shots(listed(after_marker(text)))


def to_payload(parsed: Column, note: Column | None = None) -> Column:
    """Shots as (parse_status, parse_ok, chunks by key chunk_1, chunk_2, ..., chunk_order, parse_note); an empty one with the note for null."""
    key = lambda i: F.concat(F.lit("chunk_"), (i + 1).cast("string"))
    some = F.coalesce(parsed, F.array().cast("array<struct<s:double,e:double,description:string,explanation:string,b:int>>"))
    return F.struct(
        F.when(parsed.isNull(), "error").otherwise("ok").alias("parse_status"),
        parsed.isNotNull().alias("parse_ok"),
        F.map_from_entries(F.transform(some, lambda x, i: F.struct(key(i), x))).alias("chunks"),
        F.transform(some, lambda x, i: key(i)).alias("chunk_order"),
        F.when(parsed.isNull(), F.lit("no JSON list of intervals") if note is None else note).alias("parse_note"),
    )


def ordered_chunks(chunks: Column, order: Column) -> Column:
    """Listed keys that exist, in order and as often as listed, then the other keys by name."""
    listed = F.filter(F.coalesce(order, F.array().cast("array<string>")), lambda k: F.map_contains_key(chunks, k))
    rest = F.array_sort(F.array_except(F.map_keys(chunks), listed))
    return F.transform(F.concat(listed, rest), lambda k: F.element_at(chunks, k))


def listed_chunks(chunks: Column, order: Column) -> Column:
    """For display: listed keys only (all, in document order, if none is listed), by start and end."""
    keys = F.when(F.coalesce(F.size(order), F.lit(0)) > 0, order).otherwise(F.map_keys(chunks))
    found = F.filter(F.transform(keys, lambda k: F.try_element_at(chunks, k)), lambda x: x.isNotNull())
    return F.array_sort(found)


def display_interval(raw: Column) -> Column:
    """A raw object of either dialect as (s, e, labels): end is at least start, labels are the keys that are true."""
    get = lambda *keys: F.coalesce(*[F.try_element_at(raw, F.lit(k)) for k in keys])
    s = F.coalesce(get("start", "START_SEC").try_cast("double"), F.lit(0.0))
    e = F.coalesce(get("end", "END_SEC").try_cast("double"), s)
    flags = raw_map(get("guardrail", "GUARDRAIL"))
    names = F.coalesce(F.map_keys(F.map_filter(flags, lambda k, v: true_word(v))), F.array().cast("array<string>"))
    return F.struct(s.alias("s"), F.greatest(s, e).alias("e"), names.alias("labels"))


def three_part_answer(text: Column) -> Column:
    """(description, labels as a map of raw values, explanation) of ``DESCRIPTION: .. GUARDRAIL: {..} EXPLANATION: ..``; null if it isn't one.

    The three parts and the map are computed once a row, whatever is made of them.
    """
    # fixed value: the form of such answers
    pattern = r"(?s)DESCRIPTION:\s*(.*?)\s*GUARDRAIL:\s*(\{.*?\})\s*EXPLANATION:\s*(.*)\z"
    value = lambda x, word: F.regexp_replace(x, rf"(:\s*){word}(?=\s*[,}}])", "$1" + word.lower())
    parts = lambda t: F.when(t.contains("GUARDRAIL:"), F.struct(*[F.regexp_extract(t, pattern, g).alias(f"_{g}") for g in (1, 2, 3)]))

    def made(p: Column) -> Column:
        answer = lambda labels: F.when(labels.isNotNull(), F.struct(strip(p["_1"]).alias("description"), labels.alias("labels"), strip(p["_3"]).alias("explanation")))
        return let(F.when(p["_2"] != "", raw_map(value(value(p["_2"], "True"), "False"))), answer)

    return let(text, lambda t: let(parts(t), made))


def has_details(answer: Column) -> Column:
    """Whether a three-part answer has a description and an explanation."""
    return (answer["description"] != "") & (answer["explanation"] != "")


def clip_answer(answer: Column) -> Column:
    """A three-part answer with None for missing texts; null if texts are missing and any label is true."""

    def made(answer: Column) -> Column:
        any_true = F.exists(F.map_values(answer["labels"]), true_python)
        some = lambda k: F.when(answer[k] == "", F.lit("None")).otherwise(answer[k]).alias(k)
        return F.when(has_details(answer), answer).when(~any_true, F.struct(some("description"), answer["labels"].alias("labels"), some("explanation")))

    return let(answer, made)


def full_categories(text: Column) -> Column:
    """Label bits of a three-part answer to a whole recording; null if it isn't one."""
    return let(three_part_answer(after_marker(text)), lambda answer: F.when(answer.isNotNull(), prefix_bits(answer["labels"])))


def interval_categories(text: Column) -> Column:
    """Label bits of all intervals in an answer; null if it holds no JSON list."""
    flags = F.transform(raw_objects(listed(after_marker(text))), lambda x: F.coalesce(prefix_bits(raw_map(F.try_element_at(x, F.lit("GUARDRAIL")))), F.lit(0)))
    return F.aggregate(flags, F.lit(0), lambda a, x: a.bitwiseOR(x))


def message_content(payload: Column) -> Column:
    """The text of a chat completion: its content, or its text parts that are not empty, a line each. Raises for other shapes."""
    at = "$.choices[0].message.content"
    content = F.variant_get(F.try_parse_json(payload), at, "variant")
    kind = F.schema_of_variant(content)
    parts = F.from_json(F.get_json_object(payload, at), "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(parts, lambda x: x["type"].isin("text", "output_text") & (F.coalesce(x["text"], F.lit("")) != "")), lambda x: x["text"])
    wrong = F.raise_error(F.concat(F.lit("no message content in "), F.coalesce(payload, F.lit("null"))))
    return F.when(kind == "STRING", F.get_json_object(payload, at)).when(kind.startswith("ARRAY"), strip(F.array_join(texts, "\n"))).otherwise(wrong.cast("string"))


def video_path(record: Column, strict: bool = False) -> Column:
    """A record's video, else that of the first video part of its user messages; null, or an error if strict, without one."""
    said = F.when(F.get_json_object(record, "$.messages[0].role") == "user", F.get_json_object(record, "$.messages[0].content"))
    parts = F.from_json(said, "array<struct<type:string,video:string>>")
    own = F.get_json_object(record, "$.video")
    found = F.coalesce(F.when(F.trim(own) != "", own), F.get(F.filter(parts, lambda x: (x["type"] == "video") & x["video"].isNotNull()), 0)["video"])
    return F.coalesce(found, F.raise_error(F.lit("a record without a video")).cast("string")) if strict else found
