"""The engine's functions under their names in SQL: `register(spark)`, then ``SELECT * FROM greedy_match(TABLE(pairs), 0.5)``.

Scalar functions are SQL functions, which Catalyst inlines, or Arrow-batched UDFs where a parser is needed. Table functions that must
see rows in an order are Python UDTFs: each says in `analyze` how its input is to be dealt and sorted, so Spark shuffles and sorts and
the function goes through a key's rows as a stream, holding no more than its state (the ends taken so far, one open range).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tidemark.functions import jsonx

TIOU = """CREATE OR REPLACE TEMPORARY FUNCTION tiou(s1 DOUBLE, e1 DOUBLE, s2 DOUBLE, e2 DOUBLE) RETURNS DOUBLE
COMMENT 'Overlap over hull of two intervals; 0 where they do not overlap'
RETURN CASE WHEN least(e1, e2) > greatest(s1, s2) THEN (least(e1, e2) - greatest(s1, s2)) / (greatest(e1, e2) - least(s1, s2)) ELSE 0D END"""
CODES = """CREATE OR REPLACE TEMPORARY FUNCTION label_codes(b INT) RETURNS STRING COMMENT 'C1,C3,... of the set bits'
RETURN array_join(transform(filter(sequence(0, 30), j -> shiftright(b, j) % 2 = 1), j -> 'C' || (j + 1)), ',')"""
#: Interval records of the view named: one per user and week, as sources.events makes them.
SEGMENTS = """CREATE OR REPLACE TEMPORARY FUNCTION segments()
RETURNS TABLE(rec_id BIGINT, model_id BIGINT, iter BIGINT, gt BOOLEAN, i BIGINT, s DOUBLE, e DOUBLE, b INT)
COMMENT 'Interval records of the view {events}: one per user and week'
RETURN SELECT user_id * 10 + d DIV 7, user_id % 3, d DIV 7, event_id % 2 = 0, event_id, m / 60D, m / 60D + value / 4,
  CASE WHEN k % 3 <> 0 THEN shiftleft(1, k % 6) ELSE 0 END | CASE WHEN k % 5 = 0 THEN shiftleft(1, k DIV 6 % 6) ELSE 0 END
FROM (SELECT *, CAST(d % 7 * 1440 + hour(ts) * 60 + minute(ts) AS DOUBLE) AS m
  FROM (SELECT event_id, user_id, value, ts, CAST(dayofmonth(ts) - 1 AS BIGINT) AS d, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}))"""


def _columns(table: AnalyzeArgument, *names: str) -> dict[str, T.DataType]:
    if not table.isTable:
        raise ValueError("the first argument must be a table: TABLE(...)")
    kinds = {f.name: f.dataType for f in table.dataType.fields}
    if missing := [n for n in names if n not in kinds]:
        raise ValueError(f"the input table has no column {', '.join(missing)}")
    return {n: kinds[n] for n in names}


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


@udtf
class GreedyMatch:
    """greedy_match(TABLE(pairs), tau [, key]): pairs (key, g, p, t) taken best first, each g and p at most once.

    key is rec_id unless named. Pairs come sorted by (t desc, g, p), so one pass decides; t below tau is left out.
    """

    def __init__(self) -> None:
        self.taken: tuple[set, set] = (set(), set())

    @staticmethod
    def analyze(pairs: AnalyzeArgument, tau: AnalyzeArgument, key: AnalyzeArgument | None = None) -> AnalyzeResult:
        name = key.value if key is not None else "rec_id"
        kinds = _columns(pairs, name, "g", "p", "t")
        order = [OrderingColumn("t", ascending=False), OrderingColumn("g"), OrderingColumn("p")]
        return AnalyzeResult(_struct(**kinds), partitionBy=[PartitioningColumn(name)], orderBy=order)

    def eval(self, pair, tau: float, key: str = "rec_id") -> Iterator[tuple]:
        g, p = pair["g"], pair["p"]
        if pair["t"] is not None and pair["t"] >= tau and g not in self.taken[0] and p not in self.taken[1]:
            self.taken[0].add(g)
            self.taken[1].add(p)
            yield pair[key], g, p, pair["t"]


@udtf
class MergedRanges:
    """merged_ranges(TABLE(ranges), key): the union of each key's ranges (key, s, e); touching ones merge, empty ones go."""

    def __init__(self) -> None:
        self.open: list | None = None

    @staticmethod
    def analyze(ranges: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        kinds = _columns(ranges, key.value, "s", "e")
        return AnalyzeResult(_struct(**kinds), partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn("s")])

    def eval(self, one, key: str) -> Iterator[tuple]:
        s, e = one["s"], one["e"]
        if s is None or e is None or e <= s:
            return
        if self.open and s <= self.open[2]:
            self.open[2] = max(self.open[2], e)
            return
        done, self.open = self.open, [one[key], s, e]
        if done:
            yield tuple(done)

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            yield tuple(self.open)


@udtf(returnType="n int, s double, e double, description string, labels string")
class AnswerIntervals:
    """answer_intervals(text): the objects of the JSON list in a model's answer, with start, end and labels as JSON; none for none."""

    def eval(self, text: str) -> Iterator[tuple]:
        n = 0
        for x in jsonx.find_list(text) or []:
            if isinstance(x, dict):
                try:
                    s, e = (float(x.get(k, 0.0)) for k in ("START_SEC", "END_SEC"))
                except (TypeError, ValueError):
                    continue
                if e >= s:
                    yield n, round(s, 6), round(e, 6), str(x.get("DESCRIPTION", "")), json.dumps(x.get("GUARDRAIL", {}))
                    n += 1


def register(spark: SparkSession, events: str | None = None) -> None:
    """Registers all functions; with the name of a view of events also the table function segments()."""
    for text in (TIOU, CODES):
        spark.sql(text)
    for name, function in (("recover_json_list", jsonx.recover_json_list), ("recover_json_object", jsonx.recover_json_object)):
        spark.udf.register(name, function)
    for name, function in (("greedy_match", GreedyMatch), ("merged_ranges", MergedRanges), ("answer_intervals", AnswerIntervals)):
        spark.udtf.register(name, function)
    if events:
        spark.sql(SEGMENTS.format(events=events))
