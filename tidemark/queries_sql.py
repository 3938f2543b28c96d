"""Queries written in SQL with the engine's registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark import oracle as sql
from tidemark.functions import catalog
from tidemark.registry import query, read
from tidemark.sources.events import SQL as SEG


def session(spark: SparkSession, sf_dir: str) -> SparkSession:
    """The session with the functions and a view of the events."""
    read(spark, sf_dir, "events").createOrReplaceTempView("tidemark_events")
    catalog.register(spark, "tidemark_events")
    return spark


@query(f"WITH RECURSIVE {SEG}, {sql.matches((0.5,))} SELECT rec_id, g, p, round(t, 6) AS t FROM m")
def sql_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by a join, matched by a table function that sees each record's pairs best first."""
    return session(spark, sf_dir).sql("""
        SELECT rec_id, g, p, round(t, 6) AS t FROM greedy_match(TABLE(
          SELECT g.rec_id, g.i AS g, p.i AS p, tiou(g.s, g.e, p.s, p.e) AS t
          FROM segments() g JOIN segments() p ON g.rec_id = p.rec_id AND g.gt AND NOT p.gt AND g.s < p.e AND p.s < g.e
          WHERE tiou(g.s, g.e, p.s, p.e) >= 0.5), 0.5D)""")


@query(f"""WITH {SEG}, {sql.ISLANDS.format(src='seg')}, k AS (SELECT rec_id * 2 + CASE WHEN gt THEN 1 ELSE 0 END AS key, s, e FROM islands)
SELECT key, count(*) AS n, round(sum(e - s), 6) AS total, round(min(s), 6) AS first FROM k GROUP BY key""")
def sql_merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions by a table function that sees each key's ranges in order of their start."""
    return session(spark, sf_dir).sql("""
        SELECT key, count(*) AS n, round(sum(e - s), 6) AS total, round(min(s), 6) AS first
        FROM merged_ranges(TABLE(SELECT rec_id * 2 + CAST(gt AS BIGINT) AS key, s, e FROM segments()), 'key') GROUP BY key""")


@query(f"""WITH {SEG} SELECT rec_id, count(*) AS n, round(sum(round(e, 6) - round(s, 6)), 4) AS total,
  string_agg(CASE WHEN b % 2 = 1 THEN 'C1' ELSE '-' END, ',' ORDER BY i) AS first_label FROM seg WHERE NOT gt GROUP BY rec_id""")
def sql_answer_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted intervals as JSON lists in noise, recovered by a lateral table function; the list is recovered again by a scalar one."""
    return session(spark, sf_dir).sql("""
        WITH answers AS (
          SELECT rec_id, 'Here [they] are: ' || to_json(transform(array_sort(collect_list(struct(i, s, e, b))), x ->
            struct(x.s AS START_SEC, x.e AS END_SEC, 'd' AS DESCRIPTION, named_struct('C1', x.b % 2 = 1) AS GUARDRAIL))) || ' done.' AS answer
          FROM segments() WHERE NOT gt GROUP BY rec_id)
        SELECT a.rec_id, count(*) AS n, round(sum(x.e - x.s), 4) AS total,
          array_join(transform(array_sort(collect_list(struct(x.n, x.labels))), y -> CASE WHEN get_json_object(y.labels, '$.C1') = 'true' THEN 'C1' ELSE '-' END), ',') AS first_label
        FROM answers a, LATERAL answer_intervals(recover_json_list(a.answer)) x GROUP BY a.rec_id""")
