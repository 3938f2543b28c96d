"""Queries that prepare datasets by plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import preparation
from tidemark.registry import query, read

LANGS = ("en", "de", "fr", "es")
HASH = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
#: First accepted of twenty attempts that are all made (a plan that needs more is not expected).
PREPARED = f"""WITH d AS (SELECT doc_id AS sample, lang, CASE n_chars % 4 WHEN 0 THEN []::VARCHAR[] WHEN 3 THEN [lang, 'en'] ELSE [lang] END AS labels FROM documents WHERE lang IN {LANGS}),
pool AS (SELECT event_id AS clip, ['en', 'de', 'fr', 'es'][1 + user_id % 4] AS label, 1 + value / 4 AS dur FROM events),
clips AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(clip || ':7'), clip) AS rn, count(*) OVER (PARTITION BY label) AS cnt FROM pool),
safe AS (SELECT page_id AS recording, 10.0::DOUBLE + length(html) % 40 AS len, row_number() OVER (ORDER BY md5(page_id || ':7'), page_id) AS rn, count(*) OVER () AS cnt FROM pages),
a AS (SELECT d.*, n, s.recording, least(30.0::DOUBLE, s.len) AS own FROM d, range(1, 21) AS t(n), (SELECT max(cnt) AS m FROM safe) JOIN safe s ON s.rn = {HASH.format("sample || ':' || n || ':safe:7'")} % m + 1),
slots AS (SELECT sample, n, i, row_number() OVER (PARTITION BY sample, n ORDER BY md5(sample || ':' || n || ':' || i), i) AS r, len(labels) AS k FROM a, LATERAL (SELECT unnest(range(CAST(floor(own / 0.5) AS BIGINT) + 1)) AS i) u WHERE len(labels) > 0),
pos AS (SELECT sample, n, i * 0.5::DOUBLE AS place, row_number() OVER (PARTITION BY sample, n ORDER BY i) - 1 AS j FROM slots WHERE r <= k),
each AS (SELECT a.sample, a.n, own, place, j, labels[j + 1] AS label FROM a JOIN pos USING (sample, n)),
seg AS (SELECT e.sample, e.n, e.own, e.place, e.label, c.clip, c.dur FROM each e JOIN (SELECT label, max(cnt) AS m FROM clips GROUP BY label) x USING (label) JOIN clips c ON c.label = e.label AND c.rn = {HASH.format("sample || ':' || n || ':' || j || ':7'")} % m + 1),
laid AS (SELECT *, place + coalesce(sum(dur) OVER (PARTITION BY sample, n ORDER BY place, dur ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, least(32.0::DOUBLE, own + sum(dur) OVER (PARTITION BY sample, n)) AS total FROM seg),
cl AS (SELECT *, least(greatest(s0, 0), total) AS s, least(greatest(s0 + dur, 0), total) AS e FROM laid),
g AS (SELECT *, least(total, round(round_even(s / 0.5, 0) * 0.5, 6)) AS x, least(total, round(ceil(e / 0.5) * 0.5, 6)) AS y FROM cl),
sn AS (SELECT *, CASE WHEN e > s AND y <= x THEN least(total, round(x + 0.5, 6)) ELSE y END AS z FROM g),
k AS (SELECT sample, n, count(*) FILTER (z > x) AS kept, max(total) AS total, round(coalesce(sum(x) FILTER (z > x), 0), 6) AS starts, round(coalesce(sum(z) FILTER (z > x), 0), 6) AS ends, CAST(coalesce(sum(clip) FILTER (z > x), 0) AS BIGINT) AS clips FROM sn GROUP BY sample, n),
f AS (SELECT a.sample, a.n, a.recording, round(coalesce(k.total, least(a.own, 32.0)), 6) AS seconds, coalesce(starts, 0) AS starts, coalesce(ends, 0) AS ends, coalesce(clips, 0) AS clips, row_number() OVER (PARTITION BY a.sample ORDER BY a.n) AS first
  FROM a LEFT JOIN k USING (sample, n) WHERE coalesce(kept, 0) = len(labels))
SELECT sample, CAST(n AS INT) AS attempt, recording, seconds, starts, ends, clips FROM f WHERE first = 1"""


@query(PREPARED)
def prepared_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a plan, every event a clip, every page a safe recording; samples that lose a clip at their end are drawn again."""
    lang = F.col("lang")
    docs = read(spark, sf_dir, "documents").where(lang.isin(*LANGS))
    labels = F.when(F.col("n_chars") % 4 == 0, F.array().cast("array<string>")).when(F.col("n_chars") % 4 == 3, F.array(lang, F.lit("en"))).otherwise(F.array(lang))
    plans = docs.select(F.col("doc_id").alias("sample"), labels.alias("labels"))
    pool = read(spark, sf_dir, "events").select(F.col("event_id").alias("clip"), F.element_at(F.array(*map(F.lit, LANGS)), (1 + F.col("user_id") % 4).cast("int")).alias("label"), (1 + F.col("value") / 4).alias("duration"))
    safe = read(spark, sf_dir, "pages").select(F.col("page_id").alias("recording"), (F.lit(10.0) + F.length("html") % 40).alias("length"))
    made = preparation.prepare(plans, pool, safe, base=30.0, step=0.5, longest=32.0)
    preparation.balance(made, plans).count()  # raises where they differ
    total = lambda k, zero: F.aggregate("segments", F.lit(zero), lambda a, x: a + x[k])
    return made.select("sample", "attempt", "recording", F.round("seconds", 6).alias("seconds"), F.round(total("start", 0.0), 6).alias("starts"), F.round(total("end", 0.0), 6).alias("ends"),
                       F.aggregate("segments", F.lit(0).cast("long"), lambda a, x: a + x["clip"]).alias("clips"))
