"""URL filters: host-suffix and path-prefix expressions matched to rules by hash prefix, digest and precedence.

A rule (action, host, path) fits its host and every subdomain if the url's path starts with the rule's path; the
longest fitting rule decides. Each url is expanded into the expressions that any rule could equal; these meet the rules
in an equi-join on the first 32 bits of their SHA-256 digests, and a hit counts only if the whole digests agree.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the default
action; so does a url with an empty path, as rule paths start with ``/``. Repeated rows are judged each for itself and a
null page_id stays null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER

#: (action, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rules up to this many are broadcast; longer lists meet the expressions in a shuffled join.
BROADCAST_RULES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where ``://`` is missing."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def expressions(host: Column, path: Column, labels: int, depth: int) -> Column:
    """All ``suffix + prefix`` texts with up to `labels` host labels and up to `depth` closed path segments."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.concat_ws(".", F.slice(parts, F.size(parts) - n + 1, n)),
    )
    steps = F.split(path, "/")
    # "/en/685" splits into "", "en", "685": the closed prefixes are "/" and "/en/"; whole paths without an end slash
    # can equal no rule path that ends with one, and start with no other.
    prefixes = F.when(
        F.size(steps) > 1,
        F.transform(
            F.sequence(F.lit(1), F.least(F.size(steps) - 1, F.lit(depth))),
            lambda n: F.concat(F.concat_ws("/", F.slice(steps, 1, n)), F.lit("/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(
        host != "", F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    ).otherwise(F.array().cast("array<string>"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    for action, host, path in rules:
        if action not in ("allow", "block") or not path.startswith("/") or not path.endswith("/"):
            raise ValueError(f"a rule is (allow|block, host, path from / to /), not {(action, host, path)}")
    made = spark.createDataFrame([(h + p, a) for a, h, p in rules], "rule string, action string")
    return _hashed(made, F.col("rule")).withColumnsRenamed({"prefix": "rule_prefix", "digest": "rule_digest"})


def _hashed(df: DataFrame, text: Column) -> DataFrame:
    return df.withColumn("digest", F.sha2(text, 256)).withColumn("prefix", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """id_col, host, path, rule (null if none fits), verdict; one row per input row."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("_id"), host.alias("host"), path.alias("path"))
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    depth = max((p.count("/") for _, _, p in rules), default=1)
    wide = _hashed(
        rows.select("*", F.explode_outer(expressions(F.col("host"), F.col("path"), labels, depth)).alias("expression")),
        F.col("expression"),
    )
    known = rule_table(spark, rules)
    if len(rules) <= BROADCAST_RULES:
        known = F.broadcast(known)
    met = wide.join(known, wide.prefix == known.rule_prefix, "left")
    best = F.max(F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("action"))))
    return (
        met.groupBy("_row", "_id", "host", "path")
        .agg(best.alias("best"))
        .select(
            F.col("_id").alias(id_col),
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
        )
    )


#: The same judgement as DuckDB SQL over `pages`.
ORACLE_SQL = """
WITH rules(action, host, path) AS (VALUES
    ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT s.*, u.host || u.path AS rule, u.action,
    row_number() OVER (PARTITION BY s.r ORDER BY length(u.host || u.path) DESC NULLS LAST) AS n
  FROM split s LEFT JOIN rules u
    ON (s.host = u.host OR ends_with(s.host, '.' || u.host)) AND starts_with(s.path, u.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE n = 1
"""
