"""License scans by diagonal voting, with DataFrame functions only.

Every text becomes words; all its rolling two-word grams meet the grams of the templates in an equi-join on their XXH64
hash (the gram itself is compared too, so a vote is exact). A vote falls on the diagonal ``word place - template
place``. Votes are summed by diagonal, and neighbouring diagonals of a template merge into one island (so inserted or missing
words don't split a notice). A span is verified inside its island: the island counts if any window of a bounded width in it holds
enough of the template's voting places, so words that follow a notice can't hide it. A base phrase needs all its grams on
one diagonal, which is the exact phrase. Every gram of a template votes, also one of function words alone, so no place is left out.

The templates are an argument (label: notice), by default a list of short ones. Their side of the join is broadcast if they have
no more than BROADCAST grams, else shuffled; no other side is broadcast.

Defined results: a null or empty text has no words, no places, empty labels and score 0; a one-word text likewise.
Repeated rows are scanned each for itself, a null doc_id stays null, other columns are ignored, an empty table gives an
empty result. A very long text is one row of the scan and many rows of the join.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER, ascii_lower, let

LOWER = str.maketrans(UPPER, UPPER.lower())

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: phrase: label
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: label: notice, as its words
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "gpl-2.0": "licensed under the gnu general public license version 2",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "agpl-3.0": "licensed under the gnu affero general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit-released": "released under the mit license",
    "mpl-2.0": "subject to the terms of the mozilla public license version 2 0",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "no-warranty": "the software is provided as is without warranty of any kind express or implied",
    "all-rights": "all rights reserved no part of this publication may be reproduced",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Share of a notice's voting places that a span must hold, and its greatest width as a multiple of the notice.
COVERED, WIDTH = 0.75, 1.5
#: Grams of templates up to which their table is broadcast.
BROADCAST = 100_000


def templates(notices: Mapping[str, str] = NOTICES) -> list[tuple[str, str, int, int, int, bool]]:
    """(gram, label, place, words, voting places, base) for every rolling gram."""
    out = []
    for text, label, base in [*((t, n, True) for t, n in BASE.items()), *((t, n, False) for n, t in notices.items())]:
        w = re.findall(WORD, text.translate(LOWER))
        out += [(f"{w[i]} {w[i + 1]}", label, i, len(w), len(w) - 1, base) for i in range(len(w) - 1)]
    return out


def template_table(spark: SparkSession, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    made = spark.createDataFrame(templates(notices), "t_gram string, label string, place int, t_words int, voting int, base boolean")
    return made.withColumn("t_hash", F.xxhash64("t_gram"))


def gram_rows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, _id, n_words and (at, gram) for each rolling two-word gram; a text without words has one row with a null gram."""
    words = F.regexp_extract_all(ascii_lower(F.col(f"`{text_col}`").cast("string")), F.lit(WORD), F.lit(0))
    made = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.transform(w, lambda x, i: F.concat(x, F.lit(" "), F.coalesce(F.get(w, i + 1), F.lit("")))).alias("grams"),
        ),
    )
    rows = documents.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("_id"), made.alias("made"))
    return rows.select("_row", "_id", F.col("made.n").alias("n_words"), F.posexplode_outer("made.grams").alias("at", "gram"))


def spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """One row per island (label: null unless it is accepted; first, last: word places and covered: share of the notice, of its best window)
    and one with a null label per text."""
    grams = gram_rows(documents, id_col, text_col).withColumn("hash", F.xxhash64("gram"))
    known = template_table(documents.sparkSession, notices)
    if len(templates(notices)) <= BROADCAST:
        known = F.broadcast(known)
    met = grams.join(known, (grams.hash == known.t_hash) & (grams.gram == known.t_gram), "left")
    met = met.where(F.col("label").isNotNull() | F.col("at").isNull() | (F.col("at") == 0))
    key = ["_row", "_id", "n_words", "label", "base", "t_words", "voting"]
    diagonals = met.groupBy(*key, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    # neighbouring diagonals: at most a fifth of the notice apart; a base phrase lies on exactly one
    near = Window.partitionBy("_row", "label", "base").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(near)
    apart = F.col("base") | gap.isNull() | (gap > F.greatest(F.lit(1), F.floor(F.col("t_words") / 5)))
    islands = diagonals.withColumn("island", F.sum(apart.cast("int")).over(near))
    votes = islands.select(*key, "island", F.explode_outer("places").alias("place"), "diagonal").withColumn("at", F.col("diagonal") + F.col("place"))
    # of each vote the window that it begins; a window ends a word behind its last gram's start
    wide = max((n for *_, n, _, _ in templates(notices)), default=0)
    ahead = Window.partitionBy("_row", "label", "base", "island").orderBy("at").rangeBetween(0, int(WIDTH * wide))
    seen = F.collect_list(F.struct("at", "place")).over(ahead)
    inside = F.filter(seen, lambda v: v["at"] <= F.col("at") + F.floor(WIDTH * F.col("t_words")) - 2)
    windows = votes.withColumn("inside", inside).withColumn("covered", F.size(F.array_distinct(F.transform("inside", lambda v: v["place"]))) / F.col("voting"))
    best = F.max(F.struct("covered", (-F.col("at")).alias("at"), F.array_max(F.transform("inside", lambda v: v["at"])).alias("end")))
    merged = windows.groupBy(*key, "island").agg(best.alias("best"))
    covered = F.col("best.covered")
    whole = F.when(F.col("base"), covered == 1.0).otherwise(covered >= COVERED)
    return merged.select(
        "_row", "_id", "n_words", "base", F.when(whole, F.col("label")).alias("label"),
        (-F.col("best.at")).cast("long").alias("first"), (F.col("best.end") + 1).cast("long").alias("last"),
        F.when(F.col("label").isNotNull(), covered).alias("covered"),
    )


def scan_licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """Per text: n_words, n_base, first_word, last_word, base_labels, labels, score (best share of any template in one window).

    notices: label and notice, whole license texts if you like; the base phrases are always there.
    """
    of_base = F.col("base") & F.col("label").isNotNull()
    return (
        spans(documents, id_col, text_col, notices)
        .groupBy("_row", "_id", "n_words")
        .agg(
            F.count(F.when(of_base, 1)).alias("n_base"),
            F.min(F.when(of_base, F.col("first"))).alias("first_word"),
            F.max(F.when(of_base, F.col("first"))).alias("last_word"),
            F.array_join(F.sort_array(F.collect_set(F.when(of_base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
            F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"),
        )
        .drop("_row")
        .withColumnRenamed("_id", id_col)
    )


def oracle_sql() -> str:
    """The same scan as DuckDB SQL over `documents`."""
    rows = ", ".join(f"('{g}', '{n}', {p}, {m}, {v}, {str(b).lower()})" for g, n, p, m, v, b in templates())
    return f"""
WITH t(t_gram, label, place, t_words, voting, base) AS (VALUES {rows}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words, row_number() OVER () AS r FROM documents),
g AS (SELECT r, i AS pos, words[i + 1] || ' ' || words[i + 2] AS gram FROM w, unnest(range(0, len(words) - 1)) AS u(i)),
d AS (SELECT r, label, base, t_words, voting, pos - place AS diagonal, list(DISTINCT place) AS places
      FROM g JOIN t ON gram = t_gram GROUP BY ALL),
i AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER near > greatest(1, t_words // 5), true) THEN 1 ELSE 0 END AS apart
      FROM d WINDOW near AS (PARTITION BY r, label, base ORDER BY diagonal)),
j AS (SELECT *, sum(apart) OVER (PARTITION BY r, label, base ORDER BY diagonal) AS island FROM i),
v AS (SELECT r, label, base, t_words, voting, island, diagonal + p AS at, p FROM (SELECT *, unnest(places) AS p FROM j)),
x AS (SELECT s.r, s.label, s.base, s.island, s.at AS first, count(DISTINCT e.p) / any_value(s.voting) AS covered
      FROM v s JOIN v e USING (r, label, base, island) WHERE e.at >= s.at AND e.at + 2 - s.at <= {WIDTH} * s.t_words GROUP BY ALL),
m AS (SELECT r, label, base, island, max(covered) AS covered, min(first) FILTER (covered = top) AS first FROM (SELECT *, max(covered) OVER (PARTITION BY r, label, base, island) AS top FROM x) GROUP BY ALL),
s AS (SELECT *, CASE WHEN base THEN covered = 1 ELSE covered >= {COVERED} END AS whole FROM m),
a AS (SELECT r, count(*) FILTER (base AND whole) AS n_base, min(first) FILTER (base AND whole) AS first_word, max(first) FILTER (base AND whole) AS last_word,
      array_to_string(list_sort(list(DISTINCT label) FILTER (base AND whole)), ',') AS base_labels,
      array_to_string(list_sort(list(DISTINCT label) FILTER (whole)), ',') AS labels, max(covered) AS score FROM s GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN a USING (r)
"""
