import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def edited_texts():
    """Texts with an appended block, a replaced block or scattered words, at similarities of about 0.7 to 1."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (60, 200, 700):
        for kind in ("append", "replace", "scatter"):
            for share in (0.04, 0.08, 0.1, 0.12, 0.15, 0.18, 0.22, 0.26, 0.3):
                base = rng.choices(vocabulary, k=n)
                made, k = list(base), max(1, round(n * share))
                if kind == "append":
                    made += rng.choices(vocabulary, k=k)
                elif kind == "replace":
                    at = rng.randrange(n - k)
                    made[at : at + k // 2] = rng.choices(vocabulary, k=k // 2)
                else:
                    for at in rng.sample(range(n), max(1, k // 10)):
                        made[at] = rng.choice(vocabulary)
                texts += [" ".join(base), " ".join(made)]
    return texts


def brute_force(texts):
    """Places that stay: the first of each component of links with a similarity of 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return set(root), sets


def test_block_and_scattered_edits_link_as_brute_force_says(spark):
    texts = edited_texts()
    want, sets = brute_force(texts)
    near = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(0.8 <= x < 0.9 for x in near) > 10 and sum(0.7 <= x < 0.8 for x in near) > 5
    got = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("group", [4, 1024])
def test_shares_of_a_large_band_find_the_same_links(spark, group, monkeypatch):
    rng = random.Random(6)
    base = rng.choices("abcdefghijklmnopqrstuvwxyz", k=120)
    texts = []
    for _ in range(40):
        made = list(base)
        for at in rng.sample(range(120), rng.randrange(4)):
            made[at] = f"x{rng.randrange(9)}"
        texts.append(" ".join(made))
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (group,))
    got = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute_force(texts)[0]


def test_one_large_group_of_near_fingerprints_is_contracted(spark):
    """20,000 fingerprints within a few bits of one another: about as many links as nodes and tasks, one component."""
    import numpy as np

    rng = np.random.default_rng(1)
    base, fps = 0x123456789ABCDEF0, set()
    while len(fps) < 20_000:
        x = base
        for i in rng.choice(40, 4, replace=False):
            x ^= 1 << int(i)
        fps.add(x)
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(sorted(fps))], "fp long, own long").repartition(4)
    links = simhash.near_links(nodes, 4).count()
    assert links < 6 * len(fps)
    rows = nodes.select(nodes.own.alias("_id"), "fp")
    assert {r.component_id for r in simhash.label(rows, 4).collect()} == {0}


def test_components_of_a_hub_with_very_many_neighbours(spark):
    from tidemark.llm.components import connected_components

    edges = spark.range(1, 30_000).selectExpr("0L a", "id b").union(spark.range(1, 5_000).selectExpr("id + 30000 a", "id b"))
    assert {r.root for r in connected_components(edges).collect()} == {0}


def test_the_pipeline_keeps_the_first_of_each_simhash_component(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id % 7 = 0").selectExpr("doc_id + 1000000 as doc_id", "concat(text, ' one more word') as text"))
    linked = simhash.near_duplicates(docs).collect()
    got = sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, sf).collect())
    assert got == sorted({r.component_id for r in linked}) and len(got) < len(linked)


def test_rows_of_an_explode_are_never_broadcast(spark):
    """Spark sizes them as if they were as many as before it, here 0.5 MB for 15 MB."""
    nodes = spark.range(0, 20_000, numPartitions=4).select(F.xxhash64("id").alias("fp"), F.col("id").alias("own"))
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("own") % 5_000) for t in range(31)])
    rows = nodes.repartition(4).select("fp", "own", F.explode(keys).alias("k"))
    met = simhash._with_others(rows, 31 * 20_000).agg(F.count("*").alias("rows"), F.max("n").alias("n"))
    assert met.first().asDict() == {"rows": 31 * 20_000, "n": 4}
    met.collect()
    plan = met._jdf.queryExecution().executedPlan().toString()  # as it ran
    assert "SortMergeJoin" in plan and "BuildLeft" not in plan
