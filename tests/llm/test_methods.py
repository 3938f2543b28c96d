"""The operators against brute force, exact round trips and held-out labels."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import spark_rows, sql_rows
from tidemark.llm import decontaminate, fingerprints, html_extract, id_codec, lm_score, packing, quality, simhash, token_files, tokens
from tidemark.llm import queries as llm
from tidemark.llm.components import connected_components


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_agrees_with_sql(spark, sf, name):
    assert spark_rows(llm.queries()[name](spark, sf)) == sql_rows(llm.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", ["op1_license_scan", "op4_fingerprints"])
def test_native_queries_run_no_python(spark, sf, name):
    plan = llm.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def union_find(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(nodes):
        for y in nodes[:i]:
            if linked(x, y):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_simhash_agrees_with_brute_force(spark, sf, texts):
    got = {r.doc_id: r for r in llm.op7_simhash_dedup(spark, sf).collect()}
    bits = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in parts]
        bits[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    roots = union_find(sorted(texts), lambda x, y: (bits[x] ^ bits[y]).bit_count() <= 4)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{bits[d]:016x}", roots[d]) for d in texts}


@pytest.mark.parametrize("radius", range(1, 7))
def test_masks_cover_every_pair_within_the_radius(radius):
    made = [int(m) for m in simhash.masks(radius)]
    rng = random.Random(radius)
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not flips & m for m in made)
    assert sum(m.bit_count() >= 31 for m in made) == len(made)


@pytest.mark.parametrize("block", [1024, 8])
def test_large_buckets_lose_no_link(spark, block):
    rng = np.random.default_rng(0)
    found = set()
    for base in rng.integers(0, 2**63, 4):
        for _ in range(60):
            x = int(base)
            for i in rng.choice(63, rng.integers(0, 5), replace=False):
                x ^= 1 << int(i)
            found.add(x)
    fps = sorted(found)
    df = spark.createDataFrame(list(enumerate(fps)), "_id long, fp long")
    want = union_find(list(range(len(fps))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert {r._id: r.component_id for r in simhash.label(df, 4, block).collect()} == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_stage_drops_near_copies_and_keeps_the_rest(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows, near = [], []
    for i in range(60):
        own = text(200)
        rows.append((i, " ".join(own)))
        copy = list(own)
        for _ in range(2):
            copy[rng.randrange(200)] = rng.choice(words)
        rows.append((1000 + i, " ".join(copy)))
        near.append(1000 + i)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(60)) <= kept and len(kept & set(near)) <= 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=20))
def test_packing_places_every_piece_once_without_gaps(histogram):
    plans = packing.plan(histogram, 60)
    used = Counter()
    for filling, times in plans:
        assert sum(filling) <= 60
        for x in filling:
            used[x] += times
    assert used == Counter(histogram)
    rooms = []  # first fit, longest first
    for x in sorted(Counter(histogram).elements(), reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= x), None)
        if at is None:
            rooms.append(60 - x)
        else:
            rooms[at] -= x
    assert -(-sum(k * v for k, v in histogram.items()) // 60) <= sum(t for _, t in plans) <= len(rooms) + 1
    spots = packing.places(plans)
    assert all(len(first) and first[0] == 0 for first, _, _ in spots.values())


def test_packing_query(spark, sf, texts, tokenizer):
    rows = llm.op2_packing(spark, sf).collect()
    want = {}
    for d, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[d, k // 4096] = (k, len(part), __import__("zlib").crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in by.values():
        spots.sort()
        assert spots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:], strict=False)) and sum(spots[-1]) <= 4096
    assert len(by) <= -(-sum(r.length for r in rows) // 4096) * 1.02 + 1


def test_decontamination_finds_exact_and_edited_passages(spark, sf, documents):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rng = random.Random(0)
    rows, want = [], set()
    for i, t in list(items.items())[:20]:
        plain = decontaminate.normal(t)
        edited = list(plain)
        budget = int(decontaminate.ERRORS * len(plain))
        for _ in range(budget):
            at = rng.randrange(len(edited))
            edited[at : at + 1] = rng.choice([[], ["z"], [edited[at], "q"]])
        rows.append((i, "before words " + "".join(edited) + " AFTER words"))
        want.add((i, i))
        rows.append((100 + i, plain[: len(plain) // 2]))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert want <= got and not {d for d, _ in got if d >= 100}
    exact = {(r.doc_id, i) for r in documents.collect() for i, t in items.items() if decontaminate.normal(t) in decontaminate.normal(r.text)}
    assert exact <= {(r.doc_id, r.item_id) for r in llm.op3_decontaminate(spark, sf).collect()}


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=20))
def test_myers_is_the_edit_distance_to_any_passage(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        now = [i + 1]
        for j, d in enumerate(text):
            now.append(min(row[j] + (c != d), row[j + 1] + 1, now[j] + 1))
        row = now
    assert decontaminate.myers(item, text)[0] == min(row)


def test_fingerprints(spark, sf, texts):
    got = {r.doc_id: r for r in llm.op4_fingerprints(spark, sf).collect()}
    ids = sorted(texts)

    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    off = []
    for i, d in enumerate(ids):
        t, following = texts[d], texts[ids[(i + 1) % len(ids)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, got[d].near_edited), (following, got[d].near_next)):
            a, b = shingles(t), shingles(other)
            off.append(abs((len(a & b) / len(a | b) if a | b else 1.0) - near))
    assert max(off) < 0.2 and sum(off) / len(off) < 0.03


def test_sketches_of_parts_merge_into_that_of_the_whole(spark):
    rows = [(k, " ".join(f"w{k}_{i}" for i in range(s, s + 400))) for k in range(3) for s in (0, 396, 792)]
    parts = spark.createDataFrame(rows, "k long, text string").select("k", fingerprints.sketch(F.col("text")).alias("sketch"))
    whole = spark.createDataFrame([(k, " ".join(f"w{k}_{i}" for i in range(1192))) for k in range(3)], "k long, text string").select("k", fingerprints.sketch(F.col("text")).alias("w"))
    for r in fingerprints.merge_sketches(parts, "k").join(whole, "k").collect():
        assert r.sketch == r.w
    n = whole.select(fingerprints.distinct_shingles(F.col("w")).alias("n")).collect()
    assert all(abs(r.n - 1188) < 350 for r in n)


def test_lm_scores_agree_with_brute_force(spark, sf, texts):
    labels = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    words = {w for t in texts.values() for w in t.lower().split()} | {"<s>", "</s>"}
    share = lm_score.VOCABULARY_SHARE
    size = share * sum((xxhash.xxh64_intdigest(w.encode(), 7) >> 3) % share == 0 for w in words)
    want = lm_score.brute_force(texts, labels, float(size))
    for r in llm.op5_lm_score(spark, sf).collect():
        assert (r.n_tokens, r.target_loss, r.background_loss) == pytest.approx(want[r.doc_id], abs=1e-6)


def test_lm_scores_tell_the_target_from_the_rest(spark):
    rng = random.Random(1)
    make = lambda w: " ".join(rng.choice(w) for _ in range(60))
    rows = [(i, make("red green blue black".split() if i % 2 else "one two three four".split())) for i in range(60)]
    target = spark.createDataFrame([(i,) for i in range(1, 40, 2)], "doc_id long")
    got = {r.doc_id: r.score for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), target).collect()}
    assert max(got[i] for i in range(41, 60, 2)) < min(got[i] for i in range(40, 60, 2))


def test_quality_agrees_with_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = llm.op6_quality(spark, sf).join(labels, "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_em_finds_the_better_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.7
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) for a in (0.95, 0.9, 0.85, 0.6)], axis=1) * 2 - 1
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, chance, prior = quality.estimate(patterns, counts.astype(float))
    right = chance[1, :, 2] / (chance[1, :, 0] + chance[1, :, 2])
    assert abs(prior - 0.7) < 0.05 and list(np.argsort(-right)) == [0, 1, 2, 3] and abs(right[0] - 0.95) < 0.03


def test_encoder_gives_the_librarys_ids(tokenizer):
    own = tokens.Encoder(tokens.vocabulary_path())
    rng = random.Random(1)
    odd = ["It's THEY'LL ''s 's'", "<|endoftext|> x<|startoftext|>y", "İstanbul ΣΑΣ", "é x\u0301y", "½²³ ªº", "日本語 12345 ...!!?", "a\x1cb", "\u00a0x\u2003y\u0085z", "ß ẞ Ⱥ", "", "   ", "x" * 5000]
    odd += ["".join(rng.choice("aAZ'séÉİΣß0½ \n.,!<|>\u0301日\u200d") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t in odd:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_encoder_knows_every_plain_character(tokenizer):
    own = tokens.Encoder(tokens.vocabulary_path())
    texts = [f"ab{chr(c)}c 1{chr(c)}x {chr(c)}" for c in range(1, 0x300)]
    for t, got in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_encoder_forgets_without_losing_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 50)
    monkeypatch.setattr(tokens, "AT_ONCE", 300)
    own = tokens.Encoder(tokens.vocabulary_path())
    rng = random.Random(2)
    texts = [None, "", *("".join(rng.choice("abAé's .,1\x1c") for _ in range(rng.randint(0, 120))) for _ in range(400))]
    for t, got in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_encoder_cuts_words_with_a_sign_without_the_pieces_expression(tokenizer, monkeypatch):
    cut, replace = [], tokens.pc.replace_substring_regex
    monkeypatch.setattr(tokens.pc, "replace_substring_regex", lambda parts, *a, **k: (cut.extend(parts.to_pylist()), replace(parts, *a, **k))[1])
    own, text = tokens.Encoder(tokens.vocabulary_path()), "Words, and straße. Über? it's 12"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert cut == ["über?", "it's", "12"]


def test_encoders_memory_is_bounded_in_characters_too(tokenizer):
    own = tokens.Encoder(tokens.vocabulary_path(), held=100, at_once=20_000)
    texts = ["".join(rng.choice("abc") for _ in range(5000)) for rng in map(random.Random, range(80))]
    for t, got in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert sum(map(len, own.met)) < 60_000  # 400,000 characters went through


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=60), max_size=8), st.integers(1, 40))
def test_segments_round_trip(documents, block):
    ids = np.array([x for d in documents for x in d], dtype="<u4")
    data = id_codec.encode_segment(list(range(len(documents))), [len(d) for d in documents], ids, block)
    docs, lengths, back = id_codec.decode_segment(data)
    assert docs == list(range(len(documents))) and lengths.tolist() == [len(d) for d in documents] and back.tolist() == ids.tolist()


def test_damaged_segments_are_noticed():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.5, 9000) % 60000).astype("<u4")
    data = id_codec.encode_segment([1, None], [4000, 5000], ids)
    assert id_codec.decode_segment(data)[2].tolist() == ids.tolist() and len(data) < 2 * len(ids)
    for at in (6, 30, len(data) // 2, len(data) - 400):
        broken = bytearray(data)
        broken[at] ^= 0x40
        with pytest.raises(ValueError):
            id_codec.decode_segment(bytes(broken))


def test_token_files(spark, sf, texts, tokenizer):
    start = 0
    for r in sorted(token_files.round_trip(spark.read.parquet(f"{sf}/documents.parquet")).collect(), key=lambda r: r.doc_id):
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), __import__("zlib").crc32(ids.tobytes()))
        start += len(ids)


PAGE = """<html><head><title>t</title><script>var a="</p><p>no";</script></head><body><header><p>Site header that is long enough to be a block of the text</p></header>
<div class="cookie-notice"><p>We use cookies and the rest of it is in the notice for you.</p></div><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="content"><h2>Short head</h2><p>It was the best of times and it was the worst of times, and all of it was in the book that we have on the table for you.</p>
<p>Tiny.</p><p>The end of it is that the man &amp; the dog went to the house&nbsp;of the king, and they were not seen again by anyone in the land.</p></div>
<aside><p>Read also the other story that is on the page with the most of readers</p></aside><form><p>Name of the user is to be put in this field here</p></form>
<div id="comments"><p>I am of the view that this is the best of all of the stories that I have read</p></div><footer>(c) the owner of the site is the one</footer></body></html>"""


def test_pages_without_an_article_are_cut_by_block_rules():
    got = html_extract.main_text(PAGE).split("\n\n")
    assert got[0] == "Short head" and got[2] == "Tiny." and got[3].startswith("The end of it is that the man & the dog") and len(got) == 4


def test_articles_of_the_test_pages_are_whole(spark, sf):
    import html

    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r.text for r in llm.op9_html_extract(spark, sf).collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", p))).strip() for p in re.split(r"</?(?:h1|p)>|<br>", body))
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


def test_every_low_character_is_coded_as_by_the_library(tokenizer):
    texts = ["a" + chr(i) + "B" + chr(i) for i in range(1, 0x2100)]
    for t, got in zip(texts, tokens.Encoder(tokens.vocabulary_path()).encode_all(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
