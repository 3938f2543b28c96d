"""Cases in which an operator once did less than its whole job."""

from collections import Counter

import pytest

from tidemark.llm import html_extract, lm_score, packing, quality

PROSE = "It was the best of times and it was the worst of times, and all of it was in the book that we have on the table for you."


def test_lm_vocabulary_is_every_word_of_the_texts(spark):
    texts = {0: "a b", 1: "b c a", 2: "", 3: "c c d"}
    words = {w for t in texts.values() for w in t.split()} | {"<s>", "</s>"}
    want = lm_score.brute_force(texts, {0, 3}, float(len(words)))
    target = spark.createDataFrame([(0,), (3,)], "doc_id long")
    for r in lm_score.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), target).collect():
        assert (r.n_tokens, r.target_loss, r.background_loss) == pytest.approx(want[r.doc_id], abs=1e-6)


def test_lm_vocabulary_of_a_table_is_not_sampled(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()}
    words = {w for t in texts.values() for w in t.lower().split()} | {"<s>", "</s>"}
    target = set(sorted(texts)[:20])
    want = lm_score.brute_force(texts, target, float(len(words)))
    rows = lm_score.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.target_loss, r.background_loss) == pytest.approx(want[r.doc_id], abs=1e-6)


def test_body_in_a_div_is_kept_beside_article_teasers():
    body = "".join(f"<p>{PROSE} Part {i} of it.</p>" for i in range(8))
    teasers = "".join(f"<article><h3>Other story {i}</h3><p>It is the news of the day for you.</p></article>" for i in range(3))
    got = html_extract.main_text(f"<html><body><div class=content><h1>Head</h1>{body}</div><div>{teasers}</div></body></html>").split("\n\n")
    assert got[0] == "Head" and [f"{PROSE} Part {i} of it." for i in range(8)] == got[1:9]


def test_block_rules_decide_inside_an_article_too():
    links = "".join(f'<p><a href=x>{"Story of the day number " + str(i)}</a> and more</p>' for i in range(4))
    page = f"<article><h1>Head</h1><p>{PROSE}</p><p>Tiny.</p><p>{PROSE}</p><p><a href=x>All link</a></p>{links}<p><a href=x>All link</a></p></article><p>{PROSE} Outside.</p>"
    assert html_extract.main_text(page).split("\n\n") == ["Head", PROSE, "Tiny.", PROSE]


def test_packing_many_one_token_pieces_beside_long_ones():
    plans = packing.plan({2100: 3000, 1: 1500})
    used = Counter()
    for filling, times in plans:
        assert sum(filling) <= 4096
        for x in filling:
            used[x] += times
    assert used == {2100: 3000, 1: 1500} and sum(t for _, t in plans) == 3000


def test_packing_search_finds_two_pieces_that_fill_better_than_one():
    assert sorted(packing.fill([2, 8, 9], {2: 1, 8: 1, 9: 1}, 10)) == [2, 8]


def test_quality_samples_rows_without_an_id_like_any_other(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows: seen.append(len(rows)) or quality.np.zeros(quality.FEATURES))
    rows = [(None, f"{PROSE} It is part {i} of the whole.") for i in range(9000)]
    quality.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert seen == [quality.SAMPLE]


def test_a_head_without_an_end_does_not_swallow_the_page():
    page = f"<html><head><title>t</title><meta charset=utf-8><body><article><p>{PROSE}</p><p>With <math><mi>x</mi></math> in it.</p></article>"
    assert html_extract.main_text(page) == f"{PROSE}\n\nWith x in it."


def test_link_density_counts_characters_not_markup():
    page = f"<div><p>{PROSE} <a href=x>{'&amp;' * 9}</a></p></div>"
    assert html_extract.main_text(page).startswith(PROSE)


def brute_force_text(page):
    """The block rules again, on pages of p, h1 and a elements only: neighbours are searched for block by block."""
    import html
    import re

    found, apart = [], 0
    for tag, text in re.findall(r"<(/?(?:nav|footer|div|p|h1))[^>]*>([^<]*(?:<a[^>]*>[^<]*</a>[^<]*)*)", page):
        apart += (tag in ("nav", "footer")) - (tag in ("/nav", "/footer"))
        plain = re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", text))).strip()
        if plain:
            links = sum(len(html.unescape(x).strip()) for x in re.findall(r"<a[^>]*>([^<]*)</a>", text))
            words = plain.lower().split()
            stops = sum(w.strip(".,;:!?()\"'") in html_extract.STOP for w in words) / len(words)
            good = len(plain) >= 50 and stops >= (0.08 if len(plain) >= 140 else 0.16)
            found.append((plain, apart, -1 if apart or links > 0.33 * len(plain) else int(good)))
    kept = []
    for i, (plain, group, mark) in enumerate(found):
        if not mark:
            near = [(abs(i - j), -m) for j, (_, g, m) in enumerate(found) if m and g == group]
            mark = -min(near)[1] if near else 1
        kept += [plain] * (mark > 0)
    return "\n\n".join(kept)


def test_block_rules_agree_with_brute_force_on_pages_without_articles():
    import random

    rng = random.Random(8)
    kinds = [PROSE, PROSE[:60], "Tiny.", "Short head", "the of and to in is", "<a href=x>All link of a block here</a>", f'{PROSE} <a href=x>more</a>', "word " * 40, "<a href=x>One</a> and <a href=y>two of the links</a> on it"]
    for _ in range(300):
        body = "".join(f"<p>{rng.choice(kinds)}</p>" for _ in range(rng.randint(1, 12)))
        page = f"<html><body><nav><p>Menu of the site</p></nav><div>{body}</div><footer><p>{PROSE}</p></footer></body></html>"
        assert html_extract.main_text(page) == brute_force_text(page)


def test_coded_ids_are_smaller_than_deflated_ones(spark, sf):
    import zlib

    import numpy as np

    from tidemark.llm import id_codec, tokens

    own = tokens.encoder(tokens.vocabulary_path())
    ids = np.frombuffer(b"".join(own.encode(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()), "<u4")
    coded = id_codec.encode_segment([1], [len(ids)], ids)
    assert id_codec.decode_segment(coded)[2].tolist() == ids.tolist()
    assert len(coded) < 0.95 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))
