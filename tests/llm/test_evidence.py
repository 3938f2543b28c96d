"""Containers as evidence, windows inside islands of votes, ids at the end of their range."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_extract, license_scan, simhash

PROSE = "It was the best of times and it was the worst of times, and all of it was in the book that we have on the table for you."
ARTICLE = "<article><h1>Head</h1>" + "".join(f"<p>{PROSE} Part {i}.</p>" for i in range(4)) + "</article>"
WANT = "\n\n".join(["Head", *(f"{PROSE} Part {i}." for i in range(4))])
COMMENTS = "".join(f"<p>{PROSE} Comment {i}.</p>" for i in range(9))


@pytest.mark.parametrize("page", [
    f"<form id=aspnetForm>{ARTICLE}</form>", f'<div class="shared-layout share">{ARTICLE}</div>', f"<div role=form class='modal'><fieldset>{ARTICLE}</fieldset></div>",
    f"{ARTICLE}<div class='commentBody'>{COMMENTS}</div>", f"<form>{ARTICLE}<div id='userComments'>{COMMENTS}</div></form>", f"<aside>{ARTICLE}</aside>",
    f"<nav>{PROSE * 3}</nav>{ARTICLE}<form><p>{PROSE}</p></form>", f"<div hidden>{COMMENTS * 3}</div>{ARTICLE}", f"<div style='Display: none'><form>{COMMENTS * 3}</form></div>{ARTICLE}",
])
def test_containers_are_evidence(page):
    assert html_extract.main_text(f"<html><body><div class='pageHeader topbar'>{PROSE}</div>{page}</body></html>") == WANT


def test_pages_built_from_parts(spark):
    """All orders and wrappings of an article, forms, sections, tables, menus and comments: the article stays whole, nothing else does."""
    parts = [
        "<nav><ul><li><a href=a>Home</a></li><li><a href=b>News of the day and of the week</a></li></ul></nav>", f"<form><p>{PROSE}</p><input></form>", f"<section class=comments>{COMMENTS}</section>",
        f"<table class='ad'><tr><td>{PROSE}</td></tr></table>", f"<div class='readerComments'>{COMMENTS}</div>",
    ]
    wraps = ["{}", "<form>{}</form>", "<div class=share>{}</div>", "<table><tr><td>{}</td></tr></table>", "<section><div>{}</div></section>"]
    pages = []
    for wrap, k in itertools.product(wraps, range(3)):
        for some in itertools.combinations(parts, k):
            for at in range(k + 1):
                pages.append(wrap.format("".join([*some[:at], ARTICLE, *some[at:]])))
    rows = spark.createDataFrame([(i, "u", f"<html><body>{p}</body></html>") for i, p in enumerate(pages)], "page_id long, url string, html string")
    bad = [pages[r.page_id] for r in html_extract.extract_text(rows).collect() if r.text != WANT]
    assert not bad, bad[0]


def best_windows(words, notices):
    """label: the best share of its voting places in a window, by trying every window of every notice."""
    found = {}
    for gram, label, place, t, voting, base in license_scan.templates(notices):
        if not base:
            for at in range(len(words) - 1):
                if f"{words[at]} {words[at + 1]}" == gram:
                    found.setdefault(label, (t, voting, []))[2].append((at, place))
    made = {}
    for label, (t, voting, votes) in found.items():
        diagonals = sorted({a - p for a, p in votes})
        islands, island = {}, 0
        for d, before in zip(diagonals, [diagonals[0], *diagonals], strict=False):
            island += d - before > max(1, t // 5)
            islands[d] = island
        made[label] = max(len({p for a, p in votes if islands[a - p] == islands[s - q] and s <= a and a + 2 - s <= 1.5 * t}) / voting for s, q in votes)
    return made


def test_license_windows_against_every_window(spark):
    draw = random.Random(2)
    notice = license_scan.NOTICES["mit-text"]
    texts = [notice + " associated documentation" * 20, "associated documentation " * 20, f"{notice} x {notice}", notice.upper()]
    words = [w for n in license_scan.NOTICES.values() for w in n.split()]
    for _ in range(60):
        own = draw.choice(list(license_scan.NOTICES.values())).split()
        for _ in range(draw.randint(0, 6)):
            own.insert(draw.randrange(len(own)), draw.choice(words))
        texts.append(" ".join(own + draw.choices(words, k=draw.randint(0, 40)) + own[: draw.randint(0, len(own))]))
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert "mit-text" in got[0].labels and got[1].labels == ""
    for i, text in enumerate(texts):
        best = best_windows(text.lower().split(), license_scan.NOTICES)
        bases = {n for p, n in license_scan.BASE.items() if f" {p} " in f" {text.lower()} "}
        assert set(filter(None, got[i].labels.split(","))) == {n for n, c in best.items() if c >= license_scan.COVERED} | bases, text


def test_licenses_by_other_templates(spark):
    notices = {"own": "You may NOT use this work for training, ever; it is not for machines at all."}
    rows = spark.createDataFrame([(1, "so: you may not use this work for training ever, it is not for machines at all."), (2, license_scan.NOTICES["isc-text"])], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan_licenses(rows, notices=notices).collect()} == {1: "own", 2: ""}


def test_every_place_of_a_notice_votes(spark):
    for label, notice in license_scan.NOTICES.items():
        words = notice.split()
        assert [(g, p) for g, n, p, *_, base in license_scan.templates() if n == label and not base] == [(f"{a} {b}", i) for i, (a, b) in enumerate(itertools.pairwise(words))]
    notices = {"stops": "as is with no part of it", "two": "gnu license version 2", "three": "gnu license version 3"}
    texts = ["so it is as is with no part of it", "the gnu license version 2 is", "the gnu license version 3 is", "a gnu license version 1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(rows, notices=notices).collect()}
    assert got == {0: "stops", 1: "two", 2: "three", 3: ""}


def test_the_largest_id_is_an_id(spark):
    last, text = 2**63 - 1, "one two three four five six seven eight"
    rows = [(last, text), (None, text), (None, "other words stand here and there now"), (last, ""), (3, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df).join(df.withColumn("t", F.col("text")), "doc_id").select("doc_id", "component_id").distinct().collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(last, last), (last, 3), (3, 3)}
    assert {r.component_id for r in simhash.near_duplicates(df).where("doc_id is null").collect()} == {last, None, 3}
