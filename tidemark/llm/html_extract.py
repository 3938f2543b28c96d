"""HTML extraction: two passes of block rules.

Markup is cut into blocks at block-level tags. Pass one decides each block by the container it lies in, its link
density, its length and the share of stop words. A container named or marked as boilerplate is evidence too: where a form, or one
with a mark that layouts use as well, holds half of the page's text outside links, it counts for nothing; marks of comments, adverts,
notices and navigation do only around an article, if no text lies elsewhere; what is hidden never counts as text. Pass two lets ambiguous (mostly short) blocks take the label of the
nearest decided block of the same section, so headings and one-word paragraphs of an article stay with it. Articles are
evidence: only if they hold most of the text that pass one finds good does the page's main text lie in them alone, and
blocks there that are rich in links are ambiguous instead of bad.

Defined results: a null or empty page has an empty text. Unclosed tags, comments and raw-text elements are closed by the
end of the page. Repeated rows are extracted each for itself; other columns are ignored; an empty table stays empty.
Long pages are read whole, in one pass, by one task each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody "
    "td tfoot th thead tr ul title head".split()
)
#: Their content is no text of the page.
RAW = frozenset("script style noscript template textarea iframe svg canvas audio video title select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers that are never part of the article.
ASIDE = frozenset("nav aside footer form button dialog menu fieldset".split())
#: Tags and marks that page layouts use around articles too.
LAYOUT = frozenset("form fieldset header".split())
LAYOUT_MARKS = frozenset("share sharing social menu widget widgets overlay modal banner promo promotion related recommended skip".split())
#: What a container says against its blocks.
NOTHING, LAYOUT_ONLY, BOILERPLATE, HIDDEN = range(4)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SECTIONS = frozenset(("article", "main"))
#: Words of class and id values that mark a container as boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr banner notice "
    "notices notification alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment "
    "comments commentlist reply replies respond disqus share sharing social related recommended newsletter subscribe subscription "
    "signup login popup modal overlay widget widgets pagination pager copyright disclaimer skip".split()
)
STOP = frozenset(
    "the of and to in is that it was for on as with be by this are or an at from not have has he she they we you i a but his her its "
    "der die das und ist nicht in zu den von mit für auf im ein eine des dem es sich auch an als sie er wir "
    "le la les de des et en un une est que qui dans pour sur pas au du par avec ce il elle nous vous "
    "el los las y que es por para con una del se no lo su al como más o".split()
)
LONG, SHORT, STOPS_LOW, LINKS_HIGH, LINKS_ARTICLE = 140, 50, 0.08, 0.33, 0.9

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)", re.S)
NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])|</{t}\Z", re.I) for t in RAW}
SPACES = re.compile(r"\s+")
WORDS, CAMEL = re.compile(r"[^a-z]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")


def _apart(tag: str, attrs: str, in_section: bool) -> int:
    """What the element says against the blocks in it."""
    found = NOTHING
    if tag in ASIDE or (tag == "header" and not in_section):
        found = LAYOUT_ONLY if tag in LAYOUT else BOILERPLATE
    if not attrs or tag in ("body", "html", "article", "main"):
        return found
    for name, a, b, c in NAMES.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return HIDDEN
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return HIDDEN
        if name == "role" and value.lower() in ROLES:
            found = max(found, LAYOUT_ONLY if value.lower() == "form" else BOILERPLATE)
        if name in ("class", "id"):
            marks = MARKS.intersection(WORDS.split(CAMEL.sub(" ", value).lower()))
            if marks:
                found = max(found, LAYOUT_ONLY if marks <= LAYOUT_MARKS else BOILERPLATE)
    return found


def blocks(page: str) -> list[tuple[str, int, bool, bool, int]]:
    """(text, characters inside links, in an outside container, in an article, section number) per block, in page order."""
    found, kinds = parsed(page)
    overruled = overruled_containers(found, kinds)
    return [(text, linked, any(c not in overruled for c in inside), section, number) for text, linked, inside, section, number in found]


def overruled_containers(found: list[tuple[str, int, tuple, bool, int]], kinds: list[int]) -> set[int]:
    """Containers that hold so much of the page's text that they can't be boilerplate."""
    weights = [max(0, len(text) - linked) for text, linked, *_ in found]
    own: dict[int, int] = {}
    articles: dict[int, int] = {}
    total = 0
    for w, (_, _, inside, section, _) in zip(weights, found, strict=True):
        if w and not any(kinds[c] == HIDDEN for c in inside):
            total += w
            for c in inside:
                own[c] = own.get(c, 0) + w
                articles[c] = articles.get(c, 0) + w * section
    overruled = {c for c, w in own.items() if kinds[c] == LAYOUT_ONLY and 2 * w >= total}
    left = sum(w for w, (_, _, inside, _, _) in zip(weights, found, strict=True) if all(c in overruled for c in inside))
    if not left:
        overruled |= {c for c, w in articles.items() if kinds[c] == BOILERPLATE and 2 * w >= total}
    return overruled


def parsed(page: str) -> tuple[list[tuple[str, int, tuple, bool, int]], list[int]]:
    """The blocks (text, characters inside links, the outside containers around, in an article, section number), and what each container says."""
    out: list[tuple[str, int, tuple, bool, int]] = []
    kinds: list[int] = []
    parts: list[str] = []
    linked = 0
    open_: list[tuple[str, bool, bool]] = []  # tag, opens an outside container, opens a section
    around: list[int] = []
    sections = number = links = 0
    pos, end = 0, len(page)

    def close() -> None:
        nonlocal linked
        if parts:
            if text := SPACES.sub(" ", html.unescape("".join(parts))).strip():
                out.append((text, linked, tuple(around), sections > 0, number))
            parts.clear()
        linked = 0

    while pos < end:
        m = TOKEN.search(page, pos)
        if m is None:
            parts.append(page[pos:])
            linked += len(SPACES.sub(" ", html.unescape(page[pos:])).strip()) if links else 0
            break
        if m.start() > pos:
            parts.append(page[pos : m.start()])
            linked += len(SPACES.sub(" ", html.unescape(page[pos : m.start()])).strip()) if links else 0
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:  # comment, declaration, or a tag that the end of the page cuts
            continue
        if tag in BLOCK or tag in RAW:
            close()
        elif tag == "br":
            parts.append(" ")
        if m[1]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    for _, a, s in open_[i:]:
                        if a:
                            around.pop()
                        sections -= s
                        number += a or s
                    del open_[i:]
                    break
            if tag == "a":
                links = max(0, links - 1)
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                e = ENDS[tag].search(page, pos)
                pos = end if e is None else min(end, page.find(">", e.end() - 1) + 1 or end)
            continue
        if tag in VOID:
            continue
        if tag == "a":
            links += 1
        if tag in BLOCK or tag in ("span", "button", "label", "ins"):
            if tag in ("p", "li", "td", "tr", "dt", "dd", "option") and open_ and open_[-1][0] == tag:
                if open_.pop()[1]:
                    around.pop()
            says, s = _apart(tag, m[3], sections > 0), tag in SECTIONS
            open_.append((tag, says > 0, s))
            if says or s:
                close()
                number += 1
            if says:
                around.append(len(kinds))
                kinds.append(says)
            sections += s
    close()
    return out, kinds


def decide(text: str, linked: int, apart: bool, section: bool) -> int:
    """Pass one: 1 good, -1 bad, 0 ambiguous. In the page's article a block rich in links is bad only if it is nearly all link."""
    if apart or linked > (LINKS_ARTICLE if section else LINKS_HIGH) * len(text):
        return -1
    if linked > LINKS_HIGH * len(text):
        return 0
    if len(text) < SHORT:
        return 0
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?()\"'") in STOP for w in words) / len(words)
    if len(text) >= LONG and stops >= STOPS_LOW:
        return 1
    return 1 if stops >= 2 * STOPS_LOW else 0


def inherit(labels: list[int], groups: list) -> list[int]:
    """Pass two: each ambiguous block takes the label of its nearest decided block in its group (good at equal distance).

    A block without a decided neighbour stays.
    """
    n, out = len(labels), list(labels)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (distance, label), one for each side
    for order in (range(n), range(n - 1, -1, -1)):
        last: dict = {}
        for i in order:
            if labels[i]:
                last[groups[i]] = i
            elif (j := last.get(groups[i])) is not None:
                near[i].append((abs(i - j), labels[j]))
    for i in range(n):
        if not labels[i]:
            out[i] = -min(((d, -x) for d, x in near[i]), default=(0, -1))[1]
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    first = [decide(t, n, a, False) for t, n, a, _, _ in found]
    # what is decided good, or where nothing is, what is not bad
    weights = [len(x[0]) * (d > 0) for x, d in zip(found, first, strict=True)]
    if not any(weights):
        weights = [len(x[0]) * (d == 0) for x, d in zip(found, first, strict=True)]
    inside = sum(w for w, x in zip(weights, found, strict=True) if x[3])
    whole = any(s and not a for _, _, a, s, _ in found) and 2 * inside >= sum(weights)
    if whole:  # the articles hold the main text
        found = [x for x in found if x[3]]
        first = [decide(t, n, a, True) for t, n, a, _, _ in found]
    labels = inherit(first, [0 if whole and not a else k + 1 for _, _, a, _, k in found])
    return "\n\n".join(x[0] for x, label in zip(found, labels, strict=True) if label > 0)


@F.pandas_udf(T.StringType())
def _main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(main_text)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text (empty if none), n_chars (code points of text)."""
    small_batches(pages.sparkSession)
    return pages.select(
        F.col(f"`{id_col}`").alias(id_col),
        F.col(f"`{url_col}`").alias(url_col),
        _main_text(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))).alias("text"),
    ).withColumn("n_chars", F.length("text").cast("long"))
