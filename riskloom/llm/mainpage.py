"""Main text of web pages by a maximum-scoring run of words and tags.

A page is a sequence of words and tags. Words score one, tags score below
zero, the more so the more often they stand outside the article on labelled
pages. The best contiguous run, found in one linear scan, is the content
region, and is taken to the bounds of the article or the part of the page that
holds it. Words of menus, adverts and the like score nothing and are left out
of the region. Pages that mark their article themselves are the labelled ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import sliced

# Kinds of elements, and words in class, id or role that mark what is no article.
BLOCKS = set(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACES = {"br", "td", "th", "img", "wbr"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
APART = set(
    "nav header footer aside form head title noscript template iframe object svg canvas button select option textarea label menu "
    "dialog".split()
)
INLINE = set("a abbr b cite code em i q s small span strong sub sup time u".split())
MARKS = set(
    "ad ads adbox advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert newsletter subscribe signup popup modal overlay share sharing social sidebar menu menubar nav navbar "
    "navigation topnav breadcrumb breadcrumbs footer header masthead related recommended widget login search toolbar "
    "pagination pager complementary contentinfo dialog".split()
)
COMMENTS = set("comment comments commenter commenters reply replies respond responses disqus discussion discussions".split())
#: Parts of names that say what an element has or has not, and those of an article's own parts.
STATES = set("has have no not with without is in work works".split())
OWN = set("article post entry story content page main".split())
HOLDERS = {"article", "main", "section", "div"}
FLOW = set("h1 h2 h3 h4 h5 h6 p table blockquote pre figure dl ul ol hr".split())
TAG = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|$)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|$)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
KNOWN = BLOCKS | SPACES | VOID | APART | INLINE
OTHER = "other"
LEAST_COST, MOST_COST = 0.05, 2.0


def marked(attributes: str, within: bool = False) -> int:
    """2 if a name in class, id or role is that of no article, 1 if only a part of one is, else 0.

    Readers' comments are 2 whatever stands beside them in a name. ``within``
    an article a header is the article's own.
    """
    if "=" not in attributes:
        return 0
    most = 0
    for name in " ".join("".join(found) for found in NAMED.findall(attributes)).lower().split():
        parts = set(filter(None, re.split(r"[^a-z]+", name)))
        marks = parts & (MARKS | COMMENTS)
        if not marks or parts & STATES or marks == {"header"} and (within or parts & OWN):
            continue
        most = max(most, 2 if marks == parts or parts & COMMENTS else 1)
    return most


def pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """(tag name or empty, end mark, attributes or text) in page order."""
    at = 0
    for found in TAG.finditer(html):
        if found.start() > at:
            yield "", "", html[at : found.start()]
        at = found.end()
        closing, name, attributes = (found.group(2), found.group(3), found.group(4)) if found.group(3) else found.group(5, 6, 7)
        if name:
            yield name.lower(), closing, attributes
    if at < len(html):
        yield "", "", html[at:]


def tokens(html: str, apart_at: frozenset[int] = frozenset(), doubtful: list[int] | None = None) -> Iterator[tuple[str, str, bool]]:
    """(tag name or empty, end mark or text, apart) in page order.

    ``apart`` holds within elements that are no article. Such an element ends
    with its end tag, with the next block if it is a paragraph or item, and at
    the latest where an article, main part or body begins. Elements with a
    mark in a part of their name go to ``doubtful`` by their place, and are
    apart if that is among ``apart_at``.
    """
    apart, depth, articles = "", 0, 0
    for k, (name, closing, rest) in enumerate(pieces(html)):
        if not name:
            yield "", rest, bool(apart)
            continue
        if name in ("article", "main"):
            articles = max(0, articles + (-1 if closing else 1))
        if apart:
            if not closing and (name in ("article", "main", "body") or apart in ("p", "li") and name in BLOCKS):
                apart = ""
            elif name == apart:
                depth += -1 if closing else 1
                if not depth:
                    apart = ""
                    yield name, "/", True
                    continue
        if not apart and not closing and name not in VOID:
            own = name == "header" and articles
            mark = 0 if own or name in ("body", "html", "article", "main") else marked(rest, articles > 0)
            if mark == 1 and doubtful is not None:
                doubtful.append(k)
            if (name in APART and not own) or mark == 2 or k in apart_at:
                apart, depth = name, 1
        yield name, closing, bool(apart)


def tag_counts(html: str) -> Counter:
    """How often words ("") and tags stand inside and outside the article, if the page marks one."""
    counts, inside, articles = Counter(), 0, 0
    for name, text, _ in tokens(html):
        if name == "article":
            articles += not text
            inside = max(0, inside + (-1 if text else 1))
            counts[name, False] += 1
        elif name:
            counts[name if name in KNOWN else OTHER, inside > 0] += 1
        else:
            counts["", inside > 0] += len(text.split())
    return counts if articles == 1 else Counter()


def costs_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Cost of each tag: little where it is common inside articles, more the more it stands outside."""
    inside = sum(n for (name, within), n in counts.items() if within and name)
    outside = sum(n for (name, within), n in counts.items() if not within and name)
    costs = {}
    for name in KNOWN | {OTHER}:
        a, b = counts.get((name, True), 0), counts.get((name, False), 0)
        odds = math.log((b + 0.5) / (outside + 1)) - math.log((a + 0.5) / (inside + 1))
        costs[name] = min(MOST_COST, LEAST_COST + max(0.0, odds)) if a + b else (LEAST_COST if name in INLINE else 1.0)
    return costs


def spans(parts: list[tuple[str, str, bool]]) -> list[tuple[int, int, str]]:
    """(place of the first tag, place after the last one, name) of all elements."""
    found, open_, many = [], [], Counter()
    for k, (name, text, _) in enumerate(parts):
        if not name or name in VOID:
            continue
        if not text:
            open_.append((k, name))
            many[name] += 1
        elif many[name]:
            while open_:
                start, other = open_.pop()
                many[other] -= 1
                found.append((start, k + (name == other), other))
                if other == name:
                    break
    return found + [(start, len(parts), name) for start, name in open_]


def widened(parts: list[tuple[str, str, bool]], first: int, last: int) -> tuple[int, int]:
    """The run to the bounds of its article, or of the part that holds it.

    Directly in the body, it is carried on over headings, paragraphs, tables
    and the like beside it, and over lists after it.
    """
    elements = spans(parts)
    around = sorted((b - a, a, b, name) for a, b, name in elements if a < first and b >= last and name in HOLDERS)
    for _, a, b, name in [x for x in around if x[3] in ("article", "main")] or around:
        return a, b
    inner = [(a, b) for a, b, name in elements if name not in ("body", "html") and name not in HOLDERS]
    first = min([first, *(a for a, b in inner if a < first < b)])
    last = max([last, *(b for a, b in inner if a < last < b)])
    after = {a: b for a, b, name in elements if name in FLOW}
    before = {b: a for a, b, name in elements if name in FLOW - {"ul", "ol"}}
    plain = lambda k: not parts[k][0] or parts[k][0] in INLINE or parts[k][0] in ("br", "hr", "img")
    while last < len(parts) and (last in after or plain(last)):
        last = after.get(last, last + 1)
    while first > 0 and (first in before or plain(first - 1)):
        first = before.get(first, first - 1)
    return first, last


def best_run(parts: list[tuple[str, str, bool]], costs: dict[str, float]) -> tuple[int, int]:
    """(first, end) of the contiguous run with the most words less costs of tags, the first of equals; empty without words."""
    best, found, score, start = 0.0, (0, 0), 0.0, 0
    for k, (name, text, apart) in enumerate(parts):
        if name:
            score -= costs.get(name, costs[OTHER])
        elif not apart:
            score += len(text.split())
        if score > best:
            best, found = score, (start, k + 1)
        if score <= 0:
            score, start = 0.0, k + 1
    return found


def beside(parts: list[tuple[str, str, bool]], run: tuple[int, int], doubtful: list[int]) -> frozenset[int]:
    """The doubtful elements that do not hold most words of the run: a wrapper of the article does, a side part does not."""
    counts = [0]
    for k, (name, text, apart) in enumerate(parts):
        inside = run[0] <= k < run[1] and not name and not apart
        counts.append(counts[-1] + (len(text.split()) if inside else 0))
    ends = {a: b for a, b, _ in spans(parts)}
    return frozenset(k for k in doubtful if 2 * (counts[ends.get(k, k)] - counts[k]) <= counts[-1])


def extract(html: str, costs: dict[str, float]) -> str:
    """Text of the best run and of what holds it, one line per block; empty if the page has no words.

    Elements in doubt are left in for a first run, which tells what they hold.
    """
    doubtful: list[int] = []
    parts = list(tokens(html, doubtful=doubtful))
    run = best_run(parts, costs)
    if doubtful and (apart_at := beside(parts, run, doubtful)):
        parts = list(tokens(html, apart_at))
        run = best_run(parts, costs)
    if run[0] == run[1]:
        return ""
    best_from, best_to = widened(parts, *run)
    blocks, block = [], []
    for name, text, apart in parts[best_from:best_to]:
        if name in BLOCKS:
            blocks.append("".join(block))
            block = []
        elif name in SPACES:
            block.append(" ")
        elif not name and not apart:
            block.append(unescape(text))
    blocks.append("".join(block))
    lines = (" ".join(block.split()) for block in blocks)
    return "\n".join(line for line in lines if line)


def fit_costs(pages: DataFrame, html: str = "html") -> dict[str, float]:
    """Tag costs from all pages that mark one article; a row per known tag and side reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for page in batch.column(html).to_pylist():
                total.update(tag_counts(page or ""))
        rows = [{"tag": tag, "inside": inside, "n": n} for (tag, inside), n in total.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("tag", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))

    counts = pages.select(html).mapInArrow(count, "tag string, inside boolean, n long")
    rows = counts.groupBy("tag", "inside").agg(F.sum("n").alias("n")).collect()
    return costs_of({(r["tag"], r["inside"]): r["n"] for r in rows})


def main_texts(
    pages: DataFrame, costs: dict[str, float] | None = None, html: str = "html", output: str = "_text"
) -> DataFrame:
    """``pages`` without ``html``, with ``output``: the main text of each page, in place of a column of that name.

    Null and empty pages, and pages without words, have an empty text. Every
    row is kept, repeated or not. Without labelled pages all tags but inline
    ones cost one.
    """
    costs = costs or fit_costs(pages, html)
    others = [c for c in pages.columns if c not in (html, output)]
    schema = pages.select(*[F.col(f"`{c}`") for c in others], F.lit("").alias(output)).schema

    def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, html):
            found = [extract(page or "", costs) for page in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(found, pa.string())], [*others, output])

    return pages.select(*[F.col(f"`{c}`") for c in others], html).mapInArrow(extract_batches, schema)
