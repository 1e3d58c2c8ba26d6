"""Main text: readers' comments, parts in doubt, the best run beside brute force, long bad markup."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from riskloom.llm import mainpage

WORDS = "<p>Many words in a long paragraph of a page that has something to say.</p>" * 5
PAGE = '<html><body><nav><a href="/">Home</a></nav>{}<footer>us</footer></body></html>'
COMMENT = "<p>A reader says a lot of things about this page, and goes on and on.</p>" * 8


@pytest.mark.parametrize("name", ["reader-comments", "post-comments", "discussion", "comments", "article-replies", "disqus_thread"])
def test_comments_are_left_out_whatever_their_size(name):
    costs = mainpage.costs_of({})
    comments = f'<div class="{name}">{COMMENT}</div>'
    for body in (f"<article><h1>It</h1>{WORDS}</article>{comments}", f"<article><h1>It</h1>{WORDS}{comments}</article>", f'<div id="content"><h1>It</h1>{WORDS}{comments}</div>'):
        text = mainpage.extract(PAGE.format(body), costs)
        assert text.startswith("It\nMany words") and text.count("\n") == 5 and "reader" not in text


def test_parts_in_doubt():
    costs = mainpage.costs_of({})
    side = '<div class="left-sidebar"><p>Some other things to look at here, quite a few of them.</p></div>'
    for body in (f'<div class="page-banner">{WORDS}</div>{side}', f'<div class="layout-sidebar"><div>{WORDS}</div></div>{side}', f"{side}<div>{WORDS}</div>"):
        text = mainpage.extract(PAGE.format(body), costs)
        assert text.count("Many words") == 5 and "other things" not in text


def test_text_fields_are_left_out():
    text = mainpage.extract(PAGE.format(f"<div>{WORDS}<textarea>typed by someone</textarea></div>"), mainpage.costs_of({}))
    assert text.count("Many words") == 5 and "typed" not in text


def test_best_run_equals_all_runs_tried():
    rng = random.Random(4)
    costs = {"b": 0.4, "div": 1.0, "p": 2.0, mainpage.OTHER: 1.5}
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(25)):
            name = rng.choice(["", "", "b", "div", "p", "zz"])
            parts.append((name, " ".join("w" * rng.randrange(4)) if not name else "", rng.random() < 0.2))
        worth = [-costs.get(n, 1.5) if n else 0 if apart else len(t.split()) for n, t, apart in parts]
        first, end = mainpage.best_run(parts, costs)
        most = max((sum(worth[a:b]) for a in range(len(parts)) for b in range(a, len(parts) + 1)), default=0)
        assert sum(worth[first:end]) == pytest.approx(max(most, 0))


@pytest.mark.parametrize("part", ["</div>", "<div>", "</p><p>", "<a href='x'>", "<b", "<!--", "<script>", "<div class='left-sidebar'>x"])
def test_bad_markup_takes_time_in_proportion(part):
    started = time.time()
    mainpage.extract(part * (500_000 // len(part)), mainpage.costs_of({}))
    assert time.time() - started < 10


def test_pages_without_their_article_tags_give_the_same_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    costs = mainpage.fit_costs(pages.filter("page_id % 2 = 0"))
    marked = [r["html"] for r in pages.filter("page_id % 2 = 1").collect() if len(re.findall(r"<article\b", r["html"] or "")) == 1]
    assert len(marked) > 20
    for html in marked:
        assert mainpage.extract(re.sub(r"</?article\b[^>]*>", "", html), costs) == mainpage.extract(html, costs)


def test_a_column_of_the_outputs_name_is_replaced(spark):
    pages = spark.createDataFrame([(1, "<p>a b c", "own", "x")], "page_id long, html string, _text string, text string")
    found = mainpage.main_texts(pages, mainpage.costs_of({}))
    assert found.columns == ["page_id", "text", "_text"] and found.first()["_text"] == "a b c"
    assert mainpage.main_texts(pages.withColumn("html", F.lit(None).cast("string")), {"p": 1.0, mainpage.OTHER: 1.0}).first()["_text"] == ""
