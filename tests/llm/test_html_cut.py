import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lineflow.llm import html_cut as hc

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="single-sidebar">
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy this now, it is cheap.</div>
<article><header><h1>The  headline</h1></header><p>First paragraph of the text,
with a <b>line</b> break &amp; more. It goes on.<br><p>Second one, a bit shorter. Yes.
<div class="advert">An advert between, with words. Buy.</div>
<p>Third paragraph with &lt;tags&gt; in it, and an end.</p>
<section class="comments"><p>I liked this very much, thank you. Great.</p></section></article>
<aside>Related things to read.</aside><form><p>Your e-mail</p></form>
<script>var x = "<p>not text</p>";</script><footer>&copy; someone</footer></body></html>"""

TEXT = (
    "The headline\n\nFirst paragraph of the text, with a line break & more. It goes on.\n\n"
    "Second one, a bit shorter. Yes.\n\nThird paragraph with <tags> in it, and an end."
)


def test_a_page():
    assert hc.main_text(PAGE) == TEXT


def test_a_page_without_content_elements():
    page = PAGE.replace("article>", "div>").replace("<article", "<div").replace("header>", "div>")
    assert hc.main_text(page) == TEXT


@pytest.mark.parametrize("page", ["", "plain < text", "<", "<p", "<p class='", "<!-- open", "<script>x", "</p></div>", "<b><i><p>"])
def test_broken_markup(page):
    assert isinstance(hc.main_text(page), str)


def test_truncated_pages_keep_what_they_have():
    for end in range(0, len(PAGE), 7):
        hc.main_text(PAGE[:end])
    assert hc.main_text(PAGE[: PAGE.index("Second")]).startswith("The headline\n\nFirst paragraph")


def cut_cost(side, excess, edges):
    cost = sum(max(e, 0) for s, e in zip(side, excess) if not s) + sum(max(-e, 0) for s, e in zip(side, excess) if s)
    return cost + sum(price for (a, b), price in edges.items() if side[a] != side[b])


@pytest.mark.parametrize("seed", range(60))
def test_minimum_cut_against_all_labellings(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 11)
    excess = [rng.choice([0, rng.uniform(-2, 2), rng.uniform(-9, 9)]) for _ in range(n)]
    edges = {(a, b): rng.choice([0.0, 0.5, rng.uniform(0, 4)]) for a in range(n) for b in range(a) if rng.random() < 0.5}
    edges = {(b, a): p for (a, b), p in edges.items()}
    best = min(cut_cost(side, excess, edges) for side in itertools.product((False, True), repeat=n))
    assert cut_cost(hc.minimum_cut(excess, edges), excess, edges) == pytest.approx(best, abs=1e-9)


def test_neighbours_decide_a_doubtful_block():
    edges = {(0, 1): 0.8, (1, 2): 0.8}
    assert hc.minimum_cut([3.0, -0.5, 3.0], edges) == [True, True, True]
    assert hc.minimum_cut([3.0, -2.5, 3.0], edges) == [True, False, True]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, None, ""), (3, "v", "<p>" * 20000 + "x"), (4, "w", "no markup")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    return table.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))


def test_odd_rows(pages):
    found = hc.extract_main_text(pages).collect()
    assert len(found) == 6 and all(r.n_chars == len(r.text) for r in found)
    assert [r.text for r in found if r.page_id == 1] == [TEXT, TEXT]
    assert all(r.text == "" for r in found if r.page_id in (None, 2))


def test_empty_table(pages):
    assert hc.extract_main_text(pages.filter("false")).collect() == []
    assert hc.fit_classifier(pages.filter("false")) == list(hc.PRIOR)


def test_the_table(spark):
    """The pages' text is their article; held against its markup."""
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html_of = {r.page_id: r.html for r in table.collect()}
    weights = hc.fit_classifier(table, sample_pages=20)
    for row in hc.extract_main_text(table, weights=weights).collect():
        article = html_of[row.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [b.text for b in hc.blocks_of(f"<article>{article}</article>")]
        assert row.text == "\n\n".join(blocks)


BODY = "<article><h1>The headline</h1><p>A paragraph of the text, long enough. It goes on.</p></article><footer>Bye</footer>"
BODY_TEXT = "The headline\n\nA paragraph of the text, long enough. It goes on."


@pytest.mark.parametrize(
    "start",
    [
        "<html><head><title>T</title><meta charset=utf-8>",
        "<head><title>T</title><link rel=x><style>p{}</style><body>",
        "<head><script>x</script><select><option>1</select>",
        "<html><head><title>T</title></head>",
        "<title>T</title>",
    ],
)
def test_heads_that_end_by_themselves(start):
    assert hc.main_text(start + BODY) == BODY_TEXT
    assert hc.main_text("<head><title>T</title>") == ""


def test_text_ends_a_head():
    assert [b.text for b in hc.blocks_of("<head><title>T</title>\n Some text.<p>More.")] == ["Some text.", "More."]


@pytest.mark.parametrize(
    "wrapper",
    ['style="overflow:hidden"', 'class="content has-sidebar"', 'class="post comments-open"', 'class="widget"', 'id=social',
     'class="overflow-hidden"', 'data-state="hidden"', 'style="overflow: hidden; display: block"'],
)
def test_wrappers_of_content(wrapper):
    for inner in (BODY, BODY.replace("article>", "main>")):
        page = f"<body><div class=sidebar><p>Other things.</p></div><div {wrapper}>{inner}</div></body>"
        assert hc.main_text(page) == BODY_TEXT
        assert not any(b.frame_hint for b in hc.blocks_of(page) if b.inside)


@pytest.mark.parametrize(
    "wrapper", ["hidden", 'style="color:red;display:none"', 'aria-hidden="true"', 'class="a hidden"', "hidden=until-found"]
)
def test_hidden_content_stays_hidden(wrapper):
    assert all(b.frame_hint for b in hc.blocks_of(f"<div {wrapper}><main><article><p>Text.</article></main></div>"))


def test_related_articles_and_comments_are_no_content():
    page = f'{BODY}<div class="related"><article><p>Another article that one may read as well. It is good.</p></article></div>'
    assert hc.main_text(page) == BODY_TEXT
    page = BODY.replace("</article>", '<div class="comments"><article><p>I liked it, thank you. Great.</p></article></div></article>')
    assert hc.main_text(page) == BODY_TEXT


# ---- pages without markup that says anything -------------------------------


def unmarked(page):
    """The page with plain div elements for all that has a meaning, and without names."""
    page = re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)
    return re.sub(r"<(/?)(article|main|nav|header|footer|aside|form|section)\b[^>]*>", r"<\1div>", page)


def test_pages_without_markup(spark):
    """Held against what the same pages give with their markup; fitted on other pages."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights, text_weights = hc.fit_classifiers(table.filter("page_id % 3 != 0"), sample_pages=100)
    hits = extra = missed = 0
    for row in table.filter("page_id % 3 = 0").collect():
        wanted = set(hc.main_text(row.html, weights, text_weights).split("\n\n"))
        page = unmarked(row.html)
        assert hc.is_unmarked(hc.blocks_of(page))
        found = set(hc.main_text(page, weights, text_weights).split("\n\n"))
        hits, extra, missed = hits + len(found & wanted), extra + len(found - wanted), missed + len(wanted - found)
    assert hits / (hits + extra) > 0.95 and hits / (hits + missed) > 0.98


@pytest.mark.parametrize("page", ["<div>x " * 100_000, "<div>x " * 50_000 + "</p></span>y" * 50_000, "<b>x" * 100_000])
def test_deep_pages_take_linear_time(page):
    start = time.perf_counter()
    assert isinstance(hc.main_text(page), str)
    assert time.perf_counter() - start < 30
