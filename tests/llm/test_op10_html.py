from __future__ import annotations

import html
import random
import re
import time
from itertools import product

import pytest

from claimhound.llm.html_cut import blocks, edges, extract, main_text, minimum_cut, op10_minimum_cut

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">one</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this page better for you.</p></div>
<div id="wrap"><div class="sidebar"><p>Side words that nobody reads, in a sentence.</p></div>
<article><header><h1>Big  &amp;
title</h1></header><script>var t="</p>";</script><p><b>Bold<br>word<p>First &lt;p&gt; here&nbsp;now</p>Bare text<!-- no -->
<ul><li>point<li>other</ul><form><p>Your name <input></p></form><table><tr><td>x<td>y</table><p>.</p>
<section id="comments"><p>I like this very much, a long comment by a reader of it.</p></section></article></div>
<aside>More</aside><footer>&copy; 2020</footer></body></html>"""
WANT = ["Big & title", "Bold word", "First <p> here now", "Bare text", "point", "other", "x", "y", "."]


def plain(page):
    """The article of these generated pages, by patterns."""
    body = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    parts = re.split(r"</?(?:p|h1)[^>]*>", body)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in parts]
    return "\n\n".join(x for x in parts if x)


def test_query_equals_the_articles(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op10_minimum_cut(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def test_a_page_with_every_kind_of_boilerplate():
    assert main_text(PAGE).split("\n\n") == WANT
    assert main_text(PAGE[: PAGE.index("<section")]).split("\n\n") == WANT  # cut short


def test_content_without_an_article_element():
    page = PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>").replace("<header><h1>Big", "<h1>Big").replace("</h1></header><script", "</h1><script")
    text = main_text(page)
    assert text.startswith("Big & title\n\nBold word") and "comment" not in text and "cookies" not in text


def test_cut_equals_enumeration():
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randint(1, 7)
        own = [rng.uniform(-3, 3) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 3) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(label):
            across = sum(c for (i, j), c in edges.items() if label[i] != label[j])
            return across + sum(max(s, 0) if not k else max(-s, 0) for s, k in zip(own, label, strict=True))

        got = minimum_cut(own, edges)
        assert abs(cost(got) - min(map(cost, product((False, True), repeat=n)))) < 1e-9


SENTENCES = [f"Sentence number {i} of this article says a little more than before." for i in range(8)]
ARTICLE = "<article><h1>The title</h1>" + "".join(f"<p>{x}</p>" for x in SENTENCES) + "</article>"
BODY = "\n\n".join(["The title", *SENTENCES])


@pytest.mark.parametrize(
    "before, after",
    [
        ('<div class="layout with-sidebar">', "</div>"),
        ('<div class="has-header no-cookie-bar">', "</div>"),
        ('<div class="search-result-page">', "</div>"),
        ('<form id="whole-page">', "</form>"),
        ('<div class="with-sidebar"><div class="related"><article><p>A teaser.</p></article></div>', "</div>"),
        ('<main class="has-banner"><aside><article><p>Another.</p></article></aside>', "</main>"),
    ],
)
def test_a_wrapper_is_not_judged_by_its_name(before, after):
    assert main_text(f"<body>{before}{ARTICLE}{after}</body>") == BODY


def test_named_content_in_a_wrapper():
    page = '<div class="with-sidebar"><div class="content">' + "".join(f"<p>{x}</p>" for x in SENTENCES)
    page += '</div><div class="sidebar"><p>Side words in a sentence.</p></div></div>'
    assert main_text(page).split("\n\n") == SENTENCES
    notice = '<div class="cookie-notice"><div class="text"><p>We use cookies.</p></div></div>'
    assert "cookies" not in main_text(notice + "".join(f"<p>{x}</p>" for x in SENTENCES))


def test_raw_elements_end_where_they_end():
    for inside in ("<svg/>", "<svg viewBox='0 0 1 1'/>", "<svg><path/><text>no</text></svg>", "<script>var a='</p>';</script >"):
        assert main_text(ARTICLE.replace("</h1>", "</h1>" + inside)) == BODY
    for name in ("style-guide", "template-card", "scripted"):
        assert "shown" in main_text(ARTICLE.replace("</h1>", f"</h1><{name}>shown</{name}>"))
    assert main_text(ARTICLE.replace("<p>Sentence number 3", "<p title=\"open>Sentence number 3")) == BODY


def test_ambiguous_ids_of_sections():
    paper = '<section id="discussion"><h2>Discussion</h2>' + "".join(f"<p>{x}</p>" for x in SENTENCES) + "</section>"
    text = main_text(ARTICLE.replace("</article>", paper + "</article>"))
    assert text == BODY + "\n\nDiscussion\n\n" + "\n\n".join(SENTENCES)
    thread = paper.replace("discussion", "comments")
    assert main_text(ARTICLE.replace("</article>", thread + "</article>")) == BODY


def test_the_cut_decides_where_the_score_alone_is_wrong():
    """Short text between long text stays, and a sentence among boilerplate goes, against their own scores."""
    long = "many words " * 30
    inside = f"<div><div>{long}</div><div>only a few here</div><div>{long}</div></div>"
    link = "<p>Before it.</p><ul><li><a href='/x'>one linked point</a></li></ul><p>After it.</p>"
    linked = ARTICLE.replace("</article>", link + "</article>")
    around = '<div><div class="ad">Buy now</div><p>So good.</p><div class="ad">Buy more</div></div>' + ARTICLE
    for page, text, kept in ((inside, "only a few here", True), (linked, "one linked point", True), (around, "So good.", False)):
        found = blocks(page)
        block = next(b for b in found if b.text == text)
        assert (block.score > 0) != kept
        assert minimum_cut([b.score for b in found], edges(found))[found.index(block)] == kept


def test_hostile_pages_take_linear_time():
    pages = ["<a b " * 40_000, '<a "' * 50_000, '<a ">" ' * 30_000 + "'>", "<!" * 100_000, "<svg" * 50_000]
    pages += ["<div>" * 40_000 + "</b>" * 20_000, "<p>" * 60_000, "<!--" * 50_000, "</script " * 20_000 + "x>"]
    for page in pages:
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 10  # quadratic scanning took minutes


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (None, None, "", 1), (2, "u", "<p>", 1), (2, "u", "<p>", 1), (3, "u", "no markup at all, only a sentence of words in a page < 3", 1), (4, "u", "<article>" + "<p>word word, " * 3000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in extract(df).collect()}
    assert got[1].text == got[None].text == got[2].text == "" and got[4].text.count("\n\n") == 2999
    assert extract(df.limit(0)).count() == 0
