from __future__ import annotations

import html
import random
import re

import pytest

from skyloom.llm import style_tree as module
from skyloom.llm.style_tree import Page, extract_text, style_tree

from .helpers import prose

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("plain &amp; <b>bo</b>ld", "plain & bold"),
        ("a < b & c", "a < b & c"),
        ("<!-- never closed", ""),
        ("<p>one<p>two<br>three</p>\n<div>four  \t five</div>", "one two three four five"),
        ("<script>if (a<b) {'</p>'}</script>x<style>p{}</style><STYLE>q</style>y", "xy"),
        ("<nav><a href='/'>Home</a></nav><article><h1>T&eacute;st</h1><p>body</article><footer>f</footer>", "Tést body"),
        ("<header>top</header><article><header><h1>Title</h1></header><p>body</p></article>", "Title body"),
        ("<article><p>text</p><section id='comments'><p>nice!</p></section><div class=\"ad-box\">buy</div></article>", "text"),
        ("<article><p>text</p><aside>more</aside><form><input>x</form></article><article class='comment'>no</article>", "text"),
        ("<div class='page has-sidebar'><main><p>kept</p></main></div>", "kept"),
        ("<div class='cookieNotice'>we use</div><div id='side-bar' hidden>s</div><p>kept</p>", "kept"),
        ('<p title="a > b">kept</p><a href="x>y">link</a>', "kept link"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("<title>head</title><p>&lt;tag&gt; &amp;amp; &#233;</p>", "<tag> &amp; é"),
        ("<article><p><b>open<br><p>next</p></article><div class=ad>no</div>", "open next"),
    ],
)
def test_pages(source, text):
    assert Page(source).text() == text


def site(n: int) -> list[tuple]:
    """Pages without an article element: a bar that all share, and texts of their own."""
    bar = "<div class=top><a href=/>Home</a><a href=/b>Shop</a></div>"
    return [(k, "http://site.example/x", f"<body>{bar}<div class=text><p>Text number {k} is {'very ' * k}its own.</p></div></body>") for k in range(n)]


def test_shared_branches_are_low(spark):
    pages = spark.createDataFrame(site(8), PAGES)
    tree = {r.path: r for r in style_tree(pages).collect()}
    assert tree["/body/div.top"].pages == 8 and tree["/body/div.top"].importance == pytest.approx(0)
    assert tree["/body/div.text"].content == pytest.approx(1)
    found = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert found == {k: f"Text number {k} is {'very ' * k}its own." for k in range(8)}


def test_entropies(spark):
    """Two forms on four pages; words of all pages, of two, and of one."""
    rows = [(k, "http://h/", f"<div><p>all {'half' if k % 2 else 'other'} w{k} w{k}</p>{'<hr><b>x</b>' if k % 2 else ''}<a href=/>link{k}</a></div>") for k in range(4)]
    tree = {r.path: r for r in style_tree(spark.createDataFrame(rows, PAGES)).collect()}
    assert tree["/div"].presentation == pytest.approx(0.5) and tree["/div/p"].presentation == pytest.approx(0)
    news = [0.0, 0.5, 0.5, 1.0, 1.0, 1.0, 1.0]
    assert tree["/div/p"].novelty == pytest.approx(sum(news) / 7)
    assert tree["/div/a"].content == 0 and tree["/div/a"].novelty == 1
    assert tree["/div/b"].importance is None and tree["/div"].content == pytest.approx(1)


def test_few_pages_are_not_compared(spark):
    found = [r.text for r in extract_text(spark.createDataFrame(site(2), PAGES)).collect()]
    assert all(t.startswith("Home") or t.startswith("HomeShop") for t in found)


def test_copies_of_one_page_keep_their_text(spark):
    rows = [(k, "http://a.example/", "<body><div><p>same everywhere</p></div></body>") for k in range(6)]
    assert {r.text for r in extract_text(spark.createDataFrame(rows, PAGES)).collect()} == {"same everywhere"}


def test_hard_rows(spark):
    big = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    rows = [(1, None, None), (None, "no scheme", "<p>x</p>"), (2, "http://h/", ""), (2, "http://h/", ""), (3, "HTTP://H:80/a?b", big)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'clash' AS text", "'clash' AS host", "'clash' AS low", "'clash' AS ref")
    found = sorted((tuple(r) for r in extract_text(df).collect()), key=repr)
    assert found == sorted([(1, None, "", 0), (None, "no scheme", "x", 1), (2, "http://h/", "", 0), (2, "http://h/", "", 0), (3, "HTTP://H:80/a?b", " ".join(["word"] * 20_000), 99_999)], key=repr)
    assert extract_text(df.limit(0)).collect() == []


def test_query_against_a_plain_reading(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    from skyloom.llm.queries import QUERIES

    source = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in QUERIES["op2_style_tree"](spark, "/root/testdata/sf0.001").collect():
        body = source[r.page_id].split("<article>")[1].split("</article>")[0]
        plain = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", body).replace("<b>", "").replace("</b>", "")).split())
        assert (r.text, r.n_chars) == (plain, len(plain))


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<article style="overflow:hidden"><p>kept</p></article>', "kept"),
        ('<p>a <a href="/hidden-valley">link</a> <b title="The hidden truth" data-class="ad">bold</b></p>', "a link bold"),
        ("<p>kept</p><div data-x='a' hidden>no</div><div hidden=''>no</div><div HIDDEN=hidden>no</div><div aria-hidden=true>no</div>", "kept"),
        ('<div title="id=comments class=ad">kept</div><div title=x class=ad>no</div>', "kept"),
        ('<article><h2 id="related-work">Related</h2><section id="search"><p>how to search</p></section><div id="newsletter">no</div></article>', "Related how to search"),
    ],
)
def test_values_are_not_names(source, text):
    assert Page(source).text() == text


def extracted(spark, bodies: list[str]) -> list[str]:
    pages = spark.createDataFrame([(k, "http://h.example/", f"<body>{x}</body>") for k, x in enumerate(bodies)], PAGES)
    return [r.text for r in extract_text(pages).orderBy("page_id").collect()]


def test_text_beside_an_article_stays(spark):
    own = [prose(random.Random(k), 40) for k in range(6)]
    found = extracted(spark, [f"<div class=lead><p>{x}</p></div><article><p>card {k}</p></article>" for k, x in enumerate(own)])
    assert found == [f"{x} card {k}" for k, x in enumerate(own)]


def test_what_repeats_inside_articles_goes(spark):
    box = "<div class=box><p>Join our readers today</p></div>"
    own = [prose(random.Random(k), 60) for k in range(6)]
    assert extracted(spark, [f"<article><h1>T {k}</h1><p>{x}</p>{box}</article>" for k, x in enumerate(own)]) == [f"T {k} {x}" for k, x in enumerate(own)]


def test_copies_of_an_article_stay_whole(spark):
    page = "<article><h1>Title</h1><p>one two</p><ul><li>three</ul><p>four</p></article>"
    assert set(extracted(spark, [page] * 5)) == {"Title one two three four"}


def news(k: int, n: int = 50) -> str:
    return prose(random.Random(1000 + k), n)


def on_a_site(spark, monkeypatch, make, pages: int = 6, broadcast: bool = True) -> list[str]:
    """The texts of pages that share a menu, an advert and a footer around what make gives."""
    if not broadcast:
        monkeypatch.setattr(module, "BROADCAST_NODES", 0)
    bodies = []
    for k in range(pages):
        rng = random.Random(k)
        menu = "".join(f"<li><a href=/{x}>{x}</a></li>" for x in prose(rng, rng.randint(3, 5)).split())
        bodies.append(f"<nav><ul>{menu}</ul></nav><div class=one>{prose(rng, 4)}</div>{make(k)}<div class=two>(c) {prose(rng, 3)}</div>")
    return extracted(spark, bodies)


@pytest.mark.parametrize("broadcast", [True, False])
def test_unnamed_adverts_and_menus_of_changing_words_go(spark, monkeypatch, broadcast):
    """Nothing is named; the tree alone tells what is not the article."""
    found = on_a_site(spark, monkeypatch, lambda k: f"<div class=three><h1>{news(k, 4)}</h1><p>{news(k)}</p></div>", 6, broadcast)
    assert found == [f"{news(k, 4)} {news(k)}" for k in range(6)]


def test_without_the_tree_texts_change(spark):
    """All test pages of hosts with enough pages; their menus, adverts and footers go by importance alone."""
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host = {r.page_id: r.host for r in module.hosted(pages).select("page_id", "host").collect()}
    tree, none = ({r.page_id: r.text for r in extract_text(pages, t).collect()} for t in (module.THRESHOLD, 0.0))
    several = [k for k, h in host.items() if sum(x == h for x in host.values()) >= module.LEAST_PAGES]
    assert len(several) > 200 and all(len(tree[k]) < len(none[k]) for k in several)


def test_sections_of_an_article_keep_their_ids(spark, monkeypatch):
    make = lambda k: f'<article><h2 id="search">Search {news(k, 4)}</h2><p>{news(k)}</p><h2 id="related-work">{news(k, 3)}</h2><p class="alert">{news(k, 9)}</p></article>'
    assert on_a_site(spark, monkeypatch, make) == [f"Search {news(k, 4)} {news(k)} {news(k, 3)} {news(k, 9)}" for k in range(6)]


def test_names_of_the_body_are_layout(spark):
    bodies = [f'<html><body class="right-sidebar"><p>{news(k)}</p></body></html>' for k in range(5)]
    found = [r.text for r in extract_text(spark.createDataFrame([(k, "http://h/", x) for k, x in enumerate(bodies)], PAGES)).orderBy("page_id").collect()]
    assert found == [news(k) for k in range(5)]
    assert Page(bodies[0]).text() == news(0)


def test_reader_comments_go(spark, monkeypatch):
    make = lambda k: f'<main><p>{news(k)}</p><div class="comments"><article><p>{news(500 + k, 30)}</p></article></div></main>'
    assert on_a_site(spark, monkeypatch, make) == [news(k) for k in range(6)]
    assert Page(make(0)).text() == news(0)


def test_packing():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, most in ((1, 2), (500, 5), (500, 1000)):
        node, word = np.sort(rng.integers(-(1 << 62), 1 << 62, 7))[rng.integers(0, 7, n)], rng.integers(0, 1 << 32, n).astype(np.uint32)
        order = np.lexsort((word, node))
        node, word, c = node[order], word[order], rng.integers(1, most, n).astype(np.uint32)
        logs = np.where(c > 1, c * 1.5, 0).astype(np.float32)
        assert all((a == b).all() for a, b in zip(module.unpacked(module.packed(node, word, c, logs)), (node, word, c, logs), strict=True))
