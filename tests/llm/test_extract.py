"""HTML extraction: the reader, exact marginals by enumeration, pages written by hand, held-out layouts, the registered query."""

import html
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import dom, extract, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return extract.learn(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html"))


def blocks(source):
    return list(dom.Page(source).text.values())


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>one<p>two</p>three", ["one", "two", "three"]),
        ("<p>a<b>b</b>c<br>d\n\te</p>", ["abc d e"]),
        ("<p><b>open<br><p>next</p></b>", ["open", "next"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("x<script>var a='<p>no</p>';</script>y<style>p{}</style><!-- <p>no</p> -->z", ["xyz"]),
        ("<title>no</title><p>a &lt;b&gt; &#x41;&#66;&nbsp;c &unknown; &amp;amp;</p>", ["a <b> AB c &unknown; &amp;"]),
        ("1 < 2 <3 a<b", ["1 < 2 <3 a"]),
        ("<p title='a>b' data-x=\"<p>\">in</p>", ["in"]),
        ("<P CLASS=x>Up</P><DIV>per", ["Up", "per"]),
        ("<p>a</div></span></p>b", ["a", "b"]),
        ("<script>never closed <p>x</p>", []),
        ("a<!-- never closed <p>x</p>", ["a"]),
        ("a<p class=\"never closed>b</p>", ["a", "b"]),
        ("<dl><dt>t<dd>d<dt>u</dl>", ["t", "d", "u"]),
        ("<h1>a<h2>b</h2>", ["a", "b"]),
        ("a<hr>b<img alt=x>c<wbr>d", ["a", "bcd"]),
        ("<head><meta x></head><body>a</body>b</html>c", ["abc"]),
    ],
)
def test_reader(source, want):
    assert blocks(source) == want


def test_reader_is_linear_and_deep():
    for source in ("<div>" * 200_000 + "x", "<a b='" * 200_000, "<" * 500_000, "&" * 500_000, "<p " * 200_000 + "x", '<a "' * 200_000, "<!--" * 200_000, "</b>" * 200_000 + "x", "<b>" * 3000 + "<p>" * 3000 + "x", "<li>" * 100_000 + "x", "<x y=" + "=" * 300_000, "<p>" + "w " * 1_000_000):
        began = time.time()
        page = dom.Page(source)
        assert max(page.depth) <= dom.DEEPEST + 1
        assert time.time() - began < 20, source[:20]
    assert blocks("<div>" * 2000 + "x" + "</div>" * 2000 + "y") == ["x", "y"]


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    page = dom.Page("<div><p>a</p><ul><li>b<li>c</ul></div><nav>d</nav>")
    forest = extract.Forest([page, dom.Page("x")])
    n = len(forest.kind)
    unary, pair = rng.normal(size=(n, 2)), rng.normal(size=(n, 2, 2))
    belief, joint = extract.messages(forest, unary, pair)
    weight = np.zeros((n, 2))
    both = np.zeros((n, 2, 2))
    for labels in itertools.product((0, 1), repeat=n):
        total = sum(unary[i, x] for i, x in enumerate(labels))
        total += sum(pair[i, labels[forest.parent[i]], x] for i, x in enumerate(labels) if forest.parent[i] >= 0)
        for i, x in enumerate(labels):
            weight[i, x] += np.exp(total)
            if forest.parent[i] >= 0:
                both[i, labels[forest.parent[i]], x] += np.exp(total)
    share = np.exp(belief - belief.max(1, keepdims=True))
    assert np.allclose(share / share.sum(1, keepdims=True), weight / weight.sum(1, keepdims=True))
    inner = forest.parent >= 0
    got = np.exp(joint[inner] - joint[inner].max((1, 2), keepdims=True))
    assert np.allclose(got / got.sum((1, 2), keepdims=True), both[inner] / both[inner].sum((1, 2), keepdims=True))


PROSE = [
    "The river rose two metres in one night, and the mill at the lower bridge stood under water until noon.",
    "Nobody in the village had seen anything like it; the oldest among them spoke of a flood before the war.",
    "By the evening, however, the road to the station was open again, and the first train left with an hour's delay.",
    "Engineers now want to raise the dam. That would cost about three million, and the council has yet to vote on it.",
]
TALK = ["I was there and it was not two metres at all, more like one and a half, as everyone on our street can tell you.", "Great piece, thank you! My grandmother told me about the older flood, which must have been much worse than this."]
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li><li><a href='/c'>Contact</a></li></ul>"


def body(tag="p", close=True):
    return "".join(f"<{tag}>{t}" + (f"</{tag}>" if close else "") for t in PROSE)


PAGES = {
    "semantic": f"<header><a href='/'>The Daily</a><nav>{MENU}</nav></header><main><article><h1>Flood at the mill</h1>{body()}</article></main><aside><h3>Read also</h3>{MENU}</aside><footer>© 2020 The Daily. All rights reserved.</footer>",
    "named divs": f"<div id='header'><h2>The Daily</h2></div><div class='menu'>{MENU}</div><div class='content'><h1>Flood at the mill</h1>{body()}</div><div class='sidebar'><p>{TALK[0]}</p>{MENU}</div><div class='footer'><p>© 2020 The Daily</p></div>",
    "comments": f"<nav>{MENU}</nav><article><h1>Flood at the mill</h1>{body()}</article><section id='comments'><h2>2 comments</h2><div class='comment'><b>Ann</b><p>{TALK[0]}</p></div><div class='comment'><b>Bo</b><p>{TALK[1]}</p></div><form><label>Your comment</label><textarea>x</textarea><button>Send</button></form></section><footer>Imprint</footer>",
    "comments inside": f"<article class='post'><h1>Flood at the mill</h1>{body()}<div class='comments'><h3>Comments</h3><p>{TALK[0]}</p><p>{TALK[1]}</p></div></article>",
    "notice and advert": f"<div class='cookie-banner'><p>We use cookies to make this site better for you, and our partners do so too.</p><button>OK</button></div><div class='wrap'><div class='post'><h1>Flood at the mill</h1><p>{PROSE[0]}</p><p>{PROSE[1]}</p><div class='ad'><p>Buy the new pump now, it is the best one that money can buy.</p></div><p>{PROSE[2]}</p><p>{PROSE[3]}</p></div></div>",
    "table layout": f"<table><tr><td class='nav'>{MENU}</td><td class='main'><h1>Flood at the mill</h1>{body()}</td><td class='sidebar'>{MENU}</td></tr></table>",
    "unclosed": f"<body><nav>{MENU}</nav><article><h1>Flood at the mill</h1>{body(close=False)}</article><footer>© Daily",
    "form": f"<article><h1>Flood at the mill</h1>{body()}</article><form class='newsletter'><p>Subscribe to our newsletter and get the best stories every week.</p><input><button>Go</button></form>",
}
WANT = " ".join(["Flood at the mill", *PROSE])


@pytest.mark.parametrize("name", PAGES)
def test_pages_written_by_hand(model, name):
    got = extract.main_texts([f"<html><head><title>T</title></head><body>{PAGES[name]}</body></html>"], model)
    assert got == [WANT]


def test_held_out_layouts(model):
    composer = extract._Composer(random.Random(4711), [t * 2 for t in PROSE + TALK], ["Read on", "Home", "More of this", "A word or two"])
    pages, labels = extract.labelled([composer.page() for _ in range(300)])
    forest = extract.Forest(pages)
    found, truth = model.marginals(forest)[forest.texts] >= 0.5, np.concatenate(labels) == 1
    assert (found == truth).mean() > 0.95
    assert found[truth].mean() > 0.9
    assert found[~truth].mean() < 0.03


def article(source):
    inside = re.search(r"<article>(.*)</article>", source, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inside)).split())


def test_registered_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op11_html_extraction"](spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(pages)
    assert all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in rows)
    assert sum(r.text == article(pages[r.page_id].html) for r in rows) >= 0.99 * len(rows)


def test_edges(spark, model):
    long = "<article>" + "".join(f"<p>{i}: {PROSE[i % 4]}</p>" for i in range(40_000)) + "</article>"
    rows = [(1, None), (2, ""), (3, "only text, no element"), (4, "<nav><a href=x>Home</a></nav>"), (5, long), (6, PAGES["semantic"]), (6, PAGES["semantic"]), (None, "<p>  </p>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"TEXT": F.lit("x"), "N_chars": F.lit(1), "url": F.lit("u")})
    out = extract.extract(df, model)
    assert out.columns == ["page_id", "html", "url", "text", "n_chars"]
    got = [(r.page_id, r.text) for r in out.orderBy("page_id").collect()]
    assert got[:4] == [(None, ""), (1, ""), (2, ""), (3, "only text, no element")]
    assert dict(got)[4] == ""
    assert dict(got)[5] == " ".join(f"{i}: {PROSE[i % 4]}" for i in range(40_000))
    assert [t for i, t in got if i == 6] == [WANT] * 2
    assert extract.extract(df.limit(0), model).count() == 0
    assert isinstance(extract.learn(df.limit(0).select("page_id", "html")), extract.Model)
