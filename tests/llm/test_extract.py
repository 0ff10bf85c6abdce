import itertools
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import extract

PROSE = ["The committee met on Tuesday to weigh the plan, and nobody left early.", "Rain fell through the night; by morning the river had come over its banks & into the fields.", "Short.", "“Quoted words” end here, with some more of them to make a paragraph of it."]


def page(body):
    return f"<!DOCTYPE html><html><head><title>A title</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def paragraphs():
    return "".join(f"<p>{p.replace('&', '&amp;')}</p>" for p in PROSE)


NOISE = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav><header>My site of the day</header>'
END = '<aside class="sidebar">Other reads you may like to see today.</aside><div id="comments"><p>First! I think this is a very good article indeed.</p></div><form>Subscribe to our letter now.</form><footer>&copy; 2020 Somebody. All rights reserved.</footer>'


def test_article_alone_is_kept():
    assert extract.main_text(page(NOISE + f"<article><h1>Head line</h1>{paragraphs()}</article>" + END)) == "\n".join(["Head line", *PROSE])
    assert extract.main_text(page(NOISE + f'<div class="cookie-notice">We use cookies to do things for you.</div><div class="post-content">{paragraphs()}</div>' + END)) == "\n".join(PROSE)
    assert extract.main_text(page(NOISE + f"<div><div>{paragraphs()}</div></div>" + END)) == "\n".join(PROSE)


def test_kinds_of_pages():
    body = paragraphs()
    keep = "\n".join(PROSE)
    for before, after in [
        ("<main>", "<section class='comments'><article class='comment'><p>Great article, thank you so much.</p></article></section></main>"),
        ("<article><header><h1>Head</h1><p class='byline'>By A. Writer</p></header>", "<footer>Tags: rain, river</footer></article>"),
        ("<div id=page><div id=masthead>My Blog</div><div id=content>", "<div class='share-buttons'><a>Tweet</a></div></div><div id=sidebar><ul><li><a href=1>One post title</a></li></ul></div></div>"),
        ("<div class='notice'>Maintenance on Sunday, all day long.</div><article>", "<div class='ad'>Buy our shoes, the best shoes you will ever get.</div></article>"),
        ("<body class='with-sidebar'><div class='entry-content'>", "<form><label>Email</label><button>Subscribe</button></form></div><div role='contentinfo'>Imprint</div>"),
    ]:
        text = extract.main_text(before + body + after)
        assert text.removeprefix("Head\n") == keep, text
    assert extract.main_text("<p>Hello world.</p>") == "Hello world."


def test_broken_markup():
    assert extract.main_text("<body><article><p><b>One two three<br><p>Four &am") == "One two three\nFour &am"
    assert extract.main_text("<article><p>a < b and c > d<p>x <a href='q>r'>y</a> z</article>") == "a < b and c > d\nx y z"
    assert extract.main_text('<article><p class="x>lost</p><p>kept text</p>').endswith("kept text")
    assert extract.main_text("<article><p>1<!-- <p>no</p> -->2 &lt;p&gt;&nbsp; 3 <script>if (a</b) {}</script>4") == "12 <p> 3 4"


def test_empty_pages(spark):
    df = spark.createDataFrame([(1, "u", None, "z"), (2, "u", "", "z"), (3, None, "<nav><a>Home</a></nav>", "z"), (3, None, "<nav><a>Home</a></nav>", "z"), (4, "u", page(f"<article>{'<p>A long enough paragraph of words.</p>' * 20000}</article>"), "z")], "page_id long, url string, html string, text string")
    out = {r.page_id: (r.text, r.n_chars) for r in extract.extract(df).collect()}
    assert out[1] == out[2] == out[3] == ("", 0) and out[4][1] == 20000 * len("A long enough paragraph of words.") + 19999
    assert extract.extract(df).count() == 5
    assert extract.extract(df.where("false")).collect() == []


def test_given_pages(spark):
    """On the given pages the article's text comes out and nothing else."""
    import html

    import pyarrow.parquet as pq

    for h in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", h, re.DOTALL)
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", inner[1])] if inner else []
        assert extract.main_text(h) == "\n".join(x for x in want if x)


LONG = [
    "The council voted late on Monday to close the old bridge for a year, and the mayor said that nothing else could have been done in time.",
    "Engineers had warned since spring that two of its piers were sinking; by autumn the cracks could be seen from the road.",
    "“We drove over it every day,” said a baker whose shop stands at the northern end, “and every day it shook a little more.”",
    "Short words.",
    "Buses will go by way of the mill until then, which adds a quarter of an hour to the trip into town, and a ferry is planned for those on foot.",
    "The cost is put at four million, of which the province will pay half if the work begins before the snow does.",
]
SITE = '<div id="top"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></div><div class="cookie-notice"><p>We use cookies to make this site better. <a href="/c">More</a></p></div>'
REST = '<div class="sidebar"><h3>Popular</h3><ul><li><a href="/1">Ten bridges to see</a></li><li><a href="/2">What the mayor eats</a></li></ul></div><div id="comments"><h3>Two comments</h3><div class="comment"><p>I have never trusted that bridge, and I am glad that it is closed at last, to be honest with you.</p></div></div><div class="footer"><p>Copyright 2020 by the Daily Bridge. All rights reserved.</p></div>'
BODY = "".join(f"<p>{x}</p>" for x in LONG)
LAYOUTS = {
    **{f"class {c}": f'<div class="{c}">{BODY}</div>' for c in ("content no-sidebar", "widget search-engines-history", "skip-level", "article-header-large", "post has-comments", "form-of-government", "legal-news", "related-to-bridges", "banner-story", "page-with-sidebar", "story comments-open", "rail-travel", "social-history", "menu-free", "x1 y2")},
    **{f"id {c}": f'<div id="{c}">{BODY}</div>' for c in ("legal-analysis", "search-result-text", "contentNoSidebar", "sidebar-less", "widgetArea-main-story")},
    "section with header": f'<section class="article-header-large"><h1>The bridge</h1>{BODY}</section>',
    "form around all": f'<form id="aspnetForm" method="post"><div>{BODY}</div></form>',
    "header around all": f'<header class="masthead">{BODY}</header>',
    "links between": "<div>" + "".join(f"<p>{x}</p><p><a href='/m'>more</a></p>" for x in LONG) + "</div>",
    "table cells": f'<table><tr><td class="menu"><a href="/">Home</a><br><a href="/n">News</a></td><td>{BODY}</td></tr></table>',
    "line breaks": "<table><tr><td>" + "<br><br>".join(LONG) + "</td></tr></table>",
    "divs only": "<div><div>" + "".join(f"<div>{x}</div>" for x in LONG) + "</div></div>",
    "spans": "<div>" + "".join(f"<div><span><font>{x}</font></span></div>" for x in LONG) + "</div>",
    "deep": "<div>" * 60 + BODY + "</div>" * 60,
    "deep sections": "<div>" * 60 + "".join(f"<section><p>{x}</p></section>" for x in LONG) + "</div>" * 60,
    "never closed": "<div>" + "".join(f"<div><p>{x}" for x in LONG),
    "list": "<ol>" + "".join(f"<li>{x}" for x in LONG) + "</ol>",
    "quotes": "<div>" + "".join(f"<blockquote>{x}</blockquote>" for x in LONG) + "</div>",
    "unclosed svg": f"<article><svg><path d='M0'/>{''}</svg>{BODY}</article>",
    "media": f"<article><video><p>Your browser can't play this.</p></video>{BODY}</article>",
    "head not closed": f"<head><title>T</title><div>{BODY}</div>",
    "role": f'<div role="main" class="widget">{BODY}</div>',
    "capitals": f'<DIV CLASS="Content NoSidebar">{BODY.replace("<p>", "<P>")}</DIV>',
}


def test_layouts():
    """Whatever the article's wrapper is called, its paragraphs come out, in order, and nothing of the rest does."""
    for name, body in LAYOUTS.items():
        closed = "" if name == "never closed" else REST
        got = extract.main_text(f"<html>{'' if 'head' in name.split()[:1] else '<body>'}{SITE}{body}{closed}</html>").split("\n")
        got = [x for x in got if x not in ("The bridge", "more")]
        if name == "line breaks":  # one block
            got = LONG if got == [" ".join(LONG)] else got
        lost = [x for x in LONG if x not in got]
        assert sum(map(len, lost)) <= 0.05 * sum(map(len, LONG)), (name, lost)
        assert not [x for x in got if x not in LONG], (name, got)


def test_text_that_some_browsers_hide():
    text = extract.main_text(f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> hold.</p><noscript><p>{LONG[0]}</p></noscript>{BODY}<xmp>a < b && c</xmp><p>It <span hidden>never </span>ends.</p></article>")
    assert text.split("\n") == ["Let x=2 hold.", LONG[0], *LONG, "a < b && c", "It ends."]
    assert extract.main_text(f"<article><svg><text>A picture</text>{BODY}</article>").split("\n") == LONG
    assert extract.main_text(f"<article>{BODY}<select><option>One</select><p>{LONG[1]}</p></article>").split("\n") == [*LONG, LONG[1]]
    assert extract.main_text(f"<article><object data=x>{BODY}</article>").split("\n") == LONG


def test_pages_without_an_article():
    for page in (SITE, SITE + REST, "<form>Subscribe to our letter now.</form>", "<div class='cookie-notice'><p>We use cookies to make this site better for you and for us.</p></div>"):
        assert extract.main_text(page) == "", page


def test_distance_in_deep_pages():
    for depth in (5, 60, 3000):
        a, b = extract.blocks("<div>" * depth + "<p>one</p><section><p>two</p></section>")
        assert extract.distance(a.element, b.element) == 3


def test_min_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 8)
        terminal = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 6)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        price = lambda s: sum(abs(t) for t, x in zip(terminal, s) if (t > 0) != x and t) + sum(c for a, b, c in edges if s[a] != s[b])  # noqa: B023, E731
        assert price(extract.min_cut(terminal, edges)) == min(map(price, itertools.product([False, True], repeat=n)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<b", ">", "<a href=x>", "</a>", "text ", "&amp;", "<!--", "-->", "<script>", "</script>", "<li>", "<table><td>", "\"", "'", "<", "é"]), max_size=25).map("".join))
def test_any_page_is_read(page):
    extract.main_text(page)
