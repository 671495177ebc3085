"""Operator 2 on hand-written pages that have nothing to do with the labelled table, on all sf0.01 pages and on hostile markup."""

import html
import re
import time

import pyarrow.parquet as pq
import pytest

from lodestack.llm import html_text, queries

ONE = "The council met on Tuesday evening to hear how the harbour wall will be repaired before the autumn storms."
TWO = "Engineers told the meeting that work can begin in June, provided that the grant is paid in time."
ASK = "You are all wrong about this wall, I have lived beside it for forty years and it never moved."

PAGES = {
    "blog theme": (
        f'<html class="no-js"><body class="home blog has-sidebar comments-open"><div id="page" class="site sidebar-right"><header id="masthead"><p class="site-title"><a href="/">My blog</a></p></header>'
        f'<div id="content"><main id="main"><article class="post tag-cookies category-newsletter"><header class="entry-header"><h1 class="entry-title">Wall</h1></header><div class="entry-content"><p>{ONE}</p><p>{TWO}</p></div></article>'
        f'<div id="comments" class="comments-area"><h2>Two thoughts</h2><ol class="comment-list"><li class="comment"><article><div class="comment-content"><p>{ASK}</p></div></article></li></ol></div></main>'
        f'<aside id="secondary" class="widget-area"><h2>Recent posts</h2><ul><li><a href="/x">Another post</a></li></ul></aside></div><footer class="site-footer">Powered by nothing</footer></div></body></html>',
        ["Wall", ONE, TWO],
    ),
    "body class alone": (f'<body class="has-sidebar"><article><h1>Wall</h1><p>{ONE}</p></article></body>', ["Wall", ONE]),
    "one form around all": (f'<body><form id="aspnetForm" action="x"><div class="navbar"><a href="/a">A</a> <a href="/b">B</a></div><div id="main"><h1>Wall</h1><p>{ONE}</p><p>{TWO}</p></div><div class="footer">Imprint</div></form></body>', ["Wall", ONE, TWO]),
    "graphics and formulas": (f"<article><h1>Wall</h1><p>{ONE}</p><p><svg class='icon'/> {TWO}</p><p>Let <math><mi>x</mi><annotation encoding='tex'>\\xi</annotation></math> be its length.</p><p>After.</p></article>", ["Wall", ONE, TWO, "Let x be its length.", "After."]),
    "stand-in text": (f"<article><p>{ONE}</p><object data=map.pdf><p>A map of the harbour wall and its three gates.</p></object><canvas>A chart of the tides.</canvas><p>{TWO}</p></article>", [ONE, "A map of the harbour wall and its three gates.", "A chart of the tides.", TWO]),
    "hidden words": (f"<article><p>{ONE} <span hidden>unseen</span></p><div style='display: none'><p>{TWO}</p></div></article>", [ONE]),
    "open tags": (f"<title>Wall<p></title><h1>Wall<p><a name=top>{ONE}<p>{TWO}<ul><li>first of the three gates<li>second of them</ul>", ["Wall", ONE, TWO, "first of the three gates", "second of them"]),
    "notice first": (f'<div class="cookie-banner"><p>We use cookies to make the site better for everyone.</p><button>Agree</button></div><div class="story"><h1>Wall</h1><p>{ONE}</p><div class="ad-slot">Buy paint</div><p>{TWO}</p></div>', ["Wall", ONE, TWO]),
    "references": ("<article><p>Fish &amp; chips cost &pound;5 &#8212; or &#x35; pounds.</p></article>", ["Fish & chips cost £5 — or 5 pounds."]),
    "nothing": ('<nav><ul><li><a href="/">Home</a></li></ul></nav><footer>Imprint</footer>', []),
    "unclosed noscript": (f"<article><p>{ONE}</p><noscript><p>{TWO}</p></article>", [ONE, TWO]),
    "tag with odd quotes": (f"""<article><p title="a > b" data-x=it's>{ONE}</p><p>{TWO}</p></article>""", [ONE, TWO]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == "\n\n".join(want)


NAMES = "sidebar-layout two-col-side form-body ad-free popular-science thread tags more read-more-wrap contact legal privacy-policy comment-free header-less widget-area side-by-side newsletter-issue promo-page share-story notice-board related-work form footer-less login-less search-results follow-up menu-free signup-done".split()
SITE = '<header><h1><a href="/">The harbour paper</a></h1></header>'
BESIDE = '<nav><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></nav>{}<footer>Imprint and contact</footer>'


@pytest.mark.parametrize("name", NAMES)
def test_no_class_name_empties_a_page(name):
    """The whole article in an element of any name: with and without headings, with the site's name before it, and nested."""
    text = f"<p>{ONE}</p><p>{TWO}</p><p>{ONE}</p>"
    kept = [ONE, TWO, ONE]
    for page, want in (
        (f'<body><div class="{name}">{text}</div></body>', kept), (f'<body><div class="{name}"><h2>Wall</h2>{text}</div></body>', ["Wall", *kept]), (f'<body><div class="{name}"><h1>Wall</h1>{text}</div></body>', ["Wall", *kept]),
        (f'<body>{SITE}<div class="{name}">{text}</div></body>', kept), ("<body>" + BESIDE.format(f'<div class="{name}">{text}</div>') + "</body>", kept),
        (f'<body><div class="main"><div class="{name}-content"><h1>Wall</h1>{text}</div></div></body>', ["Wall", *kept]),
    ):
        assert html_text.main_text(page) == "\n\n".join(want), page


def test_side_parts_stay_out():
    article = f"<article><h1>Wall</h1><p>{ONE}</p></article>"
    talk = "".join(f"<p>{ASK}</p>" for _ in range(9))
    for name in ("comments", "related", "newsletter", "sponsored", "sidebar"):
        assert html_text.main_text(f'<body>{article}<div class="{name}">{talk}</div></body>') == f"Wall\n\n{ONE}"
    assert html_text.main_text('<body><div class="cookie-banner"><p>We use cookies to make the site better.</p></div></body>') == ""


def test_neighbours_tell_linked_paragraphs_from_teasers():
    linked = "<p><a href='/x'>The full report of the engineers can be read on the pages of the council.</a></p>"
    assert "full report" in html_text.main_text(f"<article><h1>Wall</h1><p>{ONE}</p>{linked}<p>{TWO}</p></article>")
    teasers = "".join(f"<p><a href='/{i}'>Another long story of the town, number {i}, waits for you here.</a></p>" for i in range(5))
    assert html_text.main_text(f"<body><article><h1>Wall</h1><p>{ONE}</p><p>{TWO}</p></article><div>{teasers}</div></body>") == f"Wall\n\n{ONE}\n\n{TWO}"

    def split(node):
        return set() if node.low is None else {html_text.FEATURES[node.feature]} | split(node.low) | split(node.high)

    assert split(html_text.tree()) & {"links_before", "links_after"}


def test_long_class_words():
    page = f'<div class="{"x" * 50}"><p>{ONE}</p></div><div class="newsletter{"x" * 50}"><p>{TWO}</p></div>'
    assert html_text.main_text(page) == ONE


@pytest.mark.parametrize("tag", ["<div>", "<b>", "<a href=x>", '<span class="ad">', "<li>", "<textarea>", "<svg>", "<form>", '<a b="', "<b class=ad><div class=ad></b>", "</div>", "<"])
def test_work_is_linear(tag):
    """Twenty times as many tags may take forty times as long, not four hundred times."""

    def took(n):
        began = time.process_time()
        html_text.main_text(f"<article><p>{ONE}</p>" + tag * n + TWO)
        return time.process_time() - began

    html_text.tree()
    assert took(100_000) < max(40 * took(5_000), 3)


def test_whole_pages_of_sf001(spark):
    """All pages of sf0.01 against a plain reading of their article element."""
    t = pq.read_table("/root/testdata/sf0.01/pages.parquet")
    pages = dict(zip(t["page_id"].to_pylist(), t["html"].to_pylist(), strict=True))
    got = {r["page_id"]: r for r in queries.op2_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        body = re.search(r"<article>(.*?)(?:</article>|<footer|$)", page or "", re.S)
        parts = re.split(r"</?(?:p|h1|h2|ul|li|div|article)\b[^>]*>", body[1]) if body else []
        texts = [" ".join(html.unescape(re.sub(r"<br>", " ", x) if "<br>" in x else x).replace("<b>", "").replace("</b>", "").split()) for x in parts]
        assert got[i]["text"] == "\n\n".join(x for x in texts if x) and got[i]["n_chars"] == len(got[i]["text"])
