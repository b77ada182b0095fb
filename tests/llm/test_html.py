"""Main text of pages."""

from __future__ import annotations

import re
import time
from html import unescape

import pytest

from lakeops.llm import html
from lakeops.llm.checks import QUERIES

SF_DIR = "/root/testdata/sf0.01"
SENTENCE = "This is a paragraph of the article and it has many of the words that are in the list."


def brute(page):
    """The given pages keep their text in one article: its blocks end at headings and paragraphs."""
    article = re.search(r"(?s)<article>(.*?)(?:</article>|<footer>|$)", page)
    inside = re.sub(r"<[^>]*$", "", article[1]) if article else ""
    blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_query_equals_brute_force(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = QUERIES["op13_html_extraction"](spark, SF_DIR).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.text, r.url) == (brute(pages[r.page_id].html), pages[r.page_id].url) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<main><h1>Title</h1><p>{SENTENCE}<p>Tiny.</main>", f"Title\n{SENTENCE}\nTiny."),
        (f"<nav>Home</nav><p>{SENTENCE}</p><p>Tiny.</p><footer>{SENTENCE}</footer>", f"{SENTENCE}\nTiny."),
        (f"<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>{SENTENCE}<footer>tags</footer></article>", f"T\n{SENTENCE}"),
        (f"<div class='cookie-notice'><p>{SENTENCE}</p></div><article><p>One.</p></article>", "One."),
        (f"<article><p>A</p><div id='ad_7'>{SENTENCE}</div><aside>{SENTENCE}</aside><p>B</p></article>", "A\nB"),
        (f"<article><p>A</p></article><section id=comments><article><p>{SENTENCE}</p></article></section>", "A"),
        (f"<body class='has-sidebar'><p>{SENTENCE}</p><div class='sidebar'><p>{SENTENCE}</p></div>", SENTENCE),
        (f"<form id=f><div><h1>T</h1><p>{SENTENCE}</p></div></form>", f"T\n{SENTENCE}"),
        (f"<article><p>A</p><form><p>{SENTENCE}</p><label>Mail</label><input value='x'></form></article>", "A"),
        ("<article><p>a &lt;b&gt; &amp;amp; &nbsp;\n c&#233;<br>d</p></article>", "a <b> &amp; cé d"),
        ("<article><script>var t = '</p><p>x';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p></article>", "yes"),
        ("<article><p title='a > b' data-x=\"<p>\">one</p><p hidden>no</p><p style='display: none'>no</p></article>", "one"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>", "one\ntwo\nc\nd"),
        ("<article><p>cut off <a href='http", "cut off"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        (f"<p>{SENTENCE}</p><ul><li><a href=/a>one link</a><li><a href=/b>other link</a></ul>", SENTENCE),
        (f"<p>{SENTENCE}</p><p>Short one.</p><ul><li><a href=/a>link</a></ul>", f"{SENTENCE}\nShort one."),
        ("just text", "just text"), ("<p>漢字だけの文章です</p>", "漢字だけの文章です"), ("", ""), ("<p>  </p>", ""), (None, ""),
    ],
)
def test_rules(page, text):
    assert html.main_text(page)[0] == text


def test_short_blocks_inherit():
    blocks = html.Page(f"<p>{SENTENCE}</p><p>near good</p><div><a href=/x>{'link ' * 5}</a></div><p>near bad</p><div><a href=/x>links</a></div>").blocks
    html.first_pass(blocks)
    assert [b.label for b in blocks] == [html.GOOD, html.OPEN, html.BAD, html.OPEN, html.BAD]
    assert html.second_pass(blocks)[3] == html.BAD


def test_odd_pages(spark):
    rows = [(1, None), (None, ""), (2, "<p>x"), (2, "<p>x"), (3, f"<article>{f'<p>{SENTENCE}</p>' * 20_000}</article>")]
    df = spark.createDataFrame([(i, h, "t", 1) for i, h in rows], "page_id long, html string, text string, n_blocks int")
    got = df.select("page_id", "text", html.extract("html").alias("r")).collect()
    assert [r.r.text for r in got[:4]] == ["", "", "x", "x"] and got[4].r.n_kept == 20_000
    assert df.limit(0).select(html.extract("html")).count() == 0


@pytest.mark.parametrize("part", ["<a ", '<a b=">"', "<b>", "<div>", "<ul><li>", "<!--", "<script>", "<span class=ad>", "<p class=x>a ", "&am", "< "])
def test_linear_on_broken_pages(part):
    start = time.process_time()
    html.main_text(part * 30_000 + "</i></p></li>" * 1000)
    assert time.process_time() - start < 8
