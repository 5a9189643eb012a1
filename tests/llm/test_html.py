"""Main text of pages: given structures, cases of the markup, and the generated pages against their articles."""

import os
import random
import re
from html import unescape

import pytest

from triage.llm import html
from triage.llm import queries as q

LONG = "It is a long sentence, with commas, and it goes on for a while, so that it counts."
PARAS = [f"{LONG} Number {i}." for i in range(4)]
P = "".join(f"<p>{p}</p>" for p in PARAS)
AROUND = (
    '<nav><ul><li><a href="/">Home</a><li><a href="/x">X</a></ul></nav><header><h1>Site</h1></header>'
    '<div class="cookie-notice">We use cookies, many of them, and you agree, of course, to all of it.</div>{}'
    '<aside><p>Side story, with commas, and more, and more, and even more than that.</p></aside>'
    '<div id="comments"><article class="c"><p>' + LONG * 20 + "</p></article></div>"
    '<form><label>Mail</label><input><button>Send, now, please</button></form><footer>&copy; 2024, all rights</footer>'
)


@pytest.mark.parametrize("inner", [
    f"<article><h1>Title</h1>{P}</article>",
    f"<article><header><h1>Title</h1><span>by us</span></header>{P}<footer>Filed</footer></article>",
    f'<main><h1>Title</h1><article>{P}</article></main>',
    f'<div id="content"><h1>Title</h1>{P}</div>',
    f'<div class="x"><h1>Title</h1><div>{P[:len(P) // 2]}</div><div>{P[len(P) // 2:]}</div></div>',
    f'<div class="layout has-sidebar"><div class="post-header"><h1>Title</h1></div>{P}<div class="share-buttons">Share, it, now, here</div></div>',
    f'<table><tr><td><a href="/a">a</a><a href="/b">b</a></td><td><h1>Title</h1>{P}</td></tr></table>',
    f'<form id="aspnet"><h1>Title</h1>{P}<input value="no"></form>',
    f'<div class="sidebar-layout"><article><h1>Title</h1>{P}<ul class="related"><li>{LONG}</ul><div class="ad">Buy, buy, buy</div></article></div>',
    f'<article><h1>Title</h1><section>{P}</section><ul><li><a href="/1">More one</a><li><a href="/2">More two</a></ul></article>',
])
def test_article_in_many_pages(inner):
    if "</p>" not in inner:
        pytest.fail("the fixture has no paragraphs")
    assert html.main_blocks(f"<html><head><title>T</title></head><body>{AROUND.format(inner)}</body></html>") == ["Title", *PARAS]


@pytest.mark.parametrize(("page", "want"), [
    (None, []), ("", []), (" \n ", []), ("plain text &amp; more\n text", ["plain text & more text"]),
    ("<p>a<p>b", ["a", "b"]), ("<article><p><b>one<br><p>two</article>", ["one", "two"]),
    ("<p>a<br>b &lt;i&gt; &#65;&#x42; &nbsp; &eacute;&copy</p>", ["a b <i> AB é©"]),
    ("<p>1 < 2 and a<b>c</b>d</p>", ["1 < 2 and acd"]), ("<p>x<!-- <p>no --> y</p><!-- open <p>z", ["x y"]),
    ('<script>var t="</p><p>no";</script><p title="a>b">yes</p><style>p{}', ["yes"]),
    ("<ul><li>one<ul><li>in</ul><li>two</ul>", ["one", "in", "two"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>tail", ["a", "b", "c", "tail"]),
    ("<article><p>cut here and <a hre", ["cut here and"]), ("<nav><p>only a menu</p></nav><footer>f</footer>", []),
    ("<h1>Only</h1>", ["Only"]), ('<ul><li><a href="/a">one</a><li><a href="/b">two</a></ul>', []),
    ("<div hidden><p>no</p></div><p style='display: none'>no</p><p>yes</p>", ["yes"]),
    ("<dl><dt>t<dd>d<dt>u</dl><pre> a\n  b </pre><blockquote>q</blockquote>", ["t", "d", "u", "a b", "q"]),
    ("<article><p>a <span class='ad'>buy</span>b</p></article>", ["a b"]),
    ("<p>日本。</p></div></p></i>", ["日本。"]), ("<P CLASS=Ad>no</P><P>yes", ["yes"]),
])
def test_markup(page, want):
    assert html.main_blocks(page) == want


def test_deep_wide_and_broken_pages_end():
    assert html.main_blocks("<div>" * 50_000 + "deep, indeed" + "</div>" * 50_000) == ["deep, indeed"]
    assert len(html.main_blocks("<p>word, word" * 50_000)) == 50_000
    assert html.main_text('<p class="' * 20_000 + "x") == ""
    rng = random.Random(2)
    parts = ["<p>", "</p>", "<div>", "</div>", "<table>", "<td>", "</tr>", "<li>", "<a href=x>", "</a>", "<b>", "</b>", "x, y ", "<", ">", "&", "<!--", "-->", "<form>", "</form>", "<h1>", "</h2>", "<script>", "</script>", "<article>", "</article>", '"', "=", "<body>", "</html>"]
    for _ in range(3000):
        html.main_text("".join(rng.choices(parts, k=rng.randint(0, 40))))


def test_query_returns_the_generated_articles(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    want = {}
    for r in pages:
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [re.sub(r"<[^>]*(>|\Z)", "", x.replace("<br>", " ")) for x in re.split("</?(?:p|h1)>", body)]
        want[r.page_id] = "\n\n".join(x for x in (" ".join(unescape(p).split()) for p in parts) if x)
    got = q.QUERIES["op13_main_text"](spark, folder).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_rows_and_other_columns_stay(spark, tmp_path):
    rows = [(1, "u", "<p>a</p>", "old"), (1, "u", "<p>a</p>", "old"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = q.QUERIES["op13_main_text"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]))
    assert html.extract(pages, name="main").columns == ["page_id", "url", "text", "main"]
    assert html.extract(pages.where("false")).count() == 0
