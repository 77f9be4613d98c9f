"""Main text of pages and WARC archives."""

from __future__ import annotations

import hashlib
import time

import numpy as np
import pytest

from threadline.llm import html, warc

ARTICLE = "<article><h1>A title</h1><p>First <b>bold</b>\n  words &amp; more.<p>Of.</p><ul><li>one thing</li><li>two</li></ul></article>"
TEXT = "A title\nFirst bold words & more.\nOf.\none thing\ntwo"
PAGES = {
    "nothing": ("", ""),
    "plain": ("just   words\nhere", "just words here"),
    "article": (ARTICLE, TEXT),
    "around": (
        "<html><head><title>T</title><style>p{}</style></head><body><header><a href='/'>Home</a> Site name</header><nav><ul><li><a href=x>Menu</a></ul>"
        "</nav><div class='ad'>Buy this long advert text with many words in it now</div><div id=cookie-notice><p>We use cookies.</p></div>" + ARTICLE
        + "<aside><p>A side story with words.</p></aside><section class=comments><article class=comment><p>I do not agree at all.</p></article></section>"
        "<form>Name <input> <button>Send</button></form><footer>&copy; us</footer><script>var a='<p>no</p>';</script></body></html>",
        TEXT,
    ),
    "unclosed": ("<nav><a href=x>m</a></nav><article><p>one<p>two <b>three", "one\ntwo three"),
    "cut tag": ("<article><p>one</p><p>two</p><p cla", "one\ntwo"),
    "cut comment": ("<article><p>one</p><!-- two", "one"),
    "cut script": ("<article><p>one</p><script>two", "one"),
    "quoted bracket": ('<article><p title="a > b">one</p></article>', "one"),
    "broken quote": ('<article><p title="a>one</p><p>two</p></article>', "one\ntwo"),
    "references": ("<article><p>a&nbsp;b &lt;i&gt; &#233;&#x41; &unknown; AT&T</p></article>", "a b <i> éA &unknown; AT&T"),
    "link in text": ("<article><p>x <a href=y>link</a> z</p><p><a href=y>all link</a></p></article>", "x link z\nall link"),
    "inner furniture": ("<main><article><p>one</p><aside>side</aside><div class=share>Share</div><p>two</p></article></main>", "one\ntwo"),
    "no article": ("<div class=menu><a href=a>A</a></div><p>Some words here.</p><p>No.</p><div class=footer>F</div>", "Some words here.\nNo."),
    "teasers": (
        "<article><header class=entry-header><h1 class='post-header'>T</h1></header><p class=text>one</p></article>"
        "<aside><article><p>other story</p></article></aside><footer><p class='content text'>small print</p></footer>",
        "T\none",
    ),
    "whole page in a form": ("<form id=f><nav><a href=x>m</a></nav><article><p>one two</p></article></form>", "one two"),
    "comments as articles": ("<article><p>one</p></article><div id=comments><article><p>so true</p></article></div>", "one"),
    "less than": ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
}


WRAPPED = [
    "<article class='post no-comments'>{}</article>", "<main class='content has-sidebar'>{}</main>",
    *(f"<article class='{c}'>{{}}</article>" for c in ("ad-free", "form", "related", "notice")),
    "<div class='layout has-sidebar'><article>{}</article></div>", "<div class='layout sidebar-right'><article>{}</article></div>",
    "<div class='content has-sidebar'>{}</div>", "<div id=page class=modal-open><div class='site-notice'><main>{}</main></div></div>",
    "<form id=f class='search-form'><article class=entry>{}</article></form>",
]
TEASED = [
    "<div class=related><article>{}</article></div>", "<section id='comments'><div class='comment-list'><article>{}</article></div></section>",
    "<aside class='no-border'><article>{}</article></aside>", "<article><p>one</p><article class='comment'>{}</article></article>",
    "<div class='site-footer'><p>{}</p></div>", "<div style='display: none'><article>{}</article></div>", "<article hidden>{}</article>",
]


@pytest.mark.parametrize("around", WRAPPED)
def test_articles_win_over_class_words(around):
    assert html.main_text("<nav><a href=x>m</a></nav>" + around.format("<h1>A</h1><p>two words</p>") + "<footer>f</footer>") == "A\ntwo words"


@pytest.mark.parametrize("around", TEASED)
def test_teasers_and_comments_stay_out(around):
    assert "two words" not in html.main_text("<article><p>one</p></article>" + around.format("<p>two words</p>"))


def test_link_lists_of_an_article_are_its_text():
    links = "<ul><li><a href=a>First source of it</a></li><li><a href=b>Second</a></li></ul>"
    page = f"<nav>{links}</nav><article><p>one two</p>{links}<div class=menu>{links}</div></article><footer>{links}</footer>"
    assert html.main_text(page) == "one two\nFirst source of it\nSecond"


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, text = PAGES[name]
    assert html.main_text(page) == text


def test_the_tree_agrees_with_its_table():
    rows = np.array(html.LABELLED, float)
    assert ((html.decide(html.trained(), rows[:, :-1]) >= 0.5) == rows[:, -1]).all()


def test_every_row_has_a_text(spark):
    rows = [(1, "u", None), (None, None, ARTICLE), (2, "u", ""), (2, "u", ""), (3, "v", "<article><p>" + "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    found = {(r["page_id"], r["n_chars"]) for r in html.extract(pages).collect()}
    assert found == {(1, 0), (None, len(TEXT)), (2, 0), (3, 249_999)} and html.extract(pages).count() == 5
    assert html.extract(pages.limit(0)).count() == 0


LONG = "some words of running text that go on and on for a while"
FORMS = {
    "content in a form": (f'<body><form id="aspnetForm"><div class="content"><h1>T</h1><p>{LONG}</p></div></form></body>', f"T\n{LONG}"),
    "form around the page": (f"<body><form><nav><a href=x>menu</a></nav><h1>T</h1><p>{LONG}</p><input></form><footer>f</footer>", f"T\n{LONG}"),
    "form in an article": (f"<article><p>{LONG}</p><form><p>Your name</p><label>mail</label></form></article>", LONG),
    "form in a sidebar": (f"<article><p>{LONG}</p></article><div class=sidebar><form><div class=content><p>{LONG} x</p></div></form></div>", LONG),
    "hidden in print": (f'<article><div class="col hidden-print"><p>{LONG}</p></div><div class="row hidden-xs"><p>b</p></div></article>', f"{LONG}\nb"),
    "hidden": (f"<article><p>{LONG}</p><div class=hidden><p>b</p></div><div hidden><p>c</p></div></article>", LONG),
    "article word beside a teaser word": (f'<article><p>{LONG}</p></article><div class="article related"><p>b</p></div>', LONG),
}


@pytest.mark.parametrize("name", FORMS)
def test_forms_and_hiding(name):
    page, text = FORMS[name]
    assert html.main_text(page) == text


def test_deep_nesting_takes_linear_time():
    begin = time.time()
    assert html.main_text("<div>x" * 100_000).count("x") <= 100_000
    html.main_text("<div class=article>" * 50_000 + "</p></section>" * 50_000)
    assert time.time() - begin < 8


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Page-ID: 666\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n"
BODIES = [
    None, "", "a", "\r\n", "\r\n\r\n", "x\r\n", "x\r\n\r\n", "\r\n\r\n\r\n", FAKE, "text\r\n\r\n" + FAKE + "more", FAKE * 3 + "\r\n", "é" * 99, "same " * 30, "same " * 30,
    "same " * 30, "b\r", "\r\n\r", "short", "short", "z" * 300_000 + FAKE, "WARC/1.0\r\n", "t\r\n\r\nWARC/1.0\r\nContent-Length: 99999999\r\n\r\n", "\n\n" * 200,
]


def _want(rows):
    first = {}
    for i, body in sorted((i, b or "") for i, b in rows):
        first.setdefault(body, i)
    out = set()
    for i, b in rows:
        data = (b or "").encode()
        again = len(data) >= 100 and first[b or ""] < i
        out.add((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[b or ""] if again else None))
    return out


@pytest.mark.parametrize("split", ["128m", "700", "3000"])
def test_archives_come_back_whole(spark, split):
    """Also with splits shorter than a record, so that records reach over several of them."""
    rows = [(5 * i, b) for i, b in enumerate(BODIES)]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nWARC/1.0", b) for i, b in rows], "page_id long, url string, html string").coalesce(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = {tuple(r) for r in warc.round_trip(pages).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == _want(rows)


def test_no_pages_repeated_pages_and_null_ids(spark):
    schema = "page_id long, url string, html string, payload_digest string, first long"
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", "q" * 200, "x", 0), (1, "u", "q" * 200, "x", 0), (None, None, "q" * 200, "x", 0), (2, None, None, None, None)]
    found = sorted((str(r["page_id"]), r["record_type"]) for r in warc.round_trip(spark.createDataFrame(rows, schema)).collect())
    assert found == [("1", "response"), ("1", "response"), ("2", "response"), ("None", "response")]


def test_what_follows_a_broken_record_is_not_trusted(spark, tmp_path):
    good = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    broken = good.replace("Content-Length: 3", "Content-Length: 7")
    (tmp_path / "a.warc").write_bytes((good + broken + good).encode())
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r["offset"] for r in rows) == [0, len(good)]
    assert {bytes(r["payload"])[:3] for r in rows} == {b"abc"}
