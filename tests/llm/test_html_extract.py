"""Main text of pages: what goes at any size, what stays, time by depth, odd tables, and the given pages against plain expressions."""

from __future__ import annotations

import html
import random
import re
import time

import duckdb
import pytest

from underwright.llm import html_extract, queries

SF = "/root/testdata/sf0.01"
WORDS = "Some long text, that is, the content of it."
TALK = "I, too, think so, very much, indeed, as do all, of them, who read it, here."
TEXT = f"<p>{WORDS}</p><p>{WORDS}</p>"
TWO = f"{WORDS}\n{WORDS}"


def many(part, n=6):
    return part * n


@pytest.mark.parametrize("aside", [
    f"<section class=comments>{many(f'<p>{TALK}</p>')}</section>", f"<div id=comments>{many(f'<article><p>{TALK}</p></article>')}</div>", f"<ol class='comment-list'>{many(f'<li class=comment><p>{TALK}</p>')}</ol>",
    f"<div class=commentsArea>{many(f'<p>{TALK}</p>')}</div>", f"<div id=respond>{many(f'<p>{TALK}</p>')}</div>", f"<div class=comment-content>{many(f'<p>{TALK}</p>')}</div>", f"<div id=disqus_thread>{many(f'<p>{TALK}</p>')}</div>",
    f"<div class=sidebar>{many(f'<p>{TALK}</p>')}</div>", f"<div class=left-sidebar><h2>Side</h2>{many(f'<p>{TALK}</p>')}</div>", f"<div class='advert big'>{many(f'<p>{TALK}</p>')}</div>", f"<div id=ad-1>{many(f'<p>{TALK}</p>')}</div>",
    f"<div class=related>{many(f'<p>{TALK}</p>')}</div>", f"<div role=complementary>{many(f'<p>{TALK}</p>')}</div>", f"<div class=cookie-notice>{many(f'<p>{TALK}</p>')}</div>", f"<div style='color:red; display: none'>{many(f'<p>{TALK}</p>')}</div>",
])
def test_beside_the_article_goes_at_any_size(aside):
    for page in (f"<article>{TEXT}</article>{aside}", f"<article>{TEXT}{aside}</article>", f"<div>{TEXT}</div>{aside}", f"{TEXT}{aside}", f"<main><h1>Head</h1>{TEXT}{aside}</main>", f"<div class=post><h1>Head</h1>{TEXT}</div>{aside}"):
        assert html_extract.extract(f"<html><body>{page}</body></html>").removeprefix("Head\n") == TWO, page


def test_articles_of_readers_go():
    talk = many(f"<article class=comment><p>{TALK}</p></article>")
    assert html_extract.extract(f"<body><div><article>{TEXT}</article>{talk}</div>") == TWO
    assert html_extract.extract(f"<body><article>{TEXT}{talk}</article>") == TWO
    assert html_extract.extract(f"<body><div class=comments>{many(f'<p>{TALK}</p>')}</div>") == ""


def test_words_of_a_layout_stay():
    for name in ("content-with-sidebar", "has-sidebar", "no-comments", "content-sidebar-wrap", "page-widget", "comments-open", "post hide-ads"):
        assert html_extract.extract(f"<body><div class='{name}'>{TEXT}</div><footer>x</footer>") == TWO, name
    assert html_extract.extract(f"<body><article>{TEXT}<section id=search><p>{WORDS}</section></article>") == f"{TWO}\n{WORDS}"
    assert html_extract.extract(f"<body><div class=sidebar><article>{TEXT}</article></div>") == TWO
    assert html_extract.extract(f"<body><div class=banner>{TEXT}</div>") == TWO  # nothing else is there


def test_two_articles_and_titles():
    assert html_extract.extract(f"<body><h1>Page</h1><article>{TEXT}{TEXT}</article><article><p>{WORDS}</p></article><article><a href=x>All of them</a></article>") == f"Page\n{TWO}\n{TWO}\n{WORDS}"
    header = "<header><h1>Title</h1><p>By someone</p><nav><a href=x>Up</a></nav></header>"
    assert html_extract.extract(f"<body><header><h2>Site</h2></header><article>{header}{TEXT}</article>") == f"Title\n{TWO}"
    assert html_extract.extract(f"<body><article>{TEXT}<header><div><h3>Part</h3>x</div></header><p>{WORDS}</p></article>") == f"{TWO}\nPart\n{WORDS}"


def test_what_is_not_closed_is_no_text():
    page = f"<body><article>{TEXT}</article>"
    for end in ("<!-- open <p>Not, text, at all</p>", "<!--", "<p", "<a href='x>Not, text", "</div", "<script>var a = '<p>no</p>'", "<style>p{}", "<!-->", "<!--->"):
        assert html_extract.extract(page + end) == TWO, end
    assert html_extract.extract(f"<body><article><p>{WORDS}</p><!--><p>{WORDS}</p><!-- a --></article>") == TWO


def test_time_grows_with_the_page_not_its_depth():
    def seconds(page):
        began = time.process_time()
        html_extract.extract(page)
        return time.process_time() - began

    for part in ("<div>a, b", "<div class=x><p>a, b", "<div class=comments><p>a", "<form><div>", "</b></i></div><div><span>x", "</p></li>", "<section><article><p>x", "<ul><li>a"):
        small, large = seconds(part * 5000), seconds(part * 20_000)
        assert large < 8 * small + 0.5, (part, small, large)
    assert seconds("<div>" * 4000 + f"<p>{WORDS}</p>" + "</div>" * 4000 + "</i>" * 50_000) < 2


def test_scores_against_climbing():
    rng = random.Random(3)
    for _ in range(20):
        page = "".join(rng.choice(["<div>", "<p>", "</div>", "</p>", "<ul><li>", "</ul>", "text, of, it ", "<a href=x>link</a>", "<h2>Head</h2>", "<section class=widget>", "</section>", "<blockquote>"]) for _ in range(200))
        tree = html_extract.read_tree(page)
        points, length = {}, {}
        html_extract.score(tree)
        for element, text, _ in tree.blocks:
            at, signed = element, False
            while at:
                signed, at = signed or bool(at.signs), at.parent
            value = (1 + text.count(",") + min(len(text) / 100, 3)) * (html_extract.DISCOUNT if signed else 1)
            at = element.parent if element.tag in ("p", "li", "h2", "blockquote") else element
            share = 1.0
            while at:
                points[id(at)] = points.get(id(at), 0) + value * share
                share, at = share / 2, at.parent
            at = element
            while at:
                length[id(at)] = length.get(id(at), 0) + len(text)
                at = at.parent
        assert all(e.score == pytest.approx(points.get(id(e), 0)) and e.length == length.get(id(e), 0) for e in tree.elements)


def plain(page):
    """The text of the only article by expressions: what the given pages hold."""
    body = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
    blocks = re.split(r"</?(?:p|h1|ul|li|div)[^>]*>", re.sub(r"<!--.*?-->", "", body, flags=re.DOTALL))
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_given_pages(spark, sf):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '/root/testdata/{sf}/pages.parquet'").fetchall())
    rows = queries.all_queries()["op2_html_extract"](spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == plain(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_odd_pages(spark):
    page = f"<body><article>{TEXT}</article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "u", None), (3, "u", ""), (4, "u", "<p>" * 3000), (5, "u", f"<body>{many(TEXT, 20_000)}"), (6, "u", "plain text"), (7, "u", "\x00<\x00p>&#0;&#x110000;&bogus;")]
    frame = spark.createDataFrame([(*r, "clash", 3, "x") for r in rows], "page_id long, url string, html string, text string, n_chars int, row string")
    found = html_extract.extract_pages(frame)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    sizes = sorted(((r["page_id"] or 0, r["n_chars"]) for r in found.collect() if r["page_id"] != 7))
    assert sizes == [(0, len(TWO)), (1, len(TWO)), (1, len(TWO)), (2, 0), (3, 0), (4, 0), (5, 40_000 * (len(WORDS) + 1) - 1), (6, 10)]
    assert html_extract.extract_pages(frame.limit(0)).count() == 0
