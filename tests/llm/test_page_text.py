"""Main text of pages: hand-made templates, brute force on the given pages, odd input."""

import html
import re

import pytest

from hangstats.llm import page_text as pt

SCHEMA = "page_id bigint, url string, html string"


def extract(spark, rows):
    got = pt.extract_pages(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", host string, template int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def plain_article(source):
    """Blocks of the article element, the plain way."""
    inside = re.search(r"(?s)<article>(.*?)(?:</article>|$)", source)[1]
    blocks = re.split(r"</?(?:p|h1|article|div)[^>]*>", inside)
    texts = (" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in pt.extract_pages(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for row in rows:
        text = got[row["page_id"]]["text"]
        assert text == plain_article(row["html"])
        assert got[row["page_id"]]["n_chars"] == len(text)


def page(i, body, title="t"):
    words = f"story {i} has its own words number{i} and goes on for a while so that it is the longest text here"
    return (
        f'<html><head><title>{title} {i}</title><script>if (a < b) x("</div>")</script></head><body class="has-sidebar">'
        f'<div class="top"><a href=/>Home</a> <a href=/n>News</a></div><div class="cookie-notice">We use cookies {i}</div>'
        f'<form><input name=q><button>Search {i}</button></form><div class="sidebar"><p>Other stories {i * 7}</p></div>'
        f'<div class="box"><h2>Heading {i}</h2><p>{words}</p><p>{body}</p><p>Read more stories on our site today</p></div>'
        f'<div id="comments"><p>reader {i} says so and so and much more than the story itself, really a lot of it {i}</p></div>'
        f'<div class="ad"><p>Buy {i}</p></div><footer>(c) {i}</footer></body></html>'
    )


def page_lines(i, body):
    words = f"story {i} has its own words number{i} and goes on for a while so that it is the longest text here"
    return f"Heading {i}\n{words}\n{body}"


def test_host_without_article_elements(spark):
    rows = [(i, f"https://a.example/{i}", page(i, f"A &amp; B&nbsp; {i}<br>\n&lt;c&gt; &#233;")) for i in range(12)]
    got = extract(spark, rows)
    wanted = [(i, f"https://a.example/{i}", page_lines(i, f"A & B {i} <c> é")) for i in range(12)]
    assert got == sorted(((*w, len(w[2])) for w in wanted), key=repr)


def test_copies_do_not_erase_an_article(spark):
    source = "<body><nav>Menu</nav><article><h1>Same</h1><p>One text for all pages.</p></article><footer>f</footer></body>"
    got = extract(spark, [(i, "http://b.example/x", source) for i in range(40)])
    assert {r[2] for r in got} == {"Same\nOne text for all pages."}
    assert len(got) == 40


def test_boilerplate_inside_an_article(spark):
    source = (
        '<main><header><h1>T</h1></header><p>one <i>two</i>\n three<div class="share">Share</div><aside>side</aside>'
        '<section class="reader-comments"><p>me too</p></section><ul><li>a<li>b</ul><p style="overflow:hidden">last'
        '<!-- <p>no</p> --><style>p{}</style></main><p>after</p>'
    )
    (row,) = extract(spark, [(1, "http://c.example/", source)])
    assert row[2] == "T\none two three\na\nb\nlast"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("no markup at all &amp; more", "no markup at all & more"),
        ("<p>unclosed <b>bold", "unclosed bold"),
        ("<article><p>1 < 2 and a <3</p></article", "1 < 2 and a <3"),
        ('<article><p title="a > b">x</p></article>', "x"),
        ("<script>never closed <p>x</p>", ""),
        ("<!-- never closed <p>x</p>", ""),
        ("</p></div>stray<table><tr><td>a<td>b</table>", "stray\na\nb"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
        ("<article><p>" + "word &amp; " * 200_000 + "</p></article>", " ".join(["word &"] * 200_000)),
    ],
)
def test_odd_pages(source, text):
    assert pt.main_text(source) == text


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>"), (None, "http://d.example", "<p>b</p>"), (2, "nonsense", None), (2, "nonsense", None)]
    got = extract(spark, rows)
    assert [r[2:] for r in got] == [("a", 1), ("", 0), ("", 0), ("b", 1)]
    assert extract(spark, []) == []


def test_large_templates_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(pt, "BROADCAST_BYTES", -1)
    rows = [(i, f"https://{i % 3}.example/{i}", page(i, f"body {i}")) for i in range(30)]
    assert [r[2] for r in extract(spark, rows)] == [page_lines(r[0], f"body {r[0]}") for r in extract(spark, rows)]


def test_class_order():
    assert pt._in_order([1, 5, 2, 1, 2], [1, 2], frozenset({9}))
    assert not pt._in_order([1, 2, 2, 1], [1, 2], frozenset({9}))
    assert not pt._in_order([1, 9, 2], [1, 2], frozenset({9}))
