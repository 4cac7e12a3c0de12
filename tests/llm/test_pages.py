"""Main text of pages on hand-made fixtures."""

from fractus.llm.pages import extract_pages, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad-box ad">Buy now</div>
<article><header><h1>Head&amp;line</h1></header><p><b>First   paragraph
with&nbsp;text.<br><p>Short.</p><ul><li>One<li>Two</ul><div class="share">Share me</div><form><p>Mail</p></form>
<aside>Aside</aside><section id="comments"><p>A reader wrote this long comment here</p></section><p>Last &eacute;.</p></article>
<div id="cookie-notice">We use cookies</div><footer>&copy; 2020</footer></body></html>"""


def test_article():
    assert main_text(PAGE).split("\n") == ["Head&line", "First paragraph with text.", "Short.", "One", "Two", "Last é."]


def test_without_article_element():
    body = "".join(f"<p>{'Long sentence of the main text goes on and on. ' * 4}{i}</p>" for i in range(4))
    page = f"<html><body><div><a href=x>a</a><a href=y>b</a></div><div id=x><h2>Title</h2>{body}<p>End.</p></div><div><a>c</a> <a>d</a></div></body></html>"
    lines = main_text(page).split("\n")
    assert lines[0] == "Title" and lines[-1] == "End." and len(lines) == 6


def test_edges():
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<nav>x</nav>") == ""
    assert main_text("plain text only") == "plain text only"
    assert main_text("<article><p>a<script>x</script>b</p>") == "ab"
    assert main_text("<article>" + "<div>" * 3000 + "deep") == "deep"


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "y"), (None, None, None, "z"), (2, "v", "", "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in extract_pages(pages).collect())
    assert got == [(0, 0, 0), (1, len(main_text(PAGE)), len(main_text(PAGE)))] + [(1, len(main_text(PAGE)), len(main_text(PAGE)))] + [(2, 0, 0)]
    assert extract_pages(pages.limit(0)).count() == 0
