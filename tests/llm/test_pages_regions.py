"""Which parts of a page without a single article element are its main text."""

import pytest

from fractus.llm.pages import main_text

SENTENCE = "The river carried the boats past the mill before noon."
LONG = " ".join([SENTENCE] * 4)


def body(inner):
    return f"<html><body>{inner}</body></html>"


SECTIONS = f"<section><h2>One</h2><p>{SENTENCE}</p></section><section><p>Short one.</p></section><section><h2>Three</h2><p>{LONG}</p><p>{LONG}</p></section>"
ALL = ["One", SENTENCE, "Short one.", "Three", LONG, LONG]


@pytest.mark.parametrize("inner", [f"<div>{SECTIONS}</div>", SECTIONS, f"<div><div>{SECTIONS}</div></div>", f"<div><a href=x>Home</a> <a href=y>News</a></div><div>{SECTIONS}</div><div>© 2020 Mill. All rights reserved.</div>"])
def test_sections_of_unequal_size(inner):
    assert main_text(body(inner)).split("\n") == ALL


def test_lines_of_the_page_itself():
    assert main_text(body(f"<h1>Title</h1><p>{LONG}</p><p>{SENTENCE}</p><p>Bye.</p>")).split("\n") == ["Title", LONG, SENTENCE, "Bye."]
    assert main_text(body(f"<p>{LONG}</p><h3>Between</h3><p>{LONG}</p>")).split("\n") == [LONG, "Between", LONG]


def test_a_short_article_beside_a_long_block():
    assert main_text(body(f"<article><h1>News</h1><p>{SENTENCE}</p></article><div>{LONG} {LONG}</div>")) == f"News\n{SENTENCE}"
    assert main_text(body(f"<main><p>{SENTENCE}</p></main><div>{LONG} {LONG}</div>")) == SENTENCE


@pytest.mark.parametrize("mark", ['class="user-comments"', 'id="reader-comments"', 'class="post_comments"', 'class="comments-section"', 'class="site-ad"'])
def test_comments_and_adverts(mark):
    for name in ("div", "section", "article"):
        page = body(f"<article><p>{LONG}</p><{name} {mark}><p>{LONG} I liked it.</p></{name}></article>")
        assert main_text(page) == LONG
    assert main_text(body(f"<article><p>{LONG}</p></article><article {mark}><p>{LONG} {LONG}</p></article>")) == LONG


def test_comments_as_articles():
    comment = f'<article class="comment"><p>{LONG} I liked it.</p></article>'
    assert main_text(body(f"<article><p>{LONG}</p>{comment}{comment}</article>")) == LONG


def test_footers_and_layout():
    assert main_text(body(f'<div><p>{LONG}</p><p>{LONG}</p></div><div class="site-footer">{LONG}</div>')) == f"{LONG}\n{LONG}"
    assert main_text(body(f'<div class="with-sidebar"><p>{LONG}</p></div>')) == LONG
    assert main_text(body(f'<div class="no-comments"><p>{LONG}</p></div>')) == LONG


def test_label_within_a_paragraph():
    assert main_text(body(f"<article><p>Press <label>Start</label> now.</p><form><label>Mail</label></form><p>{LONG}</p></article>")) == f"Press Start now.\n{LONG}"


def test_several_articles():
    assert main_text(body(f"<article><p>{LONG}</p></article><article><p>{LONG}</p></article>")).split("\n") == [LONG, LONG]


def test_links_between_regions_go():
    page = body(f"<div><section><p>{LONG}</p></section><section><a href=x>Home</a><a href=y>News</a></section><section><p>{LONG}</p></section></div>")
    assert LONG in main_text(page)
