"""Pages whose content stands in marked wrappers or in several containers."""

import math
import random

import fractus.llm.pages as pages
from fractus.llm.pages import clusters, main_text

LONG = "A long sentence of the text that goes on and on for the reader. "


def paragraphs(name, n=4):
    return "".join(f"<p>{LONG * 3}{name}{i}</p>" for i in range(n))


def ends(html):
    return [line.split()[-1] for line in main_text(f"<html><body><nav><a href=x>Menu</a></nav>{html}<footer>Foot</footer></body></html>").split("\n")]


def test_marked_wrappers():
    want = ["Title", "a0", "a1", "a2", "a3"]
    for mark in ("page has-sidebar", "layout no-sidebar social", "widget", "header", "comments"):
        assert ends(f'<div class="{mark}"><article><h1>Title</h1>{paragraphs("a")}</article></div>') == want
        assert ends(f'<div class="{mark}"><h1>Title</h1>{paragraphs("a")}</div>') == want


def test_marks_within_the_article():
    inner = '<h2 id="notice-of-intent">Intent</h2><p class="alert">Beware.</p><h2 class="notice">Note</h2><section id="related-work"><h2>Work</h2><p>Before.</p></section>'
    page = f'<article>{paragraphs("a")}{inner}<div class="ad">Buy</div><div class="share">Share</div><p>End.</p></article>'
    assert ends(page) == ["a0", "a1", "a2", "a3", "Intent", "Beware.", "Note", "Work", "Before.", "End."]
    comments = f'<div class="related"><article><h3>Other</h3></article></div><section id="comments">{paragraphs("c")}</section>'
    assert ends(f'<article>{paragraphs("a")}</article>{comments}') == ["a0", "a1", "a2", "a3"]


def test_several_containers():
    assert ends(f'<article>{paragraphs("a")}</article><article><h2>Second</h2>{paragraphs("b", 2)}</article>') == ["a0", "a1", "a2", "a3", "Second", "b0", "b1"]
    assert ends(f'<main><h1>Title</h1>{paragraphs("m")}<article>{paragraphs("a", 2)}</article><p>End.</p></main>') == ["Title", "m0", "m1", "m2", "m3", "a0", "a1", "End."]
    assert ends(f'<div><h1>Title</h1>{paragraphs("a", 12)}</div><div>{paragraphs("z", 1)}</div>') == ["Title", *[f"a{i}" for i in range(12)], "z0"]


def test_inline_marks():
    assert main_text('<article><p>One <span class="share">x</span>two</p></article>') == "One two"


def brute_clusters(lines):
    """Ratio, Gaussian smoothing and threshold, written out."""
    own = [len(text) / max(1, tags) for text, tags, *_ in lines]
    smoothed = []
    for i in range(len(own)):
        weight = {j: math.exp(-0.5 * (i - j) ** 2) for j in range(max(0, i - 3), min(len(own), i + 4))}
        smoothed.append(sum(own[j] * w for j, w in weight.items()) / sum(weight.values()))
    mean = sum(smoothed) / len(smoothed)
    least = min(math.sqrt(sum((x - mean) ** 2 for x in smoothed) / len(smoothed)), max(smoothed))
    return [x >= least - 1e-9 for x in smoothed], [x >= least - 1e-9 and y >= least - 1e-9 for x, y in zip(smoothed, own)]


def test_clusters_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        lines = [("x" * rng.choice((1, 5, 30, 200, 900)), rng.randrange(1, 12), (), []) for _ in range(rng.randrange(1, 40))]
        assert tuple(x.tolist() for x in clusters(lines)) == brute_clusters(lines)


def test_ratios_select_the_region(monkeypatch):
    """Without elements or marks that say what is what, and with teasers that are articles too, the ratios alone decide."""
    links = "".join(f"<p><a href=x{i}>Link {i}</a> <i>{i}</i></p>" for i in range(8))
    bare = f"<div>{links}</div><div><h1>Title</h1>{paragraphs('a')}<p>Short.</p>{paragraphs('b')}</div><div>{links}</div>"
    cards = "".join(f"<article><h3><a href=x{i}><b>Story {i}</b></a></h3><p><a href=y{i}>More</a></p></article>" for i in range(9))
    flat = f"{links}{paragraphs('a')}<p>Short.</p>{paragraphs('b')}{links}"
    for html, first in ((bare, ["Title"]), (f"<article><h1>Title</h1>{paragraphs('a')}<p>Short.</p>{paragraphs('b')}</article>{cards}", ["Title"]), (flat, [])):
        want = [*first, "a0", "a1", "a2", "a3", "Short.", "b0", "b1", "b2", "b3"]
        assert ends(html) == want
        with monkeypatch.context() as m:
            m.setattr(pages, "smooth", lambda values: values * 0 + 1.0)
            assert ends(html) != want


def test_open_heads_and_line_breaks():
    assert main_text("<html><head><title>T</title><p>First<br>line.<p>Second.") == "First line.\nSecond."
    assert main_text("<head><script>x</script><noscript><p>n</p></noscript><title>T</title><div>Text</div>") == "Text"
    assert main_text('<article><p class="social-history">Kept</p></article>') == "Kept"
