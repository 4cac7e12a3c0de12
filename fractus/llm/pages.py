"""Main text of web pages (operator 7): text-to-tag ratios of lines, smoothed and clustered.

The standard library's parser streams events of a page. Text between block
boundaries is a line, with the number of tags met since the line before. The
lines' text-to-tag ratios are smoothed by a Gaussian, and runs of lines above one
standard deviation are the clusters of content. Each cluster selects a region:
the innermost container around those of its lines that are above the threshold
by themselves. A region keeps all its lines, short ones too. Where a cluster's
lines have only the page in common, it selects a region in each part of the page.
What stands beside regions belongs to them if it lies between two of them, is a
heading, or holds sentences (:func:`with_siblings`). A page with a single article
element, or else a single main element, says itself what its region is; with
several articles a cluster is widened to the one around it.

Lines in elements that are never content (navigation, forms and so on) are left
out before, and so are those in elements marked as adverts, comments and the
like, unless these hold the article or more than little of the content.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded, slices

# Elements of HTML by their part in a page.
NEVER = frozenset("head title nav footer aside form script style noscript template iframe svg math canvas audio video object embed applet select option button textarea input fieldset dialog menu map datalist".split())
RAW = frozenset({"script", "style"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body main article section div td center".split())
#: What an opening tag closes, if it is open in the same container.
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
#: What may stand in a head; any other element closes it.
IN_HEAD = frozenset("head title meta link base style script noscript template".split())
#: Tokens of class, id and role that mark what isn't the article: the whole token or its last part (site-footer).
MARKED = frozenset("ad-box ad-banner cookie-notice cookie-banner cookie-consent share-buttons social-share related-posts comments-area comment-list comment-respond post-comments ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies widget widgets pagination pager toolbar login search searchbox contentinfo complementary dialog masthead topbar".split())
#: Marks of comments and adverts, which may be long beside a short article.
STRONG = frozenset("comment comments commentlist comments-area comment-list comment-respond post-comments disqus respond reply replies ad ads ad-box ad-banner adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
#: Marks of parts of a page that may be long in a page without an article element.
FIRM = frozenset("footer contentinfo nav navbar navigation menu sidebar cookie cookies consent gdpr newsletter pagination breadcrumb breadcrumbs".split())
#: First parts of tokens that mark as well (comments-section), and those with which a token tells of a layout.
FIRST = frozenset("comment comments cookie ad ads sidebar footer newsletter".split())
LAYOUT = frozenset("no has with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Shares of the content: more than this in a marked element, or most of it in one with a strong mark and without an article element beside it, and the mark doesn't count.
LITTLE, MOST = 0.2, 0.6
#: The end of a sentence, and how notes of ownership begin.
SENTENCE_END = re.compile(r"[.!?…。！？।؟][\"')\]”’»]*$")
OWNED = re.compile(r"(©|\(c\)\s|copyright\b)", re.I)


def weight_of(tokens: list[str]) -> int:
    """How strongly tokens of class, id and role mark an element: 0 not at all, 1 weakly, 2 firmly, 3 as comments or adverts."""
    best = 0
    for token in tokens:
        parts = re.split("[-_]+", token)
        if parts[0] in LAYOUT:
            continue
        for name in {token, parts[-1]} | ({parts[0]} & FIRST):
            best = max(best, 3 if name in STRONG else 2 if name in FIRM else name in MARKED)
    return best


class Line(NamedTuple):
    text: str
    tags: int
    inside: tuple[int, ...]
    parts: list[tuple[str, int, bool]]
    heading: bool
    plain: int  # characters but white space outside of links


class Lines(HTMLParser):
    """Lines of a page: text, tags before it, and the containers it lies in; marked elements can be left out afterwards."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # name, left out, number of the container or -1
        self.hidden = 0
        self.kinds: list[str] = []
        self.marks: list[tuple[int, int, int]] = []  # marked elements: the one around or -1, their depth, their weight
        self.mark = -1
        self.around: dict[int, int] = {}  # the innermost marked element around each article or main
        self.comments: set[int] = set()  # articles that are marked as comments or adverts themselves
        self.raw: list[tuple[list[tuple[str, int, bool]], int, tuple[int, ...], bool]] = []
        self.parts: list[tuple[str, int, bool]] = []  # text, marked element around it, if it is a link
        self.links = 0
        self.tags = 0

    def _end_line(self) -> None:
        if self.parts:
            self.raw.append((self.parts, self.tags, tuple(n for _, _, n in self.open if n >= 0), any(name in HEADINGS for name, _, _ in self.open)))
            self.parts = []
            self.tags = 0

    def _pop(self, to: int) -> None:
        while len(self.open) > to:
            name, out, _ = self.open.pop()
            self.hidden -= out
            self.links -= name == "a"
        while self.mark >= 0 and self.marks[self.mark][1] >= to:
            self.mark = self.marks[self.mark][0]

    def within(self, mark: int) -> list[int]:
        """A marked element and those around it."""
        out = []
        while mark >= 0:
            out.append(mark)
            mark = self.marks[mark][0]
        return out

    def lines(self, dropped: set[int]) -> list[Line]:
        """Lines without the text in the marked elements ``dropped``; their tags count for the line that follows."""
        out, tags = [], 0
        for parts, n, inside, heading in self.raw:
            tags += n
            text = " ".join("".join(d for d, mark, _ in parts if mark not in dropped).split())
            if text:
                plain = sum(len("".join(d.split())) for d, mark, link in parts if mark not in dropped and not link)
                out.append(Line(text, tags, inside, parts, heading, plain))
                tags = 0
        return out

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if tag == "br" and not self.hidden:
            self.parts.append((" ", self.mark, self.links > 0))
        if tag not in IN_HEAD and any(name == "head" for name, _, _ in self.open) and not any(name in ("noscript", "template") for name, _, _ in self.open):
            self._pop(next(i for i, x in enumerate(self.open) if x[0] == "head"))
        if tag in CLOSES:
            closed = CLOSES[tag].split()
            for i in range(len(self.open) - 1, -1, -1):
                name = self.open[i][0]
                if name in closed:
                    self._pop(i)
                    break
                if name in CONTAINERS or name in ("ul", "ol", "dl", "table"):
                    break
        if tag in VOID:
            return
        out = tag in NEVER
        inside = any(name in ("article", "main") for name, _, _ in self.open)
        if tag == "header" and not inside:
            out = True
        strong = False
        if tag not in ("html", "body", "main"):
            tokens = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower().split()
            if tokens and not out and not self.hidden and tag not in HEADINGS and tag != "p":
                weight = weight_of(tokens) or int(not inside and "header" in tokens)
                strong = weight == 3
                if weight if tag != "article" else strong:
                    self.marks.append((self.mark, len(self.open), weight))
                    self.mark = len(self.marks) - 1
            out = out or (tag != "article" and any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs))
        number = -1
        if tag in CONTAINERS:
            number = len(self.kinds)
            self.kinds.append(tag)
            if tag in ("article", "main"):
                self.around[number] = self.mark
                if strong:
                    self.comments.add(number)
        self.open.append((tag, out, number))
        self.hidden += out
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                break
            # A stray end of a phrase or paragraph doesn't close the container around it.
            if tag not in CONTAINERS and tag not in NEVER and tag != "header" and self.open[i][2] >= 0:
                break

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in RAW and self.open and self.open[-1][0] == tag and tag in ("svg", "iframe"):
            self._pop(len(self.open) - 1)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append((data, self.mark, self.links > 0))

    def close(self) -> None:
        super().close()
        self._end_line()


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel, "same") if len(values) >= len(kernel) else None
    if weight is None:  # fewer lines than the kernel is wide
        full = np.convolve(values, kernel)[reach : reach + len(values)]
        return full / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel, "same") / weight


def clusters(lines: list) -> tuple[np.ndarray, np.ndarray]:
    """Which lines lie in clusters, and which of these are above the threshold by themselves."""
    own = np.array([len(x[0]) for x in lines], float) / np.maximum(1, [x[1] for x in lines])
    ratio = smooth(own)
    least = min(ratio.std(), ratio.max())
    return ratio >= least, (ratio >= least) & (own >= least)


def left_out(page: Lines) -> set[int]:
    """Marked elements whose mark counts, and all marked ones within them."""
    if not page.marks:
        return set()
    lines = page.lines(set())
    if not lines:
        return set()
    content, _ = clusters(lines)  # nothing left out yet
    mass: Counter[int] = Counter()
    held: Counter[int] = Counter()
    total = 0
    for line, is_content in zip(lines, content.tolist()):
        if is_content:
            mass.update({n: len(line.text) for n in line.inside})
            for text, mark, _ in line.parts:
                size = len("".join(text.split()))
                total += size
                for n in page.within(mark):
                    held[n] += size
    # The article is the one with most content, if that isn't little; marks around it don't count.
    article = max((n for n in page.around if n not in page.comments), key=lambda n: (mass[n], -n), default=-1)
    stands = any(article in line.inside for line in lines)
    spared = set(page.within(page.around[article])) if article >= 0 and mass[article] > LITTLE * total else set()
    out: set[int] = set()
    for n, (above, _, weight) in enumerate(page.marks):
        beside = weight == 3 and stands and n not in page.within(page.around[article])
        if above in out or (n not in spared and (beside or held[n] <= (MOST if weight > 1 else LITTLE) * total)):
            out.add(n)
    return out


def regions(page: Lines, lines: list, cluster: list[int]) -> tuple[set[int], set[int]]:
    """Containers that a cluster selects by its lines above the threshold, and lines that it selects in no container but the page."""
    common = list(lines[cluster[0]].inside)
    for k in cluster[1:]:
        inside = lines[k].inside
        same = next((i for i, (a, b) in enumerate(zip(common, inside)) if a != b), min(len(common), len(inside)))
        del common[same:]
    named = [n for n in common if page.kinds[n] not in ("html", "body")]
    if named:
        for kind in ("article", "main"):
            around = [n for n in named if page.kinds[n] == kind]
            if around:
                return {around[-1]}, set()
        return {named[-1]}, set()
    kept: set[int] = set()
    parts: dict[int, list[int]] = {}
    direct = []
    for k in cluster:
        inside = lines[k].inside
        if len(inside) > len(common):
            parts.setdefault(inside[len(common)], []).append(k)
        else:
            direct.append(k)
    for part in parts.values():
        kept |= regions(page, lines, part)[0]
    # Of lines that stand on the page itself, short ones between those selected belong to them.
    alone = {k for k in range(direct[0], direct[-1] + 1) if len(lines[k].inside) == len(common)} if direct else set()
    return kept, alone


def with_siblings(page: Lines, lines: list[Line], containers: set[int], alone: set[int]) -> set[int]:
    """Numbers of the lines in the selected containers, of those selected alone, and of what belongs to them beside them.

    Beside a region stand the other parts of the first container around it that
    has any: containers of its kind, and lines of their own. They belong to it
    between two regions, unless they are but links; elsewhere lines that are
    headings or end a sentence, and containers that hold such a sentence and are
    no links for the most part. Notes of ownership don't.
    """
    kept = {k for k, line in enumerate(lines) if k in alone or not containers.isdisjoint(line.inside)}
    parts: dict[int, dict[int, list[int]]] = {}  # of each container: its containers, or -1 - k for line k on its own
    for k, line in enumerate(lines):
        for n, below in zip(line.inside, (*line.inside[1:], -1 - k)):
            parts.setdefault(n, {}).setdefault(below, []).append(k)
    chosen: dict[int, set[int]] = {}
    for k in alone:
        if lines[k].inside:
            chosen.setdefault(lines[k].inside[-1], set()).add(-1 - k)
    above = {below: n for n, some in parts.items() for below in some if below >= 0}
    for n in containers:
        while n in above and len(parts[above[n]]) == 1:
            n = above[n]
        if n in above:
            chosen.setdefault(above[n], set()).add(n)

    def sentences(some: list[int]) -> bool:
        size = sum(len("".join(lines[k].text.split())) for k in some)
        ends = any(lines[k].plain and SENTENCE_END.search(lines[k].text) for k in some)
        return ends and 2 * sum(lines[k].plain for k in some) > size and not any(OWNED.match(lines[k].text) for k in some)

    for n, some in chosen.items():
        order = list(parts[n])
        places = [i for i, below in enumerate(order) if below in some]
        kinds = {page.kinds[below] for below in some if below >= 0}
        for i, below in enumerate(order):
            own = parts[n][below]
            if below in some:
                continue
            if below < 0:
                belongs = places[0] < i < places[-1] or sentences(own) or (lines[own[0]].heading and lines[own[0]].plain > 0)
            else:
                between = places[0] < i < places[-1] and any(lines[k].plain for k in own)
                belongs = between or (page.kinds[below] in kinds and sentences(own))
            if belongs:
                kept.update(own)
    return kept


def main_text(html: str | None) -> str:
    """Lines of the text of the page joined by newlines; empty if there is none."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    lines = page.lines(left_out(page))
    if not lines:
        return ""
    content, high = (x.tolist() for x in clusters(lines))
    for kind in ("article", "main"):
        named = {next((n for n in line.inside if page.kinds[n] == kind and n not in page.comments), -1) for line in lines} - {-1}
        if len(named) == 1:
            # A main element with content beside its article is the region itself.
            mains = {n for line in lines if not named.isdisjoint(line.inside) for n in line.inside if page.kinds[n] == "main"}
            wide = any(is_high and named.isdisjoint(line.inside) and not mains.isdisjoint(line.inside) for line, is_high in zip(lines, high))
            named = mains if wide else named
            return "\n".join(line.text for line in lines if not named.isdisjoint(line.inside))
        if named:
            break
    containers: set[int] = set()
    alone: set[int] = set()
    run: list[int] = []
    for k in range(len(lines) + 1):
        if k < len(lines) and content[k]:
            run.append(k)
        elif run:
            chosen, single = regions(page, lines, [i for i in run if high[i]] or run)
            containers |= chosen
            alone |= single
            run = []
    kept = with_siblings(page, lines, containers, alone)
    return "\n".join(line.text for k, line in enumerate(lines) if k in kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for ``pages`` (page_id, url, html).

    Null and empty pages, and pages without text outside of what is left out,
    give an empty text. Each row is taken alone: repeated rows give repeated
    results, null ids and urls stay null, other columns are ignored, an empty
    table gives no row. n_chars counts code points.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 2):
            texts = [main_text(h) for h in some.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return bounded(source).mapInArrow(extract, "page_id long, url string, text string, n_chars long")
