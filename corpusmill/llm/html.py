"""Main text of web pages by text-to-tag ratio.

Streaming events of the standard library's parser turn a page into lines, one per
block element, with the code points of their text and the tags they hold. A link's
code points count a quarter; those in parts that are never main text (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments) count nothing, so that
their lines have a ratio of zero; scripts, styles and titles are no text at all. The
logarithms of the ratios, so that long paragraphs do not outweigh short ones, are smoothed by a Gaussian, and runs of
lines above a threshold (the mean less half a standard deviation, within bounds)
form clusters, without lines of ratio zero and without lines of links at
their ends. A line stays if it is in a cluster, or if its container holds lines of one and it is not mostly links.
What a page marks as its content (article or main) stays whole, but for such parts and for lists of links: three lines or
more in a row that are mostly links and whose smoothed ratios lie below a bound, as menus' short entries do and linked references don't.
Lines outside the marks do not take part, unless most of the whole page's
largest cluster lies there: then its clusters join the marked lines.

A part is known by its element, role, or by what a class or id names: ``cookie-notice``
and ``comment-list`` name a notice and comments, ``notice-period`` a period. Headings
are no such part.

Character references are decoded, white space inside a block becomes one space. A page
takes time in proportion to its length.

Defined results: a null or empty page, or one without content, gives an empty text;
unclosed and misnested elements end with their container; repeated rows are extracted
each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, LEAST_RATIO, MOST_RATIO = 1.5, 1.0, 3.0
#: Ratio below which lines of links are a list of links, and how many in a row make one.
LIST_RATIO, LIST_LINES = 2.5, 3

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page.
UNSEEN = frozenset("canvas datalist head iframe noscript script style svg template title".split())
#: Elements that are parts beside the main text.
ASIDE = frozenset("aside button dialog footer form label menu nav select textarea".split())
#: A header is a page's banner outside an article, and a title block inside one.
MARKED = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Blocks whose lines belong to the container around them.
_PLAIN = HEADINGS | frozenset("p li tr td th dt dd".split())
#: Elements that an unclosed paragraph ends with.
CLOSES_P = BLOCKS - {"body", "html", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
_ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
_LISTS = ("ul", "ol", "dl", "table", "select", "menu")
#: What a class or id names: menus, sidebars, notices, adverts, forms, footers, comments.
_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer menu modal nav navbar navigation newsletter notice notices pagination popup promo respond share sharing "
    "sidebar social sponsor sponsored sponsors subscribe toolbar widget".split()
)
#: Names of a page's own head; inside an article they may hold its title.
_HEAD = frozenset(("banner", "header", "masthead"))
#: Words after a part's name that tell its place or shape.
_SHAPES = frozenset(
    "area banner bar block body bottom box button buttons container content form group holder inner item items left links list message outer panel "
    "region right section signup slot thread top unit wrap wrapper".split()
)
_name_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_SPACE = re.compile(r"\s+")


@cache
def named(name: str) -> frozenset[str]:
    """What a class or id may name: its last word, and its last but those of place and shape."""
    words = [w.lower() for w in _name_words.findall(name) if len(w) > 1]
    last = words[-1:]
    while len(words) > 1 and words[-1] in _SHAPES:
        words.pop()
    return frozenset(last + words[-1:])


class Lines(HTMLParser):
    """Collects (text, ratio, container, marked, links) of each block; ``links`` tells
    whether most of its text is links and it is no heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, float, int, bool, bool]] = []
        self.open: list[tuple[str, int, bool, int]] = []  # tag, kind (0 text, 1 aside, 2 unseen), marked, container
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # depths of the open elements of each tag
        self.blocks: list[int] = []  # depths of the open blocks but paragraphs
        self.walls: list[int] = []  # those of them that no inline end tag closes
        self.parts: list[str] = []
        self.beside: list[str] = []
        self.link_chars = self.tags = self.links = self.made = 0

    def state(self) -> tuple[int, bool, int]:
        return self.open[-1][1:] if self.open else (0, False, 0)

    def last(self, *tags: str) -> int:
        """Depth of the innermost open element of these tags, or -1."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            _, marked, container = next((x[1:] for x in reversed(self.open) if not x[1]), (0, False, 0))
            links = min(self.link_chars, len(text))
            heading = bool(self.open) and self.open[-1][0] in HEADINGS
            self.lines.append((text, (len(text) - 0.75 * links) / max(1, self.tags), container, marked, not heading and 2 * links > len(text)))
        self.parts, self.link_chars, self.tags = [], 0, 0

    def flush_beside(self) -> None:
        if text := _SPACE.sub(" ", "".join(self.beside)).strip():
            _, marked, container = self.state()
            self.lines.append((text, 0.0, container, marked, False))
        self.beside = []

    def close_to(self, depth: int) -> None:
        # A block within a dropped element parts no line.
        if any(self.open[k][0] in BLOCKS and not (k and self.open[k - 1][1]) for k in range(depth, len(self.open))):
            self.flush()
        if self.beside:
            self.flush_beside()
        for tag, *_ in self.open[depth:]:
            self.links -= tag == "a"
            self.at[tag].pop()
        for depths in (self.blocks, self.walls):
            while depths and depths[-1] >= depth:
                depths.pop()
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            if tag in CLOSES_P and (depth := self.last("p")) > (self.blocks[-1] if self.blocks else -1):
                self.close_to(depth)
            if tag in _ALIKE and (depth := self.last(*_ALIKE[tag])) > self.last(*_LISTS, *(("tr",) if tag in ("td", "th") else ())):
                self.close_to(depth)
            if self.state()[0]:
                self.flush_beside()
            else:
                self.flush()
        kind, marked, container = self.state()
        self.tags += not kind
        if tag == "br" and not kind:
            self.parts.append(" ")
        if tag in VOID:
            return
        dropped = kind > 0
        found = {k: v or "" for k, v in attrs}
        if tag in UNSEEN:
            kind = 2
        elif tag in ASIDE or (tag == "header" and not marked):
            kind = max(kind, 1)
        elif attrs and tag not in HEADINGS and tag not in MARKED and tag not in ("html", "body"):
            names = frozenset().union(*map(named, f"{found.get('class', '')} {found.get('id', '')}".split()))
            if names & _PARTS or (not marked and names & _HEAD) or found.get("role", "").lower() in _ROLES:
                kind = max(kind, 1)
        if "hidden" in found or found.get("aria-hidden") == "true":
            kind = 2
        if tag in BLOCKS and tag not in _PLAIN:
            self.made += 1
            container = self.made
        if tag in MARKED and not kind:
            marked = True
        self.links += tag == "a"
        depth = len(self.open)
        self.at[tag].append(depth)
        if tag in BLOCKS and tag != "p":
            self.blocks.append(depth)
            if not dropped:
                self.walls.append(depth)
        self.open.append((tag, kind, marked, container))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):  # the others stay open, as in browsers
            self.close_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        kind = self.state()[0]
        self.tags += not kind
        depth = self.last(tag)
        if depth < 0:
            if tag == "p" and not kind:
                self.flush()
        # A dropped element ends although blocks within it (an option in a select) are open.
        elif tag in BLOCKS or depth > (self.walls[-1] if self.walls else -1):
            self.close_to(depth)

    def handle_data(self, data: str) -> None:
        kind = self.state()[0]
        if kind == 0:
            self.parts.append(data)
            if self.links > 0:
                self.link_chars += len(data)
        elif kind == 1:
            self.beside.append(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Logarithms of the ratios, each the Gaussian mean of its neighbours."""
    ratios = np.log1p(ratios)
    reach = int(3 * SIGMA)
    if len(ratios) > 2 * reach:
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
        return np.convolve(ratios, kernel, "same") / np.convolve(np.ones(len(ratios)), kernel, "same")
    near = np.exp(-0.5 * ((np.arange(len(ratios))[:, None] - np.arange(len(ratios))) / SIGMA) ** 2)
    return near @ ratios / near.sum(1)


def runs(flags: np.ndarray) -> np.ndarray:
    """First and last (not included) of every run of true flags."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0])))).reshape(-1, 2)


def regions(ratios: np.ndarray, links: np.ndarray, least: float = LEAST_RATIO) -> np.ndarray:
    """Which lines lie in content clusters: runs of smoothed ratios above the threshold,
    without lines of ratio zero and without lines of links at their ends. Without a least
    ratio (marked content) all lines do but those of ratio zero and lists of links."""
    smooth, kept = smoothed(ratios), ratios > 0
    if not least:
        at = np.flatnonzero(kept)  # parts of ratio zero do not divide a list
        for a, b in runs(links[at]):
            if b - a >= LIST_LINES and np.median(smooth[at[a:b]]) < np.log1p(LIST_RATIO):
                kept[at[a:b]] = False
        return kept
    threshold = min(max(smooth.mean() - 0.5 * smooth.std(), np.log1p(least)), np.log1p(MOST_RATIO))
    kept &= smooth >= threshold
    if (kept & links).any():
        # From both sides, a line of links needs a line of text between it and its run's end.
        text = np.cumsum(kept & ~links)
        number = np.cumsum(~kept)  # the same for all lines of a run
        first, last = np.searchsorted(number, number, "left"), np.searchsorted(number, number, "right") - 1
        before = text - np.where(first > 0, text[first - 1], 0)
        kept &= ~links | ((before > 0) & (text[last] - text > 0))
    return kept


def marks_hold(kept: np.ndarray, chars: np.ndarray, marked: np.ndarray) -> bool:
    """Whether half of the largest cluster's characters at least are in marked lines; so it is without clusters."""
    a, b = max(runs(kept), key=lambda c: chars[c[0] : c[1]].sum(), default=(0, 0))
    return 2 * chars[a:b][marked[a:b]].sum() >= chars[a:b].sum()


_OPENER = re.compile(r"<(?:!--|[!?/]|[a-zA-Z])")
_COMMENT_END = re.compile(r"--!?>")
#: A whole tag; its parts never give back what they took, so that a tag is read once.
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:'[^']*+'|"[^"]*+"|(?!['"])[^\s>]*+))?+|=)*+>""")
#: Elements that hold no tags, and no text of the page.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "textarea", "title")}


def tokens(html: str) -> Iterator[str]:
    """Tags and the texts between them, each whole, in one pass. What is never closed takes
    the rest of the page: a tag, a comment, or an element without tags in it."""
    at = 0
    while found := _OPENER.search(html, at):
        start = found.start()
        if start > at:
            yield html[at:start].replace("<", "&lt;")
        if found[0] == "<!--":
            end = _COMMENT_END.search(html, start + 2)
        elif found[0] in ("<!", "<?") or (found[0] == "</" and not html[start + 2 : start + 3].isalpha()):
            end = re.compile(">").search(html, start)
        elif end := _TAG.match(html, start):
            yield end[0]
            name = end[1].lower()
            if name in _RAW and found[0] != "</":
                if not (end := _RAW[name].search(html, end.end())):
                    return
                at = end.start()
                continue
        if not end:
            return
        at = end.end()
    if at < len(html):
        yield html[at:].replace("<", "&lt;")


def extract(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed("".join(tokens(html)))
    if parser.rawdata[:1] == "<":  # a tag that the parser does not take: it goes, the rest comes piece by piece
        rest = parser.rawdata
        parser.reset()
        for token in tokens(rest):
            parser.feed(token)
            if token[0] == "<" and parser.rawdata:
                parser.reset()
    parser.close()
    parser.close_to(0)
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    ratios, marked, links = (np.array([x[k] for x in lines]) for k in (1, 3, 4))
    kept = regions(ratios, links)
    if marked.any():
        if marks_hold(kept, np.array([len(x[0]) for x in lines]), marked):
            kept = np.zeros(len(lines), bool)
        kept[marked] |= regions(ratios[marked], links[marked], 0.0)
    inside = {x[2] for x, k in zip(lines, kept, strict=True) if k}
    return "\n\n".join(x[0] for x, k in zip(lines, kept, strict=True) if k or (x[2] in inside and x[1] > 0 and not x[4]))


def _extracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = [extract(h) for h in frame["html"]]
        yield pd.DataFrame(
            {"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]}
        )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(_extracted, "page_id long, url string, text string, n_chars long")
