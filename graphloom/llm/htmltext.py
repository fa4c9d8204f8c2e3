"""Main text of web pages: streaming parser events, text-to-tag ratio per line, smoothing, clustering (operator 9).

The standard library's parser streams events; block boundaries cut the page into lines, each with its text, its number
of tags and its place in the element tree. Text-to-tag ratios along the page are smoothed with a Gaussian kernel and
split by a two-means threshold (a heading counts like the line after it, and lines that hardly differ are all above); the
lines above it vote with their length for the elements that hold them. The article elements, or a main element, are the
content where they hold half of the vote, and otherwise the deepest element that holds most of it, with every long line
above the threshold beside it. Every line of the content that is not furniture belongs to the text.

Furniture is told by element and role, and by class names and ids. A name speaks by its last telling word (`ad-slot` names
an ad, `copyright-law` does not name a copyright line); where a name only hints, or stands inside an article, it needs a
second vote: much of the element is links, or little of it is running text. A name that spells the element's own heading
is an address and no mark, and none removes an article's heading or the page's heading with most of its text.

Defined cases: null, empty and text-less pages give an empty text; unclosed, misnested and cut-off markup is read as
far as it goes; a head without an end tag ends at the first element of the body, and an element such as svg or noscript
that is never closed does not silence the page; marked sections are passed over; references without a semicolon are
decoded as browsers do; equal rows give equal texts.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object svg canvas math audio video map".split())
FURNITURE = frozenset("nav aside footer form menu dialog button select textarea input label fieldset option search".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words in class names and ids that may mark page furniture (a choice of this extractor, as are the three lists below).
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert alerts sidebar "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login search widget widgets popup modal overlay pagination pager toolbar skip skiplink copyright disclaimer".split()
)
#: Marks that need no second vote, wherever they stand.
DECISIVE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos cookie cookies consent gdpr notice notices sidebar comment comments commentlist disqus respond reply replies newsletter subscribe subscription signup login popup modal".split())
#: Words at the end of a name that tell of the page's make-up; the word before them tells what the element is.
MAKEUP = frozenset("area bar block body bottom box col column container content entry form frame group holder inner item items left line link links list main outer page panel part right row section slot story text thread title top unit wrap wrapper zone".split())
#: Words in a class name or id that tell a state or a layout and not what the element is.
STATES = frozenset("has no not is with without hide show hides shows enable enabled disabled open opened closed on off active inactive allow allowed layout results result page single template theme wp logged".split())
#: What a page's head may hold; any other element ends an unclosed head.
IN_HEAD = frozenset("title meta link style script base noscript template head html".split())
#: Unlinked characters from which a line counts as running text.
RUNNING = 60
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[^\W_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _mark(value: str) -> int:
    """What a class attribute or id says: 3 a mark that needs no second vote, 2 a mark, 1 a hint, 0 nothing."""
    found = 0
    for name in value.split():
        parts = [part.lower() for part in _PARTS.findall(name)]
        if any(part in STATES for part in parts):
            continue
        if "sidebar" in name.lower() or any(part in DECISIVE for part in parts):
            return 3
        while len(parts) > 1 and parts[-1] in MAKEUP:
            parts.pop()
        if any(part in MARKS for part in parts):
            found = max(found, 2 if parts[-1] in MARKS else 1)
    return found


def _words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class _Lines(HTMLParser):
    """Cuts a page into lines. Elements are numbered; parent[e] and name[e] keep the tree of block elements, hard[e] tells
    which are furniture by what they are, soft[e] how far a class name or id says so (see _mark), slug[e] the id. The open
    elements of a name are found by their places in the stack, so a page takes time in proportion to its length."""

    def __init__(self, silent: frozenset[str] = SILENT):
        super().__init__(convert_charrefs=True)
        self.silent = silent
        self.parent, self.name, self.hard, self.soft, self.slug = [-1], ["#page"], [False], [0], [""]
        self.stack = [0]
        self.open: dict[str, list[int]] = {}
        self.quiet: list[str] = []
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.in_link = False
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, linked characters, element

    def parse_marked_section(self, i, report=1):
        """Sections such as <![if x]> and <![endif]> are passed over."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def cut(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append((text, self.tags, min(self.linked, len(text)), self.stack[-1]))
                self.tags = 0
            self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.quiet == ["head"] and tag not in IN_HEAD:
            self.quiet.clear()
        if self.quiet:
            if tag == self.quiet[-1] and tag not in VOID or tag in self.silent and self.quiet[-1] == "head" and tag not in VOID:
                self.quiet.append(tag)
            return
        if tag in self.silent:
            if tag in BLOCK:
                self.cut()
            self.quiet.append(tag)
            return
        if tag == "body" and len(self.stack) > 1:
            self.cut()
        if tag == "br":
            self.text.append(" ")
            return
        if tag == "a":
            self.in_link = True
        hard, soft, slug = tag in FURNITURE or tag == "header", 0, ""
        for key, value in attrs:
            if key == "hidden" or value and (key == "aria-hidden" and value == "true" or key == "role" and value.lower() in ROLES or key == "style" and _HIDDEN.search(value)):
                hard = True
            elif value and key in ("class", "id") and tag not in ("html", "body", "main") and not (key == "id" and tag in HEADING):
                mark = _mark(value)
                slug = value if key == "id" and mark >= soft else "" if mark > soft else slug
                soft = max(soft, mark)
        if tag not in BLOCK:
            if tag in VOID or not (hard or soft):
                return
        else:
            self.cut()
            if tag in VOID:
                return
            top = self.name[self.stack[-1]]
            if top == "p" or tag == top and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self._close(len(self.stack) - 1)
        self.parent.append(self.stack[-1])
        self.name.append(tag)
        self.hard.append(hard)
        self.soft.append(soft)
        self.slug.append(slug)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.parent) - 1)

    def _close(self, place: int) -> None:
        """Closes the open elements from this place of the stack on."""
        while len(self.stack) > place:
            self.open[self.name[self.stack.pop()]].pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if self.quiet:
            if tag == self.quiet[-1]:
                self.quiet.pop()
            elif tag == "head" and "head" in self.quiet:
                self.quiet.clear()
            return
        if tag == "a":
            self.in_link = False
        if tag in BLOCK:
            self.cut()
        place = self._last(tag)
        # a stray end tag inside an article, main or body closes nothing outside it
        if place and (tag in ("html", "body", "main") or place >= max(map(self._last, ("article", "main", "body")))):
            self.cut()
            self._close(place)

    def _last(self, tag: str) -> int:
        places = self.open.get(tag)
        return places[-1] if places else 0

    def handle_data(self, data):
        if not self.quiet:
            self.text.append(data)
            if self.in_link:
                self.linked += len(data)

    def votes(self, weights: list[float]) -> list[float]:
        """The weights of the lines in each element and below it."""
        out = [0.0] * len(self.parent)
        for line, w in zip(self.lines, weights, strict=True):
            out[line[3]] += w
        for e in range(len(out) - 1, 0, -1):  # children have larger numbers than their parents
            out[self.parent[e]] += out[e]
        return out

    def furniture(self, soft: list[bool]) -> list[bool]:
        """Which elements are furniture or inside it; the headings of an article's own header aren't."""
        n = len(self.parent)
        bad, article, own = [False] * n, self.within("article", "main"), [False] * n
        for e in range(1, n):
            up, marked = self.parent[e], self.hard[e] or soft[e]
            # own: inside an article's header, and in nothing else there that is furniture
            own[e] = self.name[e] == "header" and not bad[up] and article[up] and not soft[e] or own[up] and not marked
            bad[e] = marked or bad[up] and not (own[e] and self.name[e] in HEADING)
        return bad

    def within(self, *names: str) -> list[bool]:
        """Whether each element is one of these or inside one."""
        out = [False] * len(self.parent)
        for e in range(1, len(out)):
            out[e] = out[self.parent[e]] or self.name[e] in names
        return out

    def named_furniture(self) -> list[bool]:
        """Which elements a class name or id makes furniture, other votes heard."""
        n = len(self.parent)
        plain = self.furniture([False] * n)
        article = self.within("article", "main")
        free = [max(0, len(x[0]) - x[2]) for x in self.lines]
        holds = self.votes([0.0 if plain[x[3]] else float(c) for x, c in zip(self.lines, free, strict=True)])
        size = self.votes([float(len(x[0])) for x in self.lines])
        linked = self.votes([float(x[2]) for x in self.lines])
        prose = self.votes([float(c) if c >= RUNNING else 0.0 for c in free])
        headed, first = [False] * n, [""] * n
        for e, name in enumerate(self.name):
            up = e
            while name in ("h1", "main") and not plain[e] and up >= 0 and not headed[up]:
                headed[up] = True
                up = self.parent[up]
        for text, _, _, e in self.lines:
            up = self.parent[e]
            while self.name[e] in HEADING and up > 0 and not first[up]:  # the first heading inside each element
                first[up] = text
                up = self.parent[up]
        out = [False] * n
        for e in range(1, n):
            level = self.soft[e]
            most = 2 * holds[e] > holds[0]
            if not level or headed[e] and (article[e] or most) or self.name[e] == "article" and most:
                continue
            running = 2 * prose[e] >= size[e] > 0 and 10 * linked[e] < 3 * size[e]
            words = _words(self.slug[e])
            address = len(words) > 1 and running and words == _words(first[e])
            out[e] = not address and (level == 3 or level == 2 and not article[e] or not running)
        return out


def _parsed(html: str) -> _Lines:
    """The page's lines. An element that is read in silence and never closed would silence the rest of the page, so the
    page is read again without passing over such elements (scripts and styles end a page in browsers too)."""
    silent = SILENT
    while True:
        p = _Lines(silent)
        p.feed(html)
        p.close()
        p.cut()
        unclosed = set(p.quiet) & silent - {"script", "style"}
        if not unclosed:
            return p
        silent -= unclosed


def two_means(x: np.ndarray, rounds: int = 20) -> float:
    """The threshold halfway between the centres of two clusters of x; below all of x if it has one value."""
    lo, hi = float(x.min()), float(x.max())
    if hi - lo < 1e-9:
        return lo - 1.0
    cut = (lo + hi) / 2
    for _ in range(rounds):
        up = x > cut
        if not up.any() or up.all():
            break
        new = (x[up].mean() + x[~up].mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def smoothed(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian means of x; at the ends over the values there are."""
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * np.square(np.arange(-r, r + 1) / sigma))
    return np.convolve(x, kernel)[r : r + len(x)] / np.convolve(np.ones(len(x)), kernel)[r : r + len(x)]


def extract(html: str | None, sigma: float = 1.0, most: float = 0.7, apart: float = 2.0, share: float = 0.25) -> str:
    """The main text: blocks joined by an empty line, white space inside a block turned into single spaces.

    Lines whose smoothed text-to-tag ratios differ by less than a factor of `apart` are one cluster. Beside the longest
    article element, others count that hold `share` of its vote and are not mostly links.
    """
    if not html:
        return ""
    p = _parsed(html)
    bad = p.furniture(p.named_furniture())
    if all(bad[x[3]] for x in p.lines):
        bad = p.furniture([False] * len(p.soft))
    lines = [x for x in p.lines if not bad[x[3]]]
    if not lines:
        return ""
    size = np.array([len(x[0]) for x in lines], float)
    ratio = np.log1p((size - [x[2] for x in lines]) / np.maximum(1, [x[1] for x in lines]))
    for k in range(len(lines) - 2, -1, -1):
        if p.name[lines[k][3]] in HEADING:
            ratio[k] = ratio[k + 1]
    smooth = smoothed(ratio, sigma)
    content = smooth > (two_means(smooth) if np.ptp(smooth) >= np.log(apart) else -1)
    p.lines = lines
    vote, linked = p.votes((size * content).tolist()), p.votes([float(x[2]) for x in lines])
    whole = p.votes(size.tolist())
    inner = p.within("article")
    total = vote[0]
    articles = [e for e in range(1, len(vote)) if p.name[e] == "article" and vote[e] > 0 and not inner[p.parent[e]] and 2 * linked[e] < whole[e]]
    mains = [e for e in range(1, len(vote)) if p.name[e] == "main" and vote[e] > 0 and 2 * vote[e] >= total]
    if articles and 2 * sum(vote[e] for e in articles) >= total:
        longest = max(vote[e] for e in articles)
        regions, named = {e for e in articles if vote[e] >= share * longest}, True
    elif mains:
        regions, named = {max(mains, key=lambda e: (vote[e], e))}, True
    else:
        regions, named = {max((e for e in range(len(vote)) if vote[e] >= most * total and p.name[e] not in ("p", *HEADING)), default=0)}, False
    inside = [False] * len(p.parent)
    for e in range(len(inside)):
        inside[e] = e in regions or e > 0 and inside[p.parent[e]]
    out = []
    for k, x in enumerate(lines):
        menu = not content[k] and x[2] >= 0.9 * len(x[0]) and p.name[x[3]] in ("li", "ul", "ol", "td") and not named
        # without an article element, long runs of plain text beside the region are content too
        beside = not named and content[k] and 4 * x[2] <= len(x[0]) and len(x[0]) >= 80
        if inside[x[3]] and not menu or beside:
            out.append(x[0])
    return "\n\n".join(out)


def main_text(pages: DataFrame, html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """pages with the main text of each row's whole page in `out_col`; other columns as they are."""
    work.ship(pages.sparkSession)

    @F.pandas_udf("string")
    def run(html):
        return html.map(extract, na_action=None)

    return pages.withColumn(out_col, run(F.col(html_col).cast("string")))


def op9(pages: DataFrame) -> DataFrame:
    name = work.fresh(pages, "main_text")
    found = main_text(pages.select("page_id", "url", "html"), out_col=name)
    return found.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))
