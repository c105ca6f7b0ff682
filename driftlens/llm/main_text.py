"""Main text of web pages from parser events, text-to-tag ratios and clustering.

The events of the standard library's HTML parser are read once, in order. Every block
element starts a line; a line has its text, the tags it took to write it, the share of
its text inside links, and its place in the element tree. The text-to-tag ratios of the
lines, in page order, are smoothed with a Gaussian and split into two clusters by a
threshold; runs of high lines are content regions, and runs with only unlinked text
between them are one. A region extends over the lowest block container that its lines
share (a container of one line is a paragraph and bounds nothing), so a short paragraph
between long ones stays; all regions are kept.

Articles and main parts bound regions, they are none by themselves: a region inside an
article is the whole article, one inside a main part without articles the whole part.
Articles side by side count as one when they are weighed. Beside a heavier region they are
teasers or a thread and go; if they are the heaviest, all of them stay, short ones too.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are known
by element, role or name and are never content. A name is a whole token of a class or id,
alone or with words that say nothing themselves (``related-posts``, not
``related-work``). Some names are also everyday words: inside an article they need a
second sign, links, form fields or short lines. A name or a form says little about an
element that wraps the page's main article or most of its text: that is layout, of which
only the form's labels go."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..checks import require_columns
from . import words as W

SIGMA = 1.0          # lines
SILENT = {"script", "style", "head", "title", "noscript", "template", "iframe", "object", "svg", "math", "canvas",
          "audio", "video", "select", "datalist", "button", "textarea"}
HEAD = {"head", "title", "base", "basefont", "bgsound", "link", "meta", "script", "style", "noscript", "template"}
ASIDE = {"nav", "footer", "aside", "menu", "dialog", "fieldset"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
          "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
          "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search",
          "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES_P = BLOCKS - {"body", "html", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "dd", "dt", "td", "th", "figcaption",
           "caption", "summary", "tr", "tbody", "thead", "tfoot", "table", "ul", "ol", "dl", "figure", "hgroup"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu",
         "menubar", "alert"}
#: Tokens of a class or id that name a part which is not the article.
NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "adsbygoogle", "banner", "breadcrumb", "breadcrumbs",
         "comment", "comments", "commentlist", "disqus", "consent", "cookie", "cookies", "gdpr", "footer", "foot",
         "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "subscribe", "signup", "notice",
         "notices", "alert", "popup", "modal", "overlay", "promo", "promoted", "promotion", "related", "recommended",
         "reply", "replies", "respond", "share", "sharing", "social", "sidebar", "sidenav", "sponsor", "sponsored",
         "toolbar", "widget", "widgets", "pagination", "pager", "login", "search", "skip"}
#: Those that name what readers wrote, which may well be most of a page's text.
DISCUSSION = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
#: Those that an article may also use for parts of its own, or in passing.
EVERYDAY = {"alert", "banner", "foot", "footer", "menu", "notice", "notices", "promotion", "recommended", "related", "search",
            "share", "sharing", "skip", "social", "toolbar"}
OWN_HEAD = {"header", "masthead"}   # an article's own, inside it
#: Words that may stand beside a name in one token without changing what it names.
BESIDE = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "desktop", "global", "grid",
          "group", "holder", "icon", "icons", "inline", "inner", "item", "items", "js", "left", "link", "links", "list",
          "mobile", "module", "outer", "page", "panel", "post", "posts", "primary", "region", "right", "row", "secondary",
          "section", "site", "slot", "story", "stories", "text", "title", "top", "unit", "wrap", "wrapper", "zone"}
FIELDS = {"input", "select", "textarea", "button"}
SHORT_LINE = 25      # characters a line, on average
ARTICLE = {"article", "main"}
# article text, asides by everyday name, by name or form, discussions, articles in articles, certain asides
NOT, DOUBTFUL, NAMED, READERS, NESTED, ASIDES = range(6)
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


def _named(value: str, inside_article: bool) -> int:
    """What the tokens of a class or id say (a kind, see above)."""
    kind = NOT
    for token in value.split():
        parts = {w.lower() for w in _SPLIT.split(token) if w and not w.isdigit()}
        names = parts & NAMES
        if inside_article:
            names -= OWN_HEAD
        if not names or parts - NAMES - BESIDE:
            continue
        if names & DISCUSSION:
            kind = max(kind, READERS)
        else:
            kind = max(kind, DOUBTFUL if inside_article and names <= EVERYDAY else NAMED)
    return kind


def _aside(tag: str, attrs: list, inside_article: bool, inside_form: bool) -> int:
    """How surely an element is not the article (its kind, see above)."""
    if tag in ASIDE or tag == "header" and not inside_article or tag == "label" and inside_form:
        return ASIDES
    kind = NAMED if tag == "form" else NOT
    for key, value in attrs:
        if key == "role" and value and value.strip().lower() in ROLES:
            return ASIDES
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and _UNSEEN.search(value):
            return ASIDES
        if key in ("class", "id") and value and tag not in ("body", "html", "article", "main"):
            kind = max(kind, _named(value, inside_article))
    return kind


class _Lines(HTMLParser):
    """Collects the lines of a page: text, tags, linked characters, container, article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, silent, aside (-1 certain, else number or 0), container
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.within: list[int] = []            # number of the innermost named aside of each line
        self.named: list[int] = [0]            # open named asides
        self.outer: dict[int, int] = {0: 0}    # named aside around each
        self.kinds: dict[int, int] = {0: NOT}  # kind of each named aside
        self.place: dict[int, int] = {}        # named aside around each article
        self.open = Counter()                  # open elements by tag
        self.fields = Counter()                # form fields by innermost named aside
        self.bounds: dict[int, str] = {}       # containers that are articles or main parts
        self.forms = 0
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0
        self.silent = self.asides = 0
        self.containers = 0
        self.article = 0           # number of the open article, 0 outside
        self.articles = 0
        self.parent: dict[int, int] = {0: -1}

    def _end_line(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self._container(), self.article))
            self.within.append(self.named[-1])
        self.text, self.tags, self.linked = [], 0, 0

    def _container(self) -> int:
        return self.stack[-1][3] if self.stack else 0

    def _end_head(self):
        """The end tag of head is optional."""
        if self.open["head"]:
            self.handle_endtag("head")

    def handle_starttag(self, tag, attrs):
        if tag == "body" or self.stack and self.stack[-1][0] == "head" and tag not in HEAD:
            self._end_head()
        if tag in FIELDS:
            self.fields[self.named[-1]] += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag == "hr":
                self._end_line()
            self.tags += 1
            return
        if tag in CLOSES_P and self.open["p"]:
            self.handle_endtag("p")
        elif tag in ("li", "dd", "dt", "td", "th", "tr", "option") and self.stack and self.stack[-1][0] == tag:
            self.handle_endtag(tag)
        silent = tag in SILENT
        kind = _aside(tag, attrs, self.article > 0, self.forms > 0)
        if tag == "article" and self.open["article"]:
            kind = max(kind, NESTED)
        if tag in BLOCKS or kind:
            self._end_line()
        aside = -1 if kind == ASIDES else 0
        if NOT < kind < ASIDES:
            aside = len(self.outer)
            self.outer[aside] = self.named[-1]
            self.kinds[aside] = kind
            self.named.append(aside)
        self.tags += 1
        container = self._container()
        if tag in BLOCKS and tag not in TEXTUAL:
            self.containers += 1
            self.parent[self.containers] = container
            container = self.containers
            if tag in ARTICLE:
                self.bounds[container] = tag
        if tag in ARTICLE and not self.article and not self.asides and not aside:
            self.articles += 1
            self.article = self.articles
            self.place[self.article] = self.named[-1]
        self.stack.append((tag, silent, aside, container))
        self.open[tag] += 1
        self.silent += silent
        self.asides += aside < 0
        self.forms += tag == "form"
        self.links += tag == "a"

    def handle_endtag(self, tag):
        if tag in VOID or not self.open[tag]:
            self.tags += 1
            if tag == "p" or tag == "br":
                self.text.append(" ")
            return
        # an inline end tag doesn't close the blocks that were opened inside it
        if tag not in BLOCKS and tag not in SILENT:
            for i in range(len(self.stack) - 1, -1, -1):
                name, silent, aside, _ = self.stack[i]
                if name == tag:
                    if aside:
                        self._end_line()
                    self._drop(i)
                    self.tags += 1
                    return
        while self.stack:
            name, _, aside, _ = self.stack[-1]
            if name in BLOCKS or aside:
                self._end_line()
            self._drop(len(self.stack) - 1)
            if name == tag:
                break
        self.tags += 1

    def _drop(self, i: int):
        tag, silent, aside, _ = self.stack.pop(i)
        self.open[tag] -= 1
        self.silent -= silent
        self.asides -= aside < 0
        if aside > 0:
            self.named.remove(aside)
        self.forms -= tag == "form"
        self.links -= tag == "a"
        if tag in ARTICLE and self.article and not (self.open["article"] or self.open["main"]):
            self.article = 0

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._end_head()
        if not self.silent and not self.asides:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self):
        super().close()
        self._end_line()

    def _asides_around(self, a: int) -> Iterator[int]:
        while a:
            yield a
            a = self.outer[a]

    def content_lines(self) -> list[tuple[str, int, int, int, int]]:
        """The lines outside asides. A named aside is layout if it holds the largest article
        (one among the readers' only if there is no other), or if it is no discussion,
        holds more than half of the unlinked text and no article is outside it. An aside of an everyday name inside an
        article needs a second sign, and an article inside one the larger text around it."""
        mass, linked, number, articles, within = Counter(), Counter(), Counter(), Counter(), Counter()
        for (text, _, link, _, article), aside in zip(self.lines, self.within):
            own = max(len(text) - link, 0)
            mass[aside] += own
            linked[aside] += link
            number[aside] += 1
            within[article] += own
            if article and aside == self.place[article]:
                articles[article] += own
        inner = {a: self.kinds[a] == NESTED for a in self.outer}
        nested = Counter()
        for (text, _, link, _, article), aside in zip(self.lines, self.within):
            a = aside
            while a and not inner[a]:
                a = self.outer[a]
            nested[article] += max(len(text) - link, 0) if a else 0
        article_of = {a: n for (_, _, _, _, n), a in zip(self.lines, self.within)}
        for a in range(len(self.outer) - 1, 0, -1):  # an aside is numbered after the one around it
            for c in (mass, linked, number, self.fields):
                c[self.outer[a]] += c[a]
        readers: set[int] = set()
        for a in range(1, len(self.outer)):
            if self.kinds[a] == READERS or self.outer[a] in readers:
                readers.add(a)
        around = {n: set(self._asides_around(a)) for n, a in self.place.items() if articles[n]}
        layout = {a for a in self.outer if self.kinds[a] != READERS and 2 * mass[a] > mass[0]
                  and all(a in x for x in around.values())} | {0}
        for a, kind in self.kinds.items():
            if kind == DOUBTFUL and not (2 * linked[a] >= mass[a] + linked[a] or self.fields[a]
                                         or mass[a] < SHORT_LINE * number[a]):
                layout.add(a)
            n = article_of.get(a, 0)
            if kind == NESTED and 2 * nested[n] > within[n]:
                layout.add(a)
        if self.place:
            layout.update(self._asides_around(
                self.place[max(self.place, key=lambda n: (self.place[n] not in readers, articles[n], -n))]))
        kept = {0}
        for a in range(1, len(self.outer)):
            if a in layout and self.outer[a] in kept:
                kept.add(a)
        return [x for x, aside in zip(self.lines, self.within) if aside in kept]


def lines_of(html: str):
    """(lines, parent of each container, bounds) of a page without asides and silent parts:
    a line is (text, tags, linked characters, container), ``bounds`` names the containers that
    are articles or main parts. Containers of a single line are left out."""
    p = _Lines()
    p.feed(html)
    p.close()
    lines = p.content_lines()
    own, parents = Counter(line[3] for line in lines), Counter(p.parent.values())

    def place(c: int) -> int:
        while c > 0 and own[c] == 1 and not parents[c] and c not in p.bounds:
            parents[p.parent[c]] -= 1
            own[p.parent[c]] += 1
            own[c] = 0
            c = p.parent[c]
            if own[c] > 1 or parents[c]:
                break
        return c

    return [(*line[:3], place(line[3])) for line in lines], p.parent, p.bounds


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends are weighted by what is inside."""
    r = int(np.ceil(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, w)[r:r + len(x)] / np.convolve(np.ones(len(x)), w)[r:r + len(x)]


def threshold(x: np.ndarray) -> float:
    """Border of two clusters (1-d 2-means from the extremes)."""
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        cut = (low + high) / 2
        up = x >= cut
        if up.all() or not up.any():
            return cut
        a, b = float(x[~up].mean()), float(x[up].mean())
        if (a, b) == (low, high):
            break
        low, high = a, b
    return (low + high) / 2


def content(html: str) -> str:
    """Main text of a page: its content lines in order, joined by newlines."""
    lines, parent, bounds = lines_of(html)
    if not lines:
        return ""
    raw = ratios(lines)
    ratio = smooth(raw)
    cut = threshold(ratio)
    up = ratio >= cut
    text = [2 * linked < len(words) for words, _, linked, _ in lines]
    bound = _bounds(parent, bounds)
    kept = set()
    for run in _regions(up, text):
        held = [lines[i][3] for i in run if raw[i] >= cut] or [lines[i][3] for i in run]
        kept.add(bound[_common(held, parent)])
    kept, gone = _weighed(kept, lines, parent, bounds, bound)
    inside = {-1: False}
    for c in range(len(parent)):
        inside[c] = c not in gone and (c in kept or inside[parent[c]])
    return "\n".join(line[0] for line, hot, own in zip(lines, up, text) if (hot or own) and inside[line[3]])


def _bounds(parent: dict[int, int], bounds: dict[int, str]) -> dict[int, int]:
    """For each container (numbered after the one around it) the outermost article around
    it; else the outermost main part, if no article is in that; else itself."""
    holds = {}                          # containers with an article inside
    for c in range(len(parent) - 1, 0, -1):
        if holds.get(c) or bounds.get(c) == "article":
            holds[parent[c]] = True
    out = {-1: -1}
    for c in range(len(parent)):
        at = out[parent[c]]
        if bounds.get(at) == "article" or at in bounds and not holds.get(at):
            out[c] = at
        else:
            out[c] = c
    return out


def _weighed(kept: set[int], lines, parent: dict[int, int], bounds: dict[int, str],
             bound: dict[int, int]) -> tuple[set[int], set[int]]:
    """``kept`` with whole groups of sibling articles, and the articles of the groups that are
    lighter than another region."""
    mass, inside, group, size = Counter(), Counter(), Counter(), Counter()
    for words, _, linked, c in lines:
        mass[c] += max(len(words) - linked, 0)
    outer = [a for a, tag in bounds.items() if tag == "article" and bound[a] == a]
    articles = set(outer)
    for c in range(len(parent) - 1, 0, -1):
        mass[parent[c]] += mass[c]
        inside[parent[c]] += mass[c] if c in articles else inside[c]
    for a in outer:
        group[parent[a]] += mass[a]
        size[parent[a]] += 1
    # a region that holds articles is weighed without them
    heaviest = max((mass[c] - inside[c] for c in kept - articles), default=-1)
    gone = {a for a in outer if size[parent[a]] > 1 and group[parent[a]] < heaviest}
    heavy = {parent[c] for c in kept & articles}
    return (kept | {a for a in outer if parent[a] in heavy}) - gone, gone


def _regions(up: np.ndarray, text: list[bool]) -> list[list[int]]:
    """Runs of high lines; two with nothing but unlinked text between them are one."""
    runs: list[list[int]] = []
    for i in np.flatnonzero(up).tolist():
        if runs and all(text[runs[-1][-1] + 1:i]):
            runs[-1].append(i)
        else:
            runs.append([i])
    return runs


def _common(containers: list[int], parent: dict[int, int]) -> int:
    """Lowest container that holds all of ``containers``."""
    path = []
    c = containers[0]
    while c >= 0:
        path.append(c)
        c = parent[c]
    at = {c: i for i, c in enumerate(path)}
    low = 0
    for c in set(containers):
        while c not in at:
            c = parent[c]
        low = max(low, at[c])
    return path[low]


def ratios(lines) -> np.ndarray:
    """Unlinked characters per tag of each line."""
    return np.array([(len(text) - linked) / max(tags, 1) for text, tags, linked, _ in lines], float)


def extract(pages: DataFrame, html_col: str = "html", keep=None) -> DataFrame:
    """``pages`` with text (empty if there is none) and n_chars (its code points); they
    replace columns of the same name, ``keep`` names the columns that go through.

    Null and empty html give the empty text. White space inside a block is one space;
    blocks are joined by one newline. Whole pages are read."""
    require_columns(pages, [html_col], "extract")
    names = [c for c in (keep or pages.columns) if c not in ("text", "n_chars")]
    out = T.StructType([pages.schema[c] for c in names] + [T.StructField("text", T.StringType()),
                                                           T.StructField("n_chars", T.LongType())])

    src, column = W.with_text(pages, names, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                texts = [content(h.as_py() or "") for h in b.column(column)]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*names, "text", "n_chars"])

    return src.mapInArrow(run, out)
