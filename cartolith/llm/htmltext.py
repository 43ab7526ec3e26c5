"""Main text of web pages: flat text blocks, shallow features, a decision tree.

A page is cut into text blocks at block-level tags, in one pass of a tag scanner that forgives unclosed
tags. A block is described by its words, its share of words in links, the same of its two neighbours,
the kind of region it stands in and whether it is a heading. A decision tree trained on the labelled
table below, at every start, says which blocks are main text. Where markup shows no region, words and links
of a block and its neighbours decide, as learnt from labelled pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "region", "heading")

#: Labelled blocks, made up, of pages with signs of regions: the features in order, then 1 for main text. region: -1 furniture,
#: 0 unknown, 1 article.
MARKED = (
    # menus, headers, footers, sidebars, notices, adverts, forms, comments by their region, of any size
    (1, 1.0, 1, 1.0, 1, 1.0, -1, 0, 0), (2, 1.0, 0, 0.0, 1, 1.0, -1, 0, 0), (6, 0.0, 1, 1.0, 9, 0.0, -1, 0, 0),
    (12, 0.1, 40, 0.0, 0, 0.0, -1, 0, 0), (35, 0.0, 60, 0.0, 22, 0.0, -1, 0, 0), (80, 0.0, 90, 0.0, 70, 0.0, -1, 0, 0),
    (4, 0.0, 30, 0.0, 25, 0.0, -1, 1, 0), (150, 0.05, 8, 0.0, 120, 0.0, -1, 0, 0), (9, 0.6, 100, 0.0, 3, 1.0, -1, 0, 0),
    (3, 0.0, 3, 1.0, 50, 0.0, -1, 1, 0), (18, 0.0, 0, 0.0, 0, 0.0, -1, 0, 0), (600, 0.0, 500, 0.0, 400, 0.0, -1, 0, 0),
    # paragraphs, headings, lists and links inside articles
    (8, 0.0, 2, 1.0, 60, 0.0, 1, 1, 1), (60, 0.0, 8, 0.0, 45, 0.0, 1, 0, 1), (2, 0.0, 50, 0.0, 70, 0.0, 1, 0, 1),
    (1, 0.0, 30, 0.0, 8, 0.2, 1, 0, 1), (120, 0.1, 60, 0.0, 7, 0.0, 1, 0, 1), (5, 0.0, 120, 0.1, 80, 0.0, 1, 1, 1),
    (14, 1.0, 40, 0.0, 40, 0.0, 1, 0, 1), (3, 1.0, 5, 0.0, 4, 1.0, 1, 0, 1), (400, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1),
    (25, 0.3, 30, 0.2, 28, 0.3, 1, 0, 1), (7, 0.0, 90, 0.0, 12, 0.1, 1, 0, 1), (1, 1.0, 1, 0.0, 1, 0.0, 1, 0, 1),
    (130, 0.0, 60, 0.0, 1, 1.0, 1, 0, 1), (300, 0.0, 9, 0.0, 3, 1.0, 1, 0, 1), (110, 0.9, 20, 0.9, 2, 1.0, 1, 0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 1, 0, 1), (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 1), (30, 0.8, 2, 1.0, 25, 0.9, 1, 0, 1),
    (3, 0.0, 2, 1.0, 2, 1.0, 1, 0, 1), (6, 0.5, 3, 0.5, 0, 0.0, 1, 0, 1), (60, 0.7, 50, 0.0, 1, 1.0, 1, 0, 1),
)

#: Labelled blocks, made up, of pages without signs of regions: long lists of links and their headings are furniture, text with some
#: links and its headings aren't, also beside lists of links.
LINKED = (
    (30, 0.95, 25, 0.9, 28, 1.0, 0, 0, 0), (18, 1.0, 20, 1.0, 0, 0.0, 0, 0, 0), (45, 0.8, 40, 0.9, 35, 0.85, 0, 0, 0), (24, 0.7, 30, 0.0, 20, 1.0, 0, 0, 0),
    (60, 0.9, 9, 0.0, 50, 0.9, 0, 0, 0), (22, 0.6, 25, 0.7, 30, 0.65, 0, 0, 0), (120, 1.0, 4, 0.0, 15, 0.0, 0, 0, 0), (20, 0.9, 60, 0.0, 80, 0.0, 0, 0, 0),
    (30, 0.2, 40, 0.1, 28, 0.3, 0, 0, 1), (50, 0.3, 30, 0.0, 45, 0.0, 0, 0, 1), (26, 0.1, 20, 1.0, 35, 0.0, 0, 0, 1), (80, 0.15, 60, 0.2, 2, 1.0, 0, 0, 1),
    (40, 1.0, 40, 1.0, 0, 0.0, 0, 0, 0), (25, 0.9, 50, 0.0, 0, 0.0, 0, 0, 0), (21, 1.0, 8, 0.0, 0, 0.0, 0, 0, 0), (70, 0.85, 20, 0.9, 4, 0.0, 0, 0, 0),
    (2, 0.0, 30, 0.0, 1, 1.0, 0, 1, 0), (1, 0.0, 40, 0.0, 12, 1.0, 0, 1, 0), (3, 0.0, 3, 1.0, 4, 1.0, 0, 1, 0), (4, 0.0, 60, 0.0, 30, 0.9, 0, 1, 0),
    (3, 0.0, 2, 1.0, 40, 0.0, 0, 1, 1), (4, 0.0, 1, 1.0, 60, 0.0, 0, 1, 1), (6, 0.0, 1, 1.0, 30, 0.1, 0, 1, 1), (2, 0.0, 30, 1.0, 25, 0.0, 0, 1, 1),
    (40, 0.0, 3, 1.0, 50, 0.0, 0, 0, 1), (35, 0.05, 45, 0.0, 3, 1.0, 0, 0, 1), (90, 0.0, 30, 1.0, 25, 1.0, 0, 0, 1), (28, 0.25, 20, 0.2, 20, 0.9, 0, 0, 1),
)

#: Labelled blocks of the 50 pages of the 0.01 table whose id is divisible by 5, their regions withheld: 40 of the
#: distinct ones inside articles, 40 of the others, drawn with seed 0.
WITHHELD = (
    # inside articles
    (1, 0.0, 1, 0.0, 57, 0.0, 0, 0, 1), (2, 0.0, 2, 0.0, 32, 0.0, 0, 0, 1), (3, 0.0, 104, 0.0, 3, 0.0, 0, 0, 1), (5, 0.0, 46, 0.0, 71, 0.0, 0, 0, 1),
    (6, 0.0, 9, 0.0, 20, 0.0, 0, 0, 1), (7, 0.0, 11, 0.0, 7, 0.0, 0, 1, 1), (7, 0.0, 29, 0.0, 39, 0.0, 0, 0, 1), (8, 0.0, 7, 0.0, 8, 0.0, 0, 1, 1),
    (8, 0.0, 8, 0.0, 17, 0.0, 0, 0, 1), (10, 0.0, 10, 0.0, 19, 0.0, 0, 1, 1), (10, 0.0, 10, 0.0, 35, 0.0, 0, 0, 1), (10, 0.0, 107, 0.0, 10, 0.0, 0, 0, 1),
    (14, 0.0, 78, 0.0, 15, 0.0, 0, 0, 1), (16, 0.0, 40, 0.0, 22, 0.0, 0, 0, 1), (20, 0.0, 6, 0.0, 2, 0.0, 0, 0, 1), (20, 0.0, 27, 0.0, 13, 0.0, 0, 0, 1),
    (22, 0.0, 10, 0.0, 20, 0.0, 0, 0, 1), (22, 0.0, 14, 0.0, 20, 0.0, 0, 0, 1), (26, 0.0, 25, 0.0, 8, 0.0, 0, 0, 1), (30, 0.0, 36, 0.0, 107, 0.0, 0, 0, 1),
    (32, 0.0, 81, 0.0, 7, 0.0, 0, 0, 1), (33, 0.0, 17, 0.0, 29, 0.0, 0, 0, 1), (36, 0.0, 17, 0.0, 63, 0.0, 0, 0, 1), (36, 0.0, 79, 0.0, 30, 0.0, 0, 0, 1),
    (42, 0.0, 3, 0.0, 42, 0.0, 0, 0, 1), (42, 0.0, 38, 0.0, 115, 0.0, 0, 0, 1), (49, 0.0, 62, 0.0, 56, 0.0, 0, 0, 1), (52, 0.0, 11, 0.0, 8, 0.0, 0, 0, 1),
    (55, 0.0, 2, 0.0, 35, 0.0, 0, 0, 1), (58, 0.0, 2, 0.0, 102, 0.0, 0, 0, 1), (62, 0.0, 62, 0.0, 12, 0.0, 0, 0, 1), (65, 0.0, 6, 0.0, 24, 0.0, 0, 0, 1),
    (83, 0.0, 1, 0.0, 15, 0.0, 0, 0, 1), (84, 0.0, 3, 0.0, 45, 0.0, 0, 0, 1), (90, 0.0, 16, 0.0, 211, 0.0, 0, 0, 1), (94, 0.0, 33, 0.0, 64, 0.0, 0, 0, 1),
    (102, 0.0, 25, 0.0, 80, 0.0, 0, 0, 1), (111, 0.0, 93, 0.0, 11, 0.0, 0, 0, 1), (136, 0.0, 10, 0.0, 8, 0.0, 0, 0, 1), (160, 0.0, 58, 0.0, 32, 0.0, 0, 0, 1),
    # of furniture
    (1, 1.0, 1, 1.0, 4, 0.0, 0, 0, 0), (1, 1.0, 1, 1.0, 7, 0.0, 0, 0, 0), (4, 0.0, 1, 1.0, 7, 0.0, 0, 0, 0), (4, 0.0, 1, 1.0, 11, 0.0, 0, 0, 0),
    (4, 0.0, 1, 1.0, 12, 0.0, 0, 0, 0), (6, 0.0, 1, 1.0, 4, 0.0, 0, 0, 0), (6, 0.0, 1, 1.0, 6, 0.0, 0, 0, 0), (6, 0.0, 1, 1.0, 10, 0.0, 0, 0, 0),
    (6, 0.0, 1, 1.0, 11, 0.0, 0, 0, 0), (7, 0.0, 1, 1.0, 7, 0.0, 0, 0, 0), (7, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0), (8, 0.0, 1, 1.0, 3, 0.0, 0, 0, 0),
    (8, 0.0, 1, 1.0, 7, 0.0, 0, 0, 0), (8, 0.0, 1, 1.0, 10, 0.0, 0, 0, 0), (8, 0.0, 33, 0.0, 0, 0.0, 0, 0, 0), (8, 0.0, 64, 0.0, 0, 0.0, 0, 0, 0),
    (8, 0.0, 114, 0.0, 0, 0.0, 0, 0, 0), (8, 0.0, 136, 0.0, 0, 0.0, 0, 0, 0), (8, 0.0, 211, 0.0, 0, 0.0, 0, 0, 0), (10, 0.0, 1, 1.0, 2, 0.0, 0, 0, 0),
    (10, 0.0, 1, 1.0, 7, 0.0, 0, 0, 0), (10, 0.0, 9, 0.0, 0, 0.0, 0, 0, 0), (10, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0), (11, 0.0, 1, 1.0, 7, 0.0, 0, 0, 0),
    (11, 0.0, 1, 1.0, 8, 0.0, 0, 0, 0), (11, 0.0, 1, 1.0, 10, 0.0, 0, 0, 0), (11, 0.0, 7, 0.0, 0, 0.0, 0, 0, 0), (11, 0.0, 43, 0.0, 0, 0.0, 0, 0, 0),
    (12, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0), (12, 0.0, 13, 0.0, 0, 0.0, 0, 0, 0), (12, 0.0, 15, 0.0, 0, 0.0, 0, 0, 0), (12, 0.0, 28, 0.0, 0, 0.0, 0, 0, 0),
    (12, 0.0, 37, 0.0, 0, 0.0, 0, 0, 0), (12, 0.0, 71, 0.0, 0, 0.0, 0, 0, 0), (13, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0), (13, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0),
    (13, 0.0, 8, 0.0, 0, 0.0, 0, 0, 0), (15, 0.0, 7, 0.0, 0, 0.0, 0, 0, 0), (15, 0.0, 9, 0.0, 0, 0.0, 0, 0, 0), (15, 0.0, 20, 0.0, 0, 0.0, 0, 0, 0),
)

#: Made-up blocks count as often as this, so that a region, where a page shows one, decides.
MARKED_WEIGHT = 6
LABELLED = MARKED * MARKED_WEIGHT + LINKED + WITHHELD


def train(rows=LABELLED, depth: int = 6):
    """A decision tree by Gini impurity: nested (feature, threshold, at most, above) or a label."""
    data = np.array(rows, float)

    def grow(part: np.ndarray, left: int):
        y = part[:, -1]
        if left == 0 or y.min() == y.max():
            return bool(y.mean() >= 0.5)
        best = None
        for f in range(part.shape[1] - 1):
            values = np.unique(part[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                low = y[part[:, f] <= cut]
                high = y[part[:, f] > cut]
                gini = len(low) * low.mean() * (1 - low.mean()) + len(high) * high.mean() * (1 - high.mean())
                if best is None or gini < best[0] - 1e-12:
                    best = gini, f, float(cut)
        if best is None:
            return bool(y.mean() >= 0.5)
        _, f, cut = best
        return f, cut, grow(part[part[:, f] <= cut], left - 1), grow(part[part[:, f] > cut], left - 1)

    return grow(data, depth)


def judge(tree, features) -> bool:
    while not isinstance(tree, bool):
        f, cut, low, high = tree
        tree = low if features[f] <= cut else high
    return tree


# --- blocks -----------------------------------------------------------------------------------------

#: Elements whose content is never text of the page.
RAW = "script|style|title|textarea|template|noscript|svg|math|iframe|object|select|button|audio|video|canvas"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers whose end is often left out; a new one doesn't nest.
LOOSE = frozenset("p li dt dd tr td th option thead tbody tfoot".split()) | HEADINGS
#: Furniture whatever it stands in; furniture unless an article inside it holds the block; words that
#: name such parts in a class or id.
STRONG_TAGS, WEAK_TAGS = frozenset("nav aside footer dialog menu head".split()), frozenset("header form fieldset".split())
STRONG_ROLES = frozenset("navigation complementary contentinfo search dialog alertdialog alert menu menubar".split())
STRONG_WORDS = frozenset("comment comments commentlist disqus reply replies respond ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted cookie cookies consent gdpr sidebar breadcrumb breadcrumbs navbar nav navigation menu footer newsletter subscribe subscription share sharing social related recommended recommendations popup modal overlay notice notices pagination pager toolbar login signin signup search widget banner teaser teasers trending popular tags legal copyright disclaimer".split())
WEAK_WORDS = frozenset("header masthead topbar alert announcement form".split())
#: Those of the former that wrappers of whole pages are also named by: furniture unless an article stands inside.
WRAPPER_WORDS = frozenset("widget overlay modal popup toolbar banner search share sharing tags login signin signup".split())
#: Text-level elements are furniture by name only where all words of a name say so.
TEXT_TAGS = frozenset("p blockquote figure pre table".split()) | HEADINGS
ARTICLE_WORDS = frozenset("article content post entry story main body".split())
_NEGATION = frozenset("with has no without is not".split())


def _names(value: str) -> Iterator[set[str]]:
    """The words of each name of a class or id."""
    for token in value.split():
        words = [w for w in re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", token) if w]
        if words and words[0].lower() not in _NEGATION:
            yield {w.lower() for w in words}


class _Signals:
    """What an element's tag and attributes say: strongly, weakly or as a wrapper furniture, or an article, by itself or by name."""

    __slots__ = ("strong", "weak", "enclosing", "article", "named")

    def __init__(self, tag: str = "", attributes: str = ""):
        self.strong, self.weak, self.article = tag in STRONG_TAGS, tag in WEAK_TAGS, tag in ("article", "main")
        self.enclosing = tag in ("form", "fieldset")
        furniture, named = set(), False
        if attributes and tag not in ("body", "html"):
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id"):
                    for words in _names(value):
                        found = words & STRONG_WORDS
                        if found and (tag not in TEXT_TAGS or found == words):
                            furniture |= found
                        self.weak |= bool(words & WEAK_WORDS)
                        # a name of both kinds is of a part of an article: post-comments
                        named |= bool(words & ARTICLE_WORDS) and not found
                elif key == "role":
                    self.strong |= value.lower() in STRONG_ROLES
                    self.weak |= value.lower() == "banner"
                    self.article |= value.lower() in ("main", "article")
                elif key == "style":
                    self.strong |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                elif key == "aria-hidden":
                    self.strong |= value.lower() == "true"
                else:
                    self.strong |= tag not in INLINE
        # names that disagree don't decide: an article stays one, another element is left to the tree
        if furniture and not named:
            wrapper = furniture <= WRAPPER_WORDS
            self.strong |= not wrapper
            self.weak |= wrapper and not self.article
            self.enclosing |= wrapper and not self.article
        self.enclosing &= self.weak
        self.named = named and not furniture and not self.strong


class _Above:
    """What the open elements say together, from the outermost to one of them.

    Strong signs count anywhere above. Of weak ones, forms and wrappers count unless an article stands inside them,
    page heads unless an article stands inside or around them: the head of an article is part of it.
    """

    __slots__ = ("strong", "enclosed", "article", "head", "named", "loose")

    def __init__(self, above: _Above | None = None, own: _Signals | None = None, loose: int = 0):
        self.strong = self.enclosed = self.article = self.head = self.named = False
        self.loose = loose
        if above and own:
            self.strong = above.strong or own.strong
            self.enclosed = above.enclosed and not own.article or own.enclosing
            self.article = above.article or own.article
            self.head = above.head or own.weak
            self.named = above.named or own.named

    @property
    def region(self) -> int:
        if self.strong or self.enclosed:
            return -1
        if self.article:
            return 1
        return -1 if self.head else int(self.named)


#: A bit for each of the containers whose end is often left out.
_BIT = {tag: 1 << i for i, tag in enumerate(sorted(LOOSE))}


class _Open:
    """The open elements. Every step takes time by what it opens and closes, however many are open."""

    def __init__(self):
        self.tags: list[str] = []
        self.above = [_Above()]
        self.count: dict[str, int] = {}

    def push(self, tag: str, own: _Signals) -> None:
        # containers of that kind that are open since the last other element
        loose = self.above[-1].loose | _BIT[tag] if tag in LOOSE else 0
        self.tags.append(tag)
        self.above.append(_Above(self.above[-1], own, loose))
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.tags.pop()
        self.above.pop()
        self.count[tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """Closes the innermost element of that tag and all inside it; a loose one only if none but loose ones are inside it."""
        if self.above[-1].loose & _BIT[tag] if tag in LOOSE else self.count.get(tag):
            while self.pop() != tag:
                pass

    @property
    def top(self) -> str:
        return self.tags[-1] if self.tags else ""

    @property
    def region(self) -> int:
        return self.above[-1].region

    @property
    def heading(self) -> bool:
        return any(t in HEADINGS for t in self.tags[-2:])


def _tokens(page: str) -> Iterator[tuple[re.Match, int]]:
    """Tags, comments and raw elements, and where each ends. None starts after the last ``>`` but an unclosed comment; looking
    for others there would go to the end of the page from each ``<``."""
    stop = page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, stop):
        unclosed = m.end() == stop and (m[1] and not m[0][:-1].rstrip().lower().endswith("</" + m[1].lower()) or m[0].startswith("<!--") and not m[0].endswith("-->", 4))
        yield m, len(page) if unclosed else m.end()


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """Text blocks in page order, decoded and with single blanks, and their features."""
    found: list[list] = []
    opened = _Open()
    words: list[str] = []
    linked = 0
    in_link, heading, region = 0, False, 0
    parts: list[str] = []

    def pour() -> None:
        """Adds text so far to the block."""
        nonlocal linked
        if parts:
            text = html.unescape("".join(parts))
            parts.clear()
            words.append(text)
            if in_link:
                linked += len(text.split())

    def close() -> None:
        nonlocal linked
        pour()
        text = " ".join("".join(words).split())
        if text:
            n = text.count(" ") + 1
            found.append([text, n, min(1.0, linked / n), region, heading])
        words.clear()
        linked = 0

    end = 0
    for m, stop in _tokens(page):
        if m.start() > end:
            parts.append(page[end : m.start()])
        end = stop
        tag = m[3] or m[6]
        if not tag:
            if m[1] and m[1].lower() not in ("svg", "math"):
                parts.append(" ")
            continue
        tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "a":
            pour()
            in_link = 0 if closing else 1
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            if attributes and not closing and tag not in VOID and _Signals(tag, attributes).strong and re.search(r"hidden|none", attributes):
                hidden = _Signals()
                hidden.strong = True
                opened.push(tag, hidden)
                close()
                region = opened.region
            elif closing and opened.top == tag:
                close()
                opened.pop()
                region = opened.region
            continue
        close()
        in_link = 0
        if tag in VOID:
            continue
        if closing:
            opened.close(tag)
        else:
            top = opened.top
            if tag in LOOSE and top in LOOSE and (top == tag or tag in ("p", *HEADINGS) and top in ("p", *HEADINGS) or {tag, top} <= {"dt", "dd"} or {tag, top} <= {"td", "th"}):
                opened.pop()
            if not attributes.rstrip().endswith("/"):
                opened.push(tag, _Signals(tag, attributes))
        heading = opened.heading
        region = opened.region
    rest, comment, _ = page[end:].partition("<!--")
    if rest and (comment or not re.match(r"<[!/a-zA-Z]", rest)):
        parts.append(rest)
    close()
    out = []
    for k, (text, n, links, where, is_heading) in enumerate(found):
        before = found[k - 1] if k else (0, 0, 0.0)
        after = found[k + 1] if k + 1 < len(found) else (0, 0, 0.0)
        out.append((text, [n, links, before[1], before[2], after[1], after[2], where, float(is_heading)]))
    return out


def main_text(page: str | None, tree) -> str:
    return "\n".join(text for text, features in blocks(page or "") if judge(tree, features))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), labelled=LABELLED) -> DataFrame:
    """The kept columns, text and n_chars of every page.

    Null and empty pages, and pages without main text, give an empty text. Pages may be of any length and
    any brokenness; repeated rows give repeated rows. Nothing is shuffled.
    """
    bounded_batches(pages.sparkSession)
    tree = train(labelled)
    kinds = [f"`k{i}` {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py(), tree) for t in batch.column(len(keep)).cast(pa.large_string())]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), sizes], names=[*(f"k{i}" for i in range(len(keep))), "text", "n_chars"])

    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"])).toDF(*keep, "text", "n_chars")
