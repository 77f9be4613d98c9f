"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks. Each block has its number of words, its link density
(share of words inside links), both figures of the blocks before and after it, and what its markup
says: the nearest container that tells content from page furniture, and the kind of the block. A
decision tree, trained on the small labelled table below, keeps or drops every block.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadline.llm.common import map_batches, texts

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "content", "furniture", "prose", "item")

#: Labelled blocks: the features above and whether the block is main text. ``links`` are shares;
#: ``content`` / ``furniture``: the nearest telling container is an article / a menu, footer and so
#: on; ``prose``: paragraph, heading, quotation or preformatted text; ``item``: entry of a list.
LABELLED = (
    # inside an article everything counts, however short
    (9, 0.0, 1, 1.0, 60, 0.0, 1, 0, 1, 0, 1),
    (60, 0.0, 9, 0.0, 80, 0.0, 1, 0, 1, 0, 1),
    (80, 0.05, 60, 0.0, 2, 0.0, 1, 0, 1, 0, 1),
    (2, 0.0, 80, 0.0, 1, 0.0, 1, 0, 1, 0, 1),
    (1, 0.0, 2, 0.0, 40, 0.1, 1, 0, 1, 0, 1),
    (40, 0.1, 1, 0.0, 12, 0.0, 1, 0, 1, 0, 1),
    (12, 0.0, 40, 0.0, 5, 0.2, 1, 0, 1, 0, 1),
    (3, 0.0, 30, 0.0, 0, 0.0, 1, 0, 1, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1, 0, 1),
    (6, 1.0, 50, 0.0, 40, 0.0, 1, 0, 1, 0, 1),
    (2, 0.5, 1, 0.0, 2, 0.0, 1, 0, 1, 0, 1),
    (3, 1.0, 1, 0.0, 2, 0.0, 1, 0, 1, 0, 1),
    (10, 0.6, 3, 0.0, 3, 0.0, 1, 0, 1, 0, 1),
    (4, 1.0, 3, 1.0, 3, 1.0, 1, 0, 1, 0, 1),
    (3, 0.3, 0, 0.0, 2, 1.0, 1, 0, 1, 0, 1),
    (1, 0.0, 2, 1.0, 2, 1.0, 1, 0, 1, 0, 1),
    (5, 0.0, 2, 1.0, 3, 0.9, 1, 0, 1, 0, 1),
    (2, 0.0, 2, 1.0, 2, 1.0, 1, 0, 0, 0, 1),
    (3, 0.0, 0, 0.0, 2, 1.0, 1, 0, 0, 1, 1),
    (2, 0.0, 2, 1.0, 2, 1.0, 1, 0, 0, 1, 1),
    (25, 0.3, 50, 0.0, 40, 0.0, 1, 0, 0, 0, 1),
    (9, 0.6, 50, 0.0, 40, 0.0, 1, 0, 0, 0, 1),
    (9, 0.6, 3, 0.0, 4, 0.0, 1, 0, 0, 0, 1),
    (2, 0.0, 50, 0.0, 40, 0.0, 1, 0, 0, 0, 1),
    (1, 0.0, 0, 0.0, 30, 0.0, 1, 0, 0, 0, 1),
    (8, 0.0, 30, 0.0, 7, 0.0, 1, 0, 0, 1, 1),
    (7, 0.1, 8, 0.0, 1, 0.0, 1, 0, 0, 1, 1),
    (1, 0.0, 7, 0.0, 30, 0.0, 1, 0, 0, 1, 1),
    (20, 0.4, 7, 0.0, 30, 0.0, 1, 0, 0, 1, 1),
    # also its own lists of links: sources, references, chapters
    (5, 1.0, 60, 0.0, 4, 1.0, 1, 0, 0, 1, 1),
    (4, 1.0, 5, 1.0, 6, 1.0, 1, 0, 0, 1, 1),
    (6, 1.0, 4, 1.0, 3, 0.0, 1, 0, 0, 1, 1),
    (9, 0.9, 4, 1.0, 3, 1.0, 1, 0, 0, 1, 1),
    # menus, headers, footers, sidebars, notices, adverts, forms and comments, however long
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 1, 0),
    (1, 1.0, 1, 1.0, 2, 1.0, 0, 1, 0, 1, 0),
    (2, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0, 1, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0, 0),
    (45, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0, 0),
    (45, 0.0, 30, 0.0, 50, 0.0, 0, 1, 1, 0, 0),
    (120, 0.0, 60, 0.0, 60, 0.0, 0, 1, 1, 0, 0),
    (12, 0.0, 80, 0.0, 0, 0.0, 0, 1, 0, 0, 0),
    (3, 0.0, 80, 0.0, 4, 0.0, 0, 1, 1, 0, 0),
    (9, 0.5, 40, 0.0, 0, 0.0, 0, 1, 1, 0, 0),
    (300, 0.0, 2, 0.0, 2, 0.0, 0, 1, 0, 0, 0),
    (15, 0.0, 20, 0.0, 20, 0.0, 0, 1, 0, 1, 0),
    # pages that do not say where their article is: prose stays
    (10, 0.0, 0, 0.0, 50, 0.0, 0, 0, 1, 0, 1),
    (50, 0.0, 10, 0.0, 70, 0.0, 0, 0, 1, 0, 1),
    (70, 0.1, 50, 0.0, 3, 0.0, 0, 0, 1, 0, 1),
    (3, 0.0, 70, 0.0, 20, 0.0, 0, 0, 1, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 0, 1),
    (20, 0.0, 3, 1.0, 3, 1.0, 0, 0, 1, 0, 1),
    (9, 0.9, 3, 1.0, 3, 1.0, 0, 0, 1, 0, 0),
    (2, 1.0, 1, 1.0, 40, 0.0, 0, 0, 1, 0, 0),
    (4, 1.0, 50, 0.0, 6, 1.0, 0, 0, 1, 0, 0),
    # text of no kind stays if it or what is around it is long and free of links
    (60, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (35, 0.0, 3, 1.0, 50, 0.0, 0, 0, 0, 0, 1),
    (50, 0.1, 35, 0.0, 40, 0.0, 0, 0, 0, 0, 1),
    (12, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0, 0, 1),
    (10, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (11, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (2, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 0),
    (3, 1.0, 2, 1.0, 50, 0.0, 0, 0, 0, 0, 0),
    (2, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0),
    (30, 0.8, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0),
    (9, 0.0, 40, 0.0, 8, 0.0, 0, 0, 0, 1, 1),
    (8, 0.1, 9, 0.0, 30, 0.0, 0, 0, 0, 1, 1),
    (3, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 1, 0),
    (2, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0, 1, 0),
    (6, 0.9, 40, 0.0, 3, 1.0, 0, 0, 0, 1, 0),
)

# Elements that end a block of text, and what kind of block they begin.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt td th".split())
ITEM = frozenset(["li"])
BLOCKS = PROSE | ITEM | frozenset(
    "address article aside body caption center details dialog div dl fieldset figure footer form header hgroup hr html legend main "
    "menu nav ol optgroup option section select summary table tbody tfoot thead tr ul button label textarea head".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
OPAQUE = frozenset("script style noscript template iframe object svg canvas audio video title noframes noembed map math".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu button select option label textarea fieldset dialog head".split())
CONTENT_TAGS = frozenset(["article", "main"])
#: Words in class, id or role that tell page furniture, and content.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense menu nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager sidebar sidebars aside widget widgets rail footer foot colophon copyright "
    "masthead topbar logo branding cookie cookies consent gdpr notice notices notification alert disclaimer legal popup modal overlay "
    "comment comments commentlist reply replies respond discussion disqus share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login search form contentinfo complementary dialog toolbar skip hidden".split()
)
CONTENT_WORDS = frozenset("article content main post entry story".split())
#: Whole words of class, id or role of containers in which an article is a teaser, a comment or small print.
TEASER_WORDS = FURNITURE_WORDS - frozenset(
    "menu nav navbar navigation form masthead topbar branding logo search login signup notice notices notification alert legal "
    "disclaimer modal popup overlay dialog skip toolbar breadcrumb breadcrumbs pagination pager".split()
)
#: Parts of a word that say that something is missing, or only what else the page has.
MODIFIERS = frozenset("no has have with without not non is free less".split())
#: Parts of a word that say only where something is hidden (``hidden-print``), not that it is.
PLACES = frozenset(["hidden"])
#: The value of a form in the stack of open elements.
FORM = -3
#: Parts that hold no article if they are closed where they should be.
UNLIKELY_PARENTS = frozenset("nav header form menu fieldset head".split())

_ATTRIBUTE = re.compile(r"""(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_FORM = re.compile("form", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    content: bool
    furniture: bool
    kind: str
    form: bool = False  # furniture only because it stands in a form


@functools.lru_cache(maxsize=4096)
def _hint(attributes: str) -> str:
    """What class, id, role and hiding say: hidden, teasers, furniture, header, content, or nothing.

    A whole word (``sidebar``) says more than a part of one (``post-sidebar``), and a part beside a
    modifier (``has-sidebar``, ``ad-free``) says nothing.
    """
    whole: set[str] = set()
    parts: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "hidden"
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return "hidden"
        if name in ("class", "id", "role"):
            for word in value.split():
                own = {w.lower() for w in _WORDS.findall(word)}
                if word.isalpha() and (word.islower() or word.isupper() or word.istitle()):
                    whole |= own
                elif not own & MODIFIERS:
                    parts |= own - PLACES
    if whole & TEASER_WORDS:
        return "teasers"
    if whole & FURNITURE_WORDS:
        return "furniture"
    if "header" in whole:
        return "header"
    if whole & CONTENT_WORDS:
        return "content"
    if parts & FURNITURE_WORDS:
        return "furniture"
    return "header" if "header" in parts else "content" if parts & CONTENT_WORDS else ""


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order. Broken markup is read as far as it makes sense.

    An element that is never closed ends with its parent, an end tag without a start is ignored, a
    comment or script that is never closed reaches to the end, and so does a tag cut off at the end.
    """
    out: list[Block] = []
    stack = _Open()
    parts: list[tuple[str, bool]] = []
    link, kind, at, size = 0, "", 0, len(page)

    def close() -> None:
        nonlocal parts, kind
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                telling = stack.nearest
                words = len(text.split(" "))
                linked = len(html.unescape(" ".join(t for t, a in parts if a)).split())
                out.append(Block(text, words, min(linked, words), telling > 0, telling < 0, kind, telling == FORM))
            parts = []
        kind = ""

    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            parts.append((page[at:], link > 0))
            break
        if mark > at:
            parts.append((page[at:mark], link > 0))
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), mark):
            end = page.find(">", mark)
            at = size if end < 0 else end + 1
            continue
        found = _TAG.match(page, mark)
        if not found:
            if page[mark + 1 : mark + 2].isalpha() or page.startswith("</", mark):
                end = page.find(">", mark)
                at = size if end < 0 else end + 1
            else:
                parts.append(("<", link > 0))
                at = mark + 1
            continue
        at = found.end()
        ending, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        tag = tag.lower()
        if ending:
            if tag == "a":
                link = max(0, link - 1)
            elif tag in BLOCKS:
                close()
                stack.close(tag)
                if tag in ("article", "main", "body"):
                    link = 0
            continue
        if tag in OPAQUE:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag == "br":
            parts.append((" ", False))
        elif tag == "a":
            link = 1
        elif tag in BLOCKS:
            close()
            if tag in PROSE and tag != "pre" or tag in ITEM:
                # these do not nest in a paragraph or in one another without a list or table between
                while stack.top in (PROSE if tag not in ITEM else PROSE | ITEM) and stack.top not in ("blockquote", "td", "th", "dd"):
                    stack.pop()
            elif stack.top == "p":
                stack.pop()
            if tag == "body":
                stack = _Open()
            if tag not in VOID:
                stack.push(tag, _telling(tag, attributes, stack))
            kind = tag
    close()
    return _without_wrapping_forms(out)


class _Open:
    """The open elements. Every entry holds what its surroundings say, so nothing is searched for.

    Telling: 1 content, -1 furniture, -2 furniture with teasers, ``FORM`` a form, 0 neither.
    """

    def __init__(self):
        self._entries: list[tuple[str, int, int]] = []  # tag, nearest telling value, nearest of content or teasers
        self._count: dict[str, int] = {}

    @property
    def top(self) -> str:
        return self._entries[-1][0] if self._entries else ""

    @property
    def nearest(self) -> int:
        return self._entries[-1][1] if self._entries else 0

    @property
    def strongest(self) -> int:
        """The nearest value that is content or furniture with teasers."""
        return self._entries[-1][2] if self._entries else 0

    def has(self, tag: str) -> bool:
        return self._count.get(tag, 0) > 0

    def push(self, tag: str, telling: int) -> None:
        self._entries.append((tag, telling or self.nearest, telling if telling in (1, -2) else self.strongest))
        self._count[tag] = self._count.get(tag, 0) + 1

    def pop(self) -> str:
        tag = self._entries.pop()[0]
        self._count[tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """End the innermost element of this name with all inside it; without one nothing ends."""
        if self.has(tag):
            while self.pop() != tag:
                pass


def _without_wrapping_forms(found: list[Block]) -> list[Block]:
    """A form that holds most words of the page, running text among them, wraps it and says nothing."""
    inside = [b for b in found if b.form]
    words = sum(b.words for b in inside)
    prose = sum(b.words for b in inside if b.kind in PROSE and b.linked < b.words)
    if 2 * words > sum(b.words for b in found) and 2 * prose > words:
        for b in inside:
            b.furniture = False
    return found


def _telling(tag: str, attributes: str, stack: _Open) -> int:
    """What an element says about its text, see ``_Open``.

    An article is one whatever its class, unless it is hidden, stands in a part that holds teasers,
    comments or small print, or is called furniture inside another article. Other furniture was not
    closed, or wraps the page. A header inside an article belongs to it. Of other elements the words of
    furniture win over those of content (``<div class="article related">`` is a teaser), and content
    counts inside a form, which may wrap the page, but in no other furniture.
    """
    if tag in ("html", "body"):
        return 0
    hint = _hint(attributes) if attributes else ""
    if hint == "hidden":
        return -2
    if tag in CONTENT_TAGS:
        inside = hint in ("teasers", "furniture") and stack.has("article")
        return -2 if stack.strongest < 0 or inside else 1
    if tag == "form":  # that its name says so, too, tells nothing
        own = _hint(_FORM.sub(" ", attributes)) if attributes else ""
        return -1 if own in ("teasers", "furniture") or stack.nearest < 0 else FORM
    if tag in FURNITURE_TAGS:
        return -1 if tag in UNLIKELY_PARENTS else -2
    if hint == "teasers":
        return -2
    if hint == "furniture":
        return -1
    if tag == "header" or hint == "header":
        return 0 if stack.nearest > 0 or tag in PROSE else -1
    return 1 if hint == "content" and stack.nearest in (0, 1, FORM) else 0


def features(found: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` for each block."""
    own = np.array([[b.words, b.linked / b.words] for b in found]).reshape(-1, 2)
    none = np.zeros((1, 2))
    return np.hstack(
        [
            own,
            np.vstack([none, own[:-1]])[: len(own)],
            np.vstack([own[1:], none])[: len(own)],
            np.array([[b.content, b.furniture, b.kind in PROSE, b.kind in ITEM] for b in found], float).reshape(-1, 4),
        ]
    )


Tree = tuple  # (feature, bound, below or at, above) or (share of main text,)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """A classification tree by Gini impurity; ties go to the first feature and the lowest bound."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= bound
            impurity = sum(part.sum() * y[part].mean() * (1 - y[part].mean()) for part in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(bound))
    if best is None:
        return (share,)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def decide(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Share of main text in the leaf of every row."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low] = decide(tree[2], x[low])
    out[~low] = decide(tree[3], x[~low])
    return out


@functools.cache
def trained() -> Tree:
    rows = np.array(LABELLED, float)
    return grow(rows[:, :-1], rows[:, -1])


def main_text(page: str, tree: Tree | None = None) -> str:
    """The kept blocks in page order, one on a line."""
    found = blocks(page)
    if not found:
        return ""
    kept = decide(tree or trained(), features(found)) >= 0.5
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, html_column: str = "html", carry: tuple[str, ...] = ("page_id", "url"), tree: Tree | None = None) -> DataFrame:
    """The carried columns with ``text`` and ``n_chars`` (code points) for every row.

    A null or empty page and one without main text give an empty text; every row, also a repeated one,
    gives a row, an empty table none. Work is linear in the length of a page, however deep it nests.
    """
    tree = tree or trained()

    def start():
        def each(batch):
            found = [main_text(t, tree) for t in texts(batch, html_column)]
            return {c: batch.column(c) for c in carry} | {
                "text": pa.array(found, pa.string()),
                "n_chars": pa.array([len(t) for t in found], pa.int64()),
            }

        return each

    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in carry)
    return map_batches(pages.select(*carry, html_column), start, schema + "text string, n_chars long")
