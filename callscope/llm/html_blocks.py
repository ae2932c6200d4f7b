"""Main text of web pages from flat text blocks.

A page is cut into blocks of text at block-level tags.  Each block has its word count
and link density, those of the blocks before and after it, and what kind of section
it lies in.  A decision tree trained on the small labelled table below says which
blocks are main text.

Tags, roles and hidden parts decide a section.  A class name or id alone only makes it
doubtful: ``main`` and ``article`` inside it are main text all the same (an ``article``
not among comments and the like), and on a page without such a section the words and
links of the blocks and their neighbours decide.  Comments, adverts and the like go there
too if there is text outside them.  A name on a paragraph, heading or list item counts for
that block alone.

Defined results: a null or empty page, or one without main text, gives an empty
string; broken markup is read as far as it goes; repeated rows give equal texts; an
input column that has the name of an output column is replaced; an empty table gives
an empty table.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from callscope.llm.common import column, small_batches

# Fixed values of HTML, and words that sites use as class names or ids.
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset "
                       "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre "
                       "section summary table tbody td tfoot th thead tr ul".split())
#: Tags whose nesting is followed, as they make or hold a section.
SECTION_TAGS = frozenset("article aside blockquote body dialog div dl figure footer form header li main menu nav ol section table ul span".split())
#: Tags of a single block whose own name counts.
NAMED_TAGS = frozenset("p li h1 h2 h3 h4 h5 h6 figcaption caption dt dd pre".split())
#: Tags whose content is no text of the page.
DROPPED_TAGS = frozenset("script style noscript template textarea select button svg iframe object title math canvas audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog".split())
BOILERPLATE_WORDS = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
                              "cookie cookies copyright disclaimer disqus feedback footer gdpr header login masthead menu modal nav "
                              "navbar navigation newsletter notice notices notification overlay pager pagination paywall popup privacy "
                              "promo promotion recommended related replies reply respond share sharing sidebar signup skip social "
                              "sponsor sponsored subscribe tags teaser toolbar topbar widget widgets".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MAIN_WORDS = frozenset("article content post entry story main body text".split())
#: Words of sections that hold articles other than the page's.
OTHER_WORDS = frozenset("ad ads adv advert advertisement advertising comment comments disqus feedback promo promotion recommended "
                        "related replies reply respond sponsor sponsored teaser widget widgets".split())
#: Words that say nothing about a single paragraph, heading or list item.
LAYOUT_ONLY = frozenset("banner header masthead menu nav navigation sidebar topbar".split())
#: What follows one of these in a name says how the page is laid out ("with-sidebar").
LAYOUT_WORDS = frozenset("no not with without has have show hide".split())

TAG = re.compile(r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+|[^<>]*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I | re.S)
WORD = re.compile(r"[a-z]+|[0-9]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "section")
#: DOUBTFUL and OTHER: by a class name or id alone.
MAIN, PLAIN, DOUBTFUL, OTHER, BOILERPLATE = 1, 0, -0.5, -0.75, -1
#: A block of so many words, fewer than half of them in links, is text.
TEXT_WORDS = 15


def _name_words(value: str) -> set[str]:
    out = set()
    for name in value.split():
        words = WORD.findall(name)
        out.update(words[:next((i for i, w in enumerate(words) if w in LAYOUT_WORDS), len(words))])
    return out


def _section(tag: str, attributes: str, outer: float) -> float:
    """What kind of section a tag opens inside an outer one."""
    if outer == BOILERPLATE or tag in BOILERPLATE_TAGS:
        return BOILERPLATE
    if tag == "header" and outer != MAIN:
        return BOILERPLATE
    names, role = {}, ""
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return BOILERPLATE
        if name == "role":
            if value in BOILERPLATE_ROLES:
                return BOILERPLATE
            role = value
        elif name in ("class", "id") and tag != "body":
            names[name] = _name_words(value)
    words = set().union(*names.values())
    if tag == "main" or role == "main":
        return MAIN
    if tag == "article" or role == "article":
        # one among comments, or named like one in a doubtful section, is not the page's
        return outer if outer == OTHER or outer == DOUBTFUL and words & BOILERPLATE_WORDS else MAIN
    if words & BOILERPLATE_WORDS and not (names.get("id") and names["id"] <= MAIN_WORDS):
        if outer == MAIN:
            return BOILERPLATE
        return OTHER if words & OTHER_WORDS else min(outer, DOUBTFUL)
    return MAIN if words & MAIN_WORDS and outer == PLAIN else outer


def _own_section(tag: str, attributes: str, outer: float) -> float:
    """The section of a paragraph, heading or list item by its own attributes, which can
    only make it less likely to be main text."""
    names = set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return BOILERPLATE
        if name == "role" and value in BOILERPLATE_ROLES:
            return BOILERPLATE
        if name in ("class", "id"):
            names |= _name_words(value)
    names &= BOILERPLATE_WORDS - LAYOUT_ONLY
    if not names:
        return outer
    return BOILERPLATE if outer == MAIN else min(outer, OTHER if names & OTHER_WORDS else DOUBTFUL)


def blocks(page: str | None) -> list[tuple[str, int, int, float]]:
    """(text, words, words in links, section) of every block that has text.  What is
    doubtful by its names is boilerplate on a page that has main text elsewhere."""
    page = page or ""
    out, pieces, linked = [], [], 0
    sections: list[tuple[str, float]] = []
    in_link, at, own = False, 0, None

    def flush():
        nonlocal pieces, linked
        if pieces:
            words = "".join(pieces).split()
            if words:
                outer = sections[-1][1] if sections else PLAIN
                out.append((" ".join(words), len(words), min(linked, len(words)), outer if own is None else min(own, outer)))
        pieces, linked = [], 0

    def text(raw):
        nonlocal linked
        if raw:
            raw = html.unescape(raw)
            pieces.append(raw)
            if in_link:
                linked += len(raw.split())

    while True:
        found = TAG.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at:found.start()])
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in DROPPED_TAGS:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                if not end:
                    break
                at = page.find(">", end.start())
                at = len(page) if at < 0 else at + 1
            continue
        if tag in BLOCK_TAGS:
            flush()
            own = None
            in_link = in_link and tag != "body"
            if tag == "li" and not closing:  # ends the item before it, if that is open
                inner = next((i for i in range(len(sections) - 1, -1, -1) if sections[i][0] in ("li", "ul", "ol", "menu")), -1)
                if inner >= 0 and sections[inner][0] == "li":
                    del sections[inner:]
            if tag in NAMED_TAGS and not closing and attributes:
                own = _own_section(tag, attributes, sections[-1][1] if sections else PLAIN)
                if tag == "li":
                    sections.append((tag, own))
                    own = None
                continue
        if tag == "a":
            in_link = not closing
        if tag in SECTION_TAGS:
            if closing:
                if any(t == tag for t, _ in sections):
                    if tag == "span":
                        while sections[-1][0] != tag and sections[-1][0] == "span":
                            sections.pop()
                        if sections[-1][0] == tag:
                            if sections[-1][1] < PLAIN:
                                flush()
                            sections.pop()
                    else:
                        while sections.pop()[0] != tag:
                            pass
            elif not attributes.endswith("/"):
                kind = _section(tag, attributes, sections[-1][1] if sections else PLAIN)
                if tag == "span" and kind < PLAIN and (not sections or sections[-1][1] != kind):
                    flush()
                sections.append((tag, kind))
    flush()
    marked = any(b[3] == MAIN for b in out)
    # text that is not among comments, adverts and the like
    apart = any(b[3] >= DOUBTFUL and b[1] >= TEXT_WORDS and 2 * b[2] < b[1] for b in out)
    return [(*b[:3], b[3] if b[3] >= PLAIN else BOILERPLATE if marked or b[3] == BOILERPLATE or b[3] == OTHER and apart else DOUBTFUL) for b in out]


def block_features(found: list[tuple[str, int, int, float]]) -> np.ndarray:
    words = np.array([0, *(b[1] for b in found), 0], float)
    links = np.array([0, *(b[2] / b[1] for b in found), 0], float)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:],
                            np.array([b[3] for b in found], float)]) if found else np.empty((0, len(FEATURES)))


#: The labelled table: pages as lists of blocks (words, link density, section, main).
LABELLED = (
    # an article with menu, advert and footer
    [(1, 1, -1, 0), (1, 1, -1, 0), (2, 1, -1, 0), (6, 0, -1, 0), (9, 0, 1, 1), (45, 0, 1, 1), (2, 0, 1, 1), (120, 0.02, 1, 1), (1, 0, 1, 1),
     (60, 0, 1, 1), (12, 0.1, -1, 0), (8, 0, -1, 0)],
    # a short article
    [(1, 1, -1, 0), (3, 1, -1, 0), (14, 0, -1, 0), (4, 0, 1, 1), (3, 0, 1, 1), (7, 0, -1, 0)],
    # one with a list, a quotation and linked words
    [(2, 1, -1, 0), (8, 0, 1, 1), (30, 0.1, 1, 1), (4, 0, 1, 1), (5, 0.2, 1, 1), (6, 0.9, 1, 1), (3, 1, 1, 1), (40, 0, 1, 1), (25, 0, -1, 0),
     (70, 0, -1, 0), (33, 0.1, -1, 0), (5, 0.5, -1, 0)],
    # no section is marked: long blocks are the text
    [(1, 1, 0, 0), (2, 1, 0, 0), (1, 1, 0, 0), (7, 0, 0, 1), (50, 0, 0, 1), (80, 0.05, 0, 1), (12, 0, 0, 1), (64, 0, 0, 1), (3, 0.7, 0, 0),
     (4, 1, 0, 0), (2, 1, 0, 0)],
    [(3, 1, 0, 0), (2, 1, 0, 0), (10, 0.9, 0, 0), (28, 0.6, 0, 0), (22, 0, 0, 1), (35, 0, 0, 1), (18, 0.1, 0, 1), (5, 1, 0, 0), (6, 0.8, 0, 0)],
    [(4, 0, 0, 1), (15, 0, 0, 1), (16, 0, 0, 1), (2, 0, 0, 1), (90, 0, 0, 1)],
    [(1, 0, 0, 1), (1, 1, 0, 0), (1, 1, 0, 0), (1, 1, 0, 0)],
    [(200, 0, 0, 1), (1, 1, -1, 0), (100, 0, -1, 0), (150, 0.2, -1, 0), (300, 0, 1, 1), (1, 1, 1, 1)],
    [(5, 0.6, 0, 0), (40, 0.5, 0, 0), (30, 0.45, 0, 0), (11, 0.2, 0, 1), (20, 0.3, 0, 1), (60, 0.25, 0, 1)],
    # wrapped in a section of a doubtful name: the text, between menu and copyright
    [(1, 1, -0.5, 0), (2, 1, -0.5, 0), (1, 1, -0.5, 0), (7, 0, -0.5, 1), (50, 0, -0.5, 1), (80, 0.05, -0.5, 1), (25, 0, -0.5, 1),
     (64, 0, -0.5, 1), (5, 0, -0.5, 0), (3, 1, -0.5, 0)],
    [(3, 0, -0.5, 0), (2, 1, -0.5, 0), (30, 0.1, -0.5, 1), (28, 0, -0.5, 1), (90, 0, -0.5, 1), (6, 0, -0.5, 0), (2, 1, -0.5, 0)],
    # doubtful names for the notices, adverts and widgets of a page without marks
    [(11, 0, -0.5, 0), (2, 1, -0.5, 0), (9, 0, 0, 1), (60, 0, 0, 1), (10, 0, -0.5, 0), (45, 0, 0, 1), (4, 1, -0.5, 0), (4, 0, -0.5, 0), (2, 1, -0.5, 0)],
    [(40, 0, 0, 1), (14, 0, -0.5, 0), (35, 0, 0, 1), (50, 0, 0, 1), (8, 0, -0.5, 0), (6, 0, -0.5, 0)],
    # captions between links, and a copyright line after them
    [(1, 1, 0, 0), (1, 0, 0, 0), (1, 1, 0, 0), (2, 0, 0, 0), (2, 1, 0, 0), (30, 0, 0, 1), (44, 0, 0, 1), (2, 1, 0, 0), (2, 1, 0, 0), (6, 0, 0, 0)],
    [(2, 1, 0, 0), (2, 0, 0, 0), (3, 1, 0, 0), (55, 0, 0, 1), (38, 0, 0, 1), (3, 1, 0, 0), (9, 0, 0, 0)],
    # articles: a linked paragraph or heading belongs to the text around it, and text follows links
    [(8, 0, 1, 1), (50, 0, 1, 1), (12, 1, 1, 1), (200, 0, 1, 1), (3, 0, 1, 1)],
    [(4, 1, 1, 1), (80, 0, 1, 1), (3, 1, 1, 1), (60, 0, 1, 1), (2, 1, 1, 1), (30, 0, 1, 1)],
    [(5, 0, 1, 1), (100, 0, 1, 1), (6, 1, 1, 1), (9, 0, 1, 1), (1, 0, 1, 1)],
    [(7, 0, 1, 1), (25, 0, 1, 1), (24, 1, 1, 1), (18, 0, 1, 1), (40, 0.9, 1, 1), (16, 0, 1, 1)],
    [(6, 0, 1, 1), (15, 0.3, 1, 1), (9, 0.9, 1, 1), (65, 0.1, 1, 1), (10, 0.5, 1, 1), (33, 0, 1, 1)],
    # articles with lists of links, before the text and between its parts
    [(2, 1, 1, 0), (2, 1, 1, 0), (3, 1, 1, 0), (40, 0, 1, 1), (70, 0, 1, 1)],
    [(9, 0, 1, 1), (15, 0, 1, 1), (5, 1, 1, 0), (6, 1, 1, 0), (4, 1, 1, 0), (35, 0, 1, 1), (2, 0, 1, 1)],
    [(3, 0, 1, 1), (60, 0, 1, 1), (2, 1, 1, 0), (3, 1, 1, 0), (150, 0, 1, 1)],
    [(6, 0, 1, 1), (4, 1, 1, 0), (3, 1, 1, 0), (16, 0, 1, 1), (4, 1, 1, 0), (5, 1, 1, 0), (20, 0, 1, 1), (1, 0, 1, 1)],
    [(3, 1, 1, 0), (3, 1, 1, 0), (4, 0, 1, 1), (3, 1, 1, 0), (2, 1, 1, 0), (17, 0, 1, 1)],
    # pages without marks where long text follows links or stands before short blocks
    [(2, 1, 0, 0), (8, 0, 0, 1), (50, 0, 0, 1), (3, 1, 0, 0), (100, 0, 0, 1), (2, 0, 0, 0)],
    [(1, 1, 0, 0), (2, 1, 0, 0), (200, 0, 0, 1), (4, 0, 0, 0)],
    [(3, 1, 0, 0), (2, 1, 0, 0), (25, 0, 0, 1), (16, 0, 0, 1), (2, 1, 0, 0), (30, 0, 0, 1), (5, 0, 0, 0)],
    [(2, 1, -0.5, 0), (40, 0, -0.5, 1), (90, 0, -0.5, 1), (3, 1, -0.5, 0), (55, 0, -0.5, 1), (4, 0, -0.5, 0)],
    [(1, 1, -0.5, 0), (1, 1, -0.5, 0), (120, 0, -0.5, 1), (33, 0.1, -0.5, 1), (2, 1, -0.5, 0)],
    # boilerplate of any length, before, after and between the parts of the text
    [(40, 0, -1, 0), (3, 1, -1, 0), (5, 0, 1, 1), (90, 0, 1, 1), (35, 0, -1, 0), (250, 0, 1, 1), (60, 0, -1, 0), (18, 0.3, -1, 0), (130, 0, -1, 0)],
    [(20, 0, -1, 0), (6, 0, 0, 1), (70, 0, 0, 1), (28, 0, -1, 0), (16, 0, 0, 1), (110, 0, 0, 1), (45, 0, -1, 0), (4, 0, -1, 0)],
    [(9, 0, -1, 0), (22, 0, -1, 0), (300, 0, 0, 1), (180, 0, -1, 0), (55, 0.1, -1, 0)],
    [(2, 0, -1, 0), (50, 0, -1, 0), (26, 0, -0.5, 1), (140, 0, -0.5, 1), (65, 0, -0.5, 1), (30, 0, -1, 0), (100, 0, -1, 0)],
    # a list of links to other pages at the end of an article
    [(8, 0, 1, 1), (70, 0, 1, 1), (40, 0, 1, 1), (5, 1, 1, 0), (6, 1, 1, 0), (5, 1, 1, 0), (7, 1, 1, 0)],
)


def labelled(pages=LABELLED) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for page in pages:
        x.append(block_features([("", w, w * share, s) for w, share, s, _ in page]))
        y += [b[3] for b in page]
    return np.concatenate(x), np.array(y)


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> list[tuple]:
    """A CART tree by Gini impurity: nodes (feature, threshold, left, right, label)."""
    nodes: list[tuple] = []

    def grow(rows, level):
        at = len(nodes)
        own = y[rows]
        nodes.append((-1, 0.0, -1, -1, int(own.mean() >= 0.5)))
        if level == depth or own.min() == own.max():
            return at
        best = (2 * own.mean() * (1 - own.mean()) * len(own) - 1e-9, None, None)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            left, right = ones[:-1], ones[-1] - ones[:-1]
            cost = 2 * left * (n - left) / n + 2 * right * (len(order) - n - right) / (len(order) - n)
            cost[(v[1:] == v[:-1]) | (n < least) | (len(order) - n < least)] = np.inf
            k = int(np.argmin(cost))
            if cost[k] < best[0]:
                best = (cost[k], f, (v[k] + v[k + 1]) / 2)
        if best[1] is None:
            return at
        below = x[rows, best[1]] <= best[2]
        left = grow(rows[below], level + 1)
        right = grow(rows[~below], level + 1)
        nodes[at] = (best[1], best[2], left, right, nodes[at][4])
        return at

    grow(np.arange(len(y)), 0)
    return nodes


def predict(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, label = map(np.array, zip(*nodes, strict=True))
    at = np.zeros(len(x), int)
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return label[at]
        down = x[np.arange(len(x)), feature[at]] <= threshold[at]
        at = np.where(inner, np.where(down, left[at], right[at]), at)


def extract(pages: DataFrame, page: str = "html", out: str = "text", keep: list[str] | None = None, tree: list[tuple] | None = None) -> DataFrame:
    """Adds ``out``: the main text, its blocks in page order joined by a line break."""
    tree = tree or train_tree(*labelled())
    keep = pages.columns if keep is None else keep
    schema = T.StructType([f for f in pages.schema.fields if f.name in keep and f.name != out] + [T.StructField(out, T.StringType())])

    def run(batches):
        for batch in small_batches(batches, page):
            found = [blocks(p) for p in column(batch, page).to_pylist()]
            main = predict(tree, np.concatenate([block_features(b) for b in found]))
            texts, at = [], 0
            for b in found:
                texts.append("\n".join(t for (t, *_), yes in zip(b, main[at:at + len(b)], strict=True) if yes))
                at += len(b)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in schema.names[:-1]), pa.array(texts, pa.string())], schema.names)

    return pages.mapInArrow(run, schema)
