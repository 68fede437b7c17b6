"""Main text of web pages by tag-path ratios.

The text nodes of a page are grouped by their root-to-leaf tag path. Length and
punctuation per path are smoothed over neighbouring paths, fused into one
ratio, and paths above a threshold hold the content, with the short blocks
(headings, items, sources) that stand among them. Paths through elements
whose meaning is fixed (menus, footers, forms, adverts, ...) never do.

Paths are nodes of one tree per page, each with its parent, and all work on
them is a fixed number of sweeps over that tree: time and memory are linear in
the page, however deep its elements are nested.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
#: Elements whose content is no markup; read up to their end tag.
RAW = frozenset("script style title textarea noscript template xmp iframe noembed noframes svg math canvas object".split())
#: Those of them that may close themselves, and that hold nothing where they have no end tag.
EMBEDDED = frozenset("svg math canvas object".split())
#: Elements and class, id or role words that mark what is not the article.
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button select head audio video".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification "
    "alert sidebar aside menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar footer header masthead comment comments disqus respond reply replies "
    "related recommended share sharing social subscribe newsletter signup login search popup modal overlay widget pagination pager complementary contentinfo "
    "legal copyright skip".split()
)
#: Words for the texts of others; an article element in something named so is one of theirs.
OTHERS_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus respond reply replies related recommended".split()
)
#: Words that are as often the subject of a part of the article: inside of it, and on sections, they bar nothing.
TOPIC_WORDS = frozenset("legal copyright notice notices notification alert".split())
#: What stands before or behind a word that tells of the page ("has-sidebar", "comments-open"), and before the header of an article.
STATES, SWITCHES = frozenset("has with without no not".split()), frozenset("open closed enabled disabled".split())
OF_ARTICLE = frozenset("entry post article story content section".split())
CONTENT_TAGS = frozenset(("article", "main"))
#: How far an element is barred. An article or main lifts LAYOUT; a main lifts NAMED and OTHERS too, and an article under
#: NAMED counts where the page has no other.
FREE, LAYOUT, NAMED, OTHERS, FIXED = range(5)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav "
    "ol p pre section table ul".split()
)
SELF_CLOSING = {
    "li": ("li", ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": ("option", ("select",)),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Smoothing width in steps between paths, the steps behind which a weight is nothing, and the share of the mean ratio that a content path needs.
SIGMA, REACH, SHARE = 1.0, 7, 0.15
#: Share of the chosen text that the content's root holds, and words of a link that is more than a button.
ROOT_SHARE, LINK_WORDS = 0.9, 2
FEW_PATHS = 64
_BELL = np.append(np.exp(-np.arange(REACH + 1) ** 2 / (2 * SIGMA * SIGMA)), 0.0)
CONTENT_BONUS = 8.0

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z!?/][^>]*(?:>|\Z)", re.S
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")


class Paths:
    """The tag paths of a page as a tree: a number each, parents before children."""

    def __init__(self) -> None:
        self.parent, self.tag, self.content, self.article = [0], [""], [False], [False]
        self._child: dict[tuple[int, str], int] = {}

    def child(self, node: int, tag: str) -> int:
        known = self._child.setdefault((node, tag), len(self.tag))
        if known == len(self.tag):
            self.parent.append(node)
            self.tag.append(tag)
            self.content.append(self.content[node] or tag in CONTENT_TAGS)
            self.article.append(self.article[node] or tag == "article")
        return known

    def __len__(self) -> int:
        return len(self.tag)


class Block:
    """Text between two block boundaries, with the path it hangs on."""

    __slots__ = ("path", "pieces", "linked", "barred")

    def __init__(self, path: int, barred: int) -> None:
        self.path, self.barred = path, barred
        self.pieces: list[str] = []
        self.linked = 0


def _name_bar(attributes: str, tag: str, inside: bool) -> int:
    """How far the class, id and role tokens of an element bar it."""
    bar = FREE
    for m in _NAMES.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            parts = _WORDS.findall(token)
            words = {
                w for before, w, after in zip(["", *parts], parts, [*parts[1:], ""])
                if w in BOILERPLATE_WORDS and before not in STATES and after not in SWITCHES
            }
            if inside or tag == "section":
                words -= TOPIC_WORDS
            if words and (inside or parts[0] in OF_ARTICLE):
                words -= {"header"}
            if words & OTHERS_WORDS:
                bar = OTHERS
            elif words:
                bar = max(bar, NAMED if len(parts) == 1 else LAYOUT)
    return bar


def blocks(page: str) -> tuple[list[Block], Paths]:
    """Blocks in page order, and the paths they hang on. Tolerates unclosed and stray tags and pages cut off anywhere."""
    paths = Paths()
    stack: list[tuple[str, int, int]] = []  # element, how far it bars what is in it, its path
    places: dict[str, list[int]] = {}  # of the open elements in the stack, by name
    endless: set[str] = set()  # raw elements without an end tag from here on
    out: list[Block] = []
    links, fresh = 0, True

    def text(piece: str) -> None:
        nonlocal fresh
        if "&" in piece:
            piece = html.unescape(piece)
        if fresh:
            if piece.isspace():
                return
            out.append(Block(stack[-1][2] if stack else 0, stack[-1][1] if stack else FREE))
            fresh = False
        out[-1].pieces.append(piece)
        if links:
            out[-1].linked += len(piece)

    def close(names: tuple, stops: tuple) -> None:
        k = -1
        for n in names:
            if (held := places.get(n)) and held[-1] > k:
                k = held[-1]
        if k < 0:
            return
        for n in stops:
            if (held := places.get(n)) and held[-1] >= k:
                return
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                links -= tag == "a" and links > 0
                continue
            fresh = True
            close((tag,), () if tag in CONTENT_TAGS or tag in ("body", "html") else ("article", "main", "body"))
            continue
        if tag == "br":
            if not fresh:
                out[-1].pieces.append(" ")
            continue
        if tag in EMBEDDED and m[3].endswith("/"):
            continue
        if tag in RAW:
            found = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if found is None:
                endless.add(tag)
            at = found.end() if found else at if tag in EMBEDDED else end
            continue
        if tag in INLINE:
            links += tag == "a" and not links
            continue
        fresh, links = True, 0
        if tag in CLOSES_P:
            close(("p",), ("div", "td", "th", "li", "article", "section", "body", "button"))
        if tag in SELF_CLOSING:
            names, stops = SELF_CLOSING[tag]
            close(names if isinstance(names, tuple) else (names,), stops)
        if tag in VOID or m[3].endswith("/") and tag not in CLOSES_P:
            continue
        _, bars, above = stack[-1] if stack else ("", FREE, 0)
        inside = paths.content[above]
        if tag in BOILERPLATE_TAGS or tag == "header" and not inside:
            bars = FIXED
        elif tag in CONTENT_TAGS:
            if bars == LAYOUT or tag == "main" and bars < FIXED:
                bars = FREE
        elif bars < FIXED and m[3] and tag not in ("html", "body"):
            own = FIXED if _HIDDEN.search(m[3]) else _name_bar(m[3], tag, inside)
            if own and paths.article[above]:
                own = max(own, OTHERS)
            bars = max(bars, own)
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, bars, paths.child(above, tag)))
    return out, paths


def smoothed(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Per path the values of all paths, weighted by a bell curve of the steps between them.

    ``below[d]`` are sums over the descendants d steps down; what lies d steps
    away in any direction is that and what lies d - 1 steps from the parent,
    less what the parent reaches back through the path itself. Of few paths all
    distances are a small matrix, with the same sums.
    """
    n = len(parent)
    if n <= FEW_PATHS:
        steps = np.zeros((n, n), np.int64)
        for v, above in enumerate(parent.tolist()[1:], 1):
            steps[v, :v] = steps[above, :v] + 1
            steps[:v, v] = steps[v, :v]
        return _BELL[np.minimum(steps, REACH + 1)] @ values
    below, away = [values], [values]
    for d in range(1, REACH + 1):
        sums = np.zeros_like(values)
        np.add.at(sums, parent[1:], below[-1][1:])
        around = sums.copy()
        around[1:] += away[-1][parent[1:]]
        if d > 1:
            around[1:] -= below[d - 2][1:]
        below.append(sums)
        away.append(around)
    return sum(_BELL[d] * a for d, a in enumerate(away))


def path_ratios(found: list[tuple[int, str, int]], paths: Paths) -> np.ndarray:
    """Fused, smoothed ratio of every path, by (path, text, characters in links)."""
    stats = np.zeros((len(paths), 4))
    np.add.at(stats, [p for p, _, _ in found], [(1, len(t), len(_PUNCTUATION.findall(t)), min(linked, len(t))) for _, t, linked in found])
    parent = np.array(paths.parent)
    weight, signs, total = smoothed(parent, np.stack([stats[:, 0], stats[:, 2], stats[:, 1] - stats[:, 3]], axis=1)).T
    weight = np.maximum(weight, 1e-30)
    ratio = total / weight * (1.0 + signs / weight) * (1.0 - stats[:, 3] / np.maximum(1, stats[:, 1]))
    return np.where(stats[:, 0] > 0, ratio * np.where(paths.content, CONTENT_BONUS, 1.0), 0.0)


def reads(text: str, linked: int) -> bool:
    """Prose, or a link that says more than the name of a button."""
    return 2 * linked <= len(text) or len(text.split()) > LINK_WORDS


def chosen_blocks(found: list[tuple[int, str, int]], paths: Paths) -> list[bool]:
    """Blocks of the paths whose ratio reaches the threshold, and those that belong to them.

    Where such a path lies in an article or main element, these are the other
    blocks of such elements that are not link buttons. Elsewhere they are the
    blocks among them, the headings right before and the list right behind,
    under the node of the path tree that holds nearly all of the chosen text.
    """
    ratios = path_ratios(found, paths)
    length = np.array([len(t) for _, t, _ in found], float)
    path = np.array([p for p, _, _ in found])
    need = SHARE * float(ratios[path] @ length) / length.sum()
    taken = (ratios[path] > 0) & (ratios[path] >= need)
    reading = np.array([reads(t, linked) for _, t, linked in found])
    content = np.array(paths.content)
    if (content[path] & taken).any():
        return (taken | content[path] & reading).tolist()
    places = np.flatnonzero(taken)
    if not len(places):
        return taken.tolist()
    under = np.zeros(len(paths))
    np.add.at(under, path[taken], length[taken])
    own = under > 0
    for node in range(len(paths) - 1, 0, -1):
        under[paths.parent[node]] += under[node]
    root = max(range(len(paths)), key=lambda n: n if under[n] >= ROOT_SHARE * under[0] else -1)
    root = paths.parent[root] if own[root] else root  # a block's own element holds no other blocks
    inside = np.zeros(len(paths), bool)
    for node in range(len(paths)):
        inside[node] = node == root or node > 0 and inside[paths.parent[node]]
    first, last = int(places[0]), int(places[-1])
    while first > 0 and inside[path[first - 1]] and paths.tag[path[first - 1]] in HEADINGS:
        first -= 1
    among = np.zeros(len(found), bool)
    among[first : last + 1] = True
    for k in range(last + 1, len(found)):  # a list behind the last of them goes on to its end
        if not inside[path[k]] or paths.tag[path[k]] != "li":
            break
        among[k] = True
    return (taken | among & inside[path] & reading).tolist()


def main_text(page: str | None) -> str:
    """The article's blocks, one per line; empty where there is none."""
    found = []
    every, paths = blocks(page or "")
    free = any(not b.barred and paths.content[b.path] for b in every)
    for block in every:
        if not block.barred or not free and block.barred == NAMED and paths.article[block.path]:
            text = " ".join("".join(block.pieces).split())
            if text:
                found.append((block.path, text, block.linked))
    if not found:
        return ""
    return "\n".join(t for (_, t, _), keep in zip(found, chosen_blocks(found, paths), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page, read whole, row by row without a shuffle.

    A null or empty page, and one without an article, gives the empty text.
    Very long and deeply nested pages take time and memory in proportion to
    their length. Repeated and null ids are kept, an empty table gives no rows,
    and columns of other names are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
