"""Main text of web pages by a minimum cut over their text blocks.

A page is cut into blocks at block-level tags. A logistic classifier gives every block the cost of being called content
and that of being called boilerplate; their difference is the capacity to the source or the sink. Its features are the
block's text and links, and its landmarks (article, navigation, class names, roles): these are evidence like the rest,
and dense text in one place can outvote a name. Landmarks of boilerplate that hold most words of a page lose weight
there, and have none where they hold nearly all. Neighbouring blocks, and successive blocks of one parent element, are joined by edges of the same order as
the classifier's costs that get weaker with their distance in the tree, so a weak block goes with its surroundings. The
minimum cut is the cheapest labelling; content blocks are joined in page order.

The classifier is fitted on the blocks of pages that have both kinds of landmarks, from a bounded sample of pages
(`SAMPLE_PAGES`, chosen by a hash of the html, `SAMPLE_BLOCKS` per page). Each block is learned from twice, with its
landmarks and without them, so that the text has to speak as well. All else covers the whole html of every page.

Reading takes time in proportion to the page, whatever the markup: a tag that never ends, an open quote or an open
script is found once. Elements nested deeper than `DEPTH` count as part of the one around them, as in browsers.

Defined results: a null or empty html has the text ""; broken markup is read as far as it goes (an open comment or
script runs to the end); rows are judged one by one, so repeated rows repeat; extra columns are carried through and
result columns replace those of the same name; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES, SAMPLE_BLOCKS = 500, 40
ADJACENT, SIBLING = 3.0, 1.0  # weights of the smoothness edges
ACROSS = 0.25  # what is left of an edge into an element that a landmark calls boilerplate
TEXT_LIMIT = 3.0  # largest cost that the text features make
MOST, NEARLY_ALL = 0.5, 0.9  # shares of a page's words between which a landmark of boilerplate loses its weight
DEPTH = 512

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_PART = re.compile(r"[>\"']")
# Elements whose content is no text of the page.
_HIDDEN = frozenset("script style title textarea iframe noembed noframes template".split())
_CLOSING = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _HIDDEN}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY = {
    "p": _BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"},
}
_OTHER_TAGS = frozenset("nav footer aside form menu dialog select button datalist object applet canvas audio video map label input".split())
_OTHER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar tablist toolbar status".split()
)
_OTHER_NAMES = frozenset(
    "nav navbar navigation menu sidebar footer header masthead topbar ad ads advert adverts advertisement advertising sponsor "
    "sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup share sharing social breadcrumb breadcrumbs comment comments commentlist reply replies "
    "respond discussion disqus related recommended recommendations widget toolbar copyright login search pagination pager "
    "skip hidden form".split()
)
_COMMENT_NAMES = frozenset("comment comments reply replies ad ads advert sponsored promo related teaser".split())
_MAIN_NAMES = frozenset(
    "article articlebody article-body article-content article-text entry-content post-content post-body story-body main-text".split()
)
_NEGATED = frozenset("has with without no is".split())
N_TEXT_FEATURES, N_FEATURES = 9, 11


# What is assumed of the features before any page is seen: long plain text is content, links and landmarks like
# navigation are not.
PRIOR = (-2.5, 0.9, -3.0, 1.0, 1.5, 0.0, 1.5, 0.1, 1.5, -4.5, 2.0)


@dataclass
class Block:
    text: str
    words: int
    link_chars: int
    tag: str
    path: tuple[int, ...]  # numbers of the open elements, outermost first
    other: int  # below an element that is not content: 1 by its place in the layout, 2 by a name for comments or adverts
    article: bool
    main: bool


def _names(value: str) -> list[list[str]]:
    spaced = re.sub(r"([a-z])([A-Z])", r"\1-\2", value)
    return [re.split(r"[-_]+", x.lower()) for x in spaced.split()]


def _role(tag: str, attributes: str, in_article: bool) -> tuple[int, bool, bool]:
    """Whether an element starts something that is not content (see Block), an article, or a main part."""
    other = tag in _OTHER_TAGS or (tag == "header" and not in_article)
    article, main = tag == "article", tag == "main"
    if not attributes or attributes.isspace() or tag in ("html", "body", "a"):
        return int(other), article, main
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    other |= role in _OTHER_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    other |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))
    article |= role == "article" or found.get("itemprop", "").lower() == "articlebody"
    main |= role == "main"
    other = int(other)
    for parts in _names(f"{found.get('class', '')} {found.get('id', '')}"):
        if parts[0] in _NEGATED:
            continue
        strong = _COMMENT_NAMES if article or main else _OTHER_NAMES
        if "-".join(parts) in _MAIN_NAMES:
            article = True
        elif parts[0] in strong or parts[-1] in strong:
            other = 2 if parts[0] in _COMMENT_NAMES or parts[-1] in _COMMENT_NAMES else max(other, 1)
    return other, article and not other, main


class _Tags:
    """Tags of a page from left to right, in linear time."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.failed: list[tuple[list[int], list[int]]] = []  # starts and ends of the quoted parts of scans without an end

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, outside quotes, from `at` on; -1 if there is none.

        A scan that finds none runs to the end, and any later one that starts outside its quotes would run along with
        it. At a place a scan can be outside or in one of two kinds of quotes, so at most three scans fail."""
        for starts, ends in self.failed:
            i = bisect_right(starts, at) - 1
            if i < 0 or at > ends[i]:
                return -1
        starts, ends, p = [], [], at
        while m := _TAG_PART.search(self.page, p):
            if m[0] == ">":
                return m.start()
            if self.quotes[m[0]] < m.end():  # open to the end of the page
                starts.append(m.end())
                ends.append(len(self.page))
                break
            p = self.page.find(m[0], m.end()) + 1
            starts.append(m.end())
            ends.append(p - 1)
        self.failed.append((starts, ends))
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, str | None, bool, str]]:
        """(start, end, name, closing, attributes); the name is None for what is no tag but no text either."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = len(page) if end < 0 else end + 3
                yield start, at, None, False, ""
                continue
            if start > self.last:
                return
            closing = page.startswith("/", start + 1)
            name = _NAME.match(page, start + 1 + closing)
            if not name:
                if page[start + 1 : start + 2] in ("!", "?"):
                    at = page.find(">", start) + 1
                    yield start, at, None, False, ""
                else:
                    at = start + 1
                continue
            end = self.tag_end(name.end())
            if end < 0:
                at = page.find(">", start) + 1
                yield start, at, None, False, ""
                continue
            at, tag = end + 1, name[0].lower()
            if tag in _HIDDEN and not closing:
                found = _CLOSING[tag].search(page, at)
                at = found.end() if found else len(page)
                yield start, at, None, False, ""
            else:
                yield start, at, tag, closing, page[name.end() : end]


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order. Character references are decoded and white space is one space."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]  # tag, number, other, article, main
    pieces: list[tuple[str, bool]] = []
    number, links = 0, 0
    too_deep: dict[str, int] = {}

    def flush() -> None:
        if not pieces:
            return
        words = "".join(t for t, _ in pieces)
        words = (html.unescape(words) if "&" in words else words).split()
        if words:
            top = next((s for s in reversed(stack) if s[0] in _BLOCKS or not s[0]), stack[0])
            flags = stack[-1]
            link = sum(len(t.strip()) for t, linked in pieces if linked)
            out.append(Block(" ".join(words), len(words), link, top[0], tuple(s[1] for s in stack), *flags[2:]))
        pieces.clear()

    at = 0
    for start, end, tag, closing, attributes in _Tags(page):
        if start > at:
            pieces.append((page[at:start], links > 0))
        at = end
        if tag is None:
            continue
        if tag in _BLOCKS:
            flush()
        if closing:
            if too_deep.get(tag):
                too_deep[tag] -= 1
            elif any(s[0] == tag for s in stack):
                inner = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if stack[-1][2] and not stack[inner - 1][2]:
                    flush()
                while len(stack) > 1:
                    top = stack.pop()
                    links -= top[0] == "a"
                    if top[0] == tag:
                        break
            continue
        if tag in _VOID or attributes.endswith("/"):
            continue
        for i in range(len(stack) - 1, 0, -1):  # end tags that may be left out
            open_tag = stack[i][0]
            if tag in _CLOSED_BY.get(open_tag, ()):
                links -= sum(s[0] == "a" for s in stack[i:])
                del stack[i:]
                break
            if open_tag in _BLOCKS:
                break
        if len(stack) > DEPTH:
            too_deep[tag] = too_deep.get(tag, 0) + 1
            continue
        number += 1
        other, article, main = _role(tag, attributes, stack[-1][3])
        if other and not stack[-1][2]:
            flush()
        stack.append((tag, number, max(stack[-1][2], other), stack[-1][3] or article, stack[-1][4] or main))
        links += tag == "a"
    if at < len(page):
        pieces.append((page[at:], links > 0))
    flush()
    return out


def landmarks(blocks: list[Block]) -> np.ndarray:
    """Per block: 1 below an element that is not content (less where places in the layout hold most words of the page);
    and 1 inside the article (or main part) of a page that has one, -1 outside it, 0 where there is none."""
    words, kind = np.array([b.words for b in blocks], float), np.array([b.other for b in blocks])
    other, out = kind > 0, np.zeros((len(blocks), 2))
    share = words[kind == 1].sum() / words.sum()
    out[:, 0] = np.where(kind == 2, 1, other * np.clip((NEARLY_ALL - share) / (NEARLY_ALL - MOST), 0, 1))
    for inside in ([b.article for b in blocks], [b.main for b in blocks]):
        inside = np.array(inside, bool)
        if (inside & ~other).any():
            out[:, 1] = np.where(inside, 1, -1)
            break
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """Text and link features of every block, then its landmarks."""
    rows = []
    for i, b in enumerate(blocks):
        near = [blocks[j].words for j in (i - 1, i + 1) if 0 <= j < len(blocks)]
        rows.append((
            1.0, math.log1p(b.words), b.link_chars / max(1, len(b.text)), sum(c in ".,;:!?" for c in b.text) / b.words,
            b.tag in ("p", "blockquote", "pre"), b.tag in ("li", "td", "th", "dd", "dt"), b.tag[:1] == "h" and b.tag[1:].isdigit(),
            math.log1p(sum(near)), min(b.words, 40) / 40 * (b.link_chars == 0),
        ))
    text = np.array(rows, dtype=float).reshape(-1, N_TEXT_FEATURES)
    return np.concatenate([text, landmarks(blocks)], axis=1) if len(blocks) else np.zeros((0, N_FEATURES))


def known_labels(marks: np.ndarray) -> np.ndarray:
    """What landmarks say on a page that has both kinds: 1 content, -1 boilerplate, 0 unknown."""
    if not (marks[:, 0] > 0).any() or not (marks[:, 1] > 0).any():
        return np.zeros(len(marks))
    return np.where(marks[:, 0] > 0, -1, marks[:, 1])


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page, and between successive blocks of one parent element."""
    edges, last_of = [], {}
    for i, b in enumerate(blocks):
        if i:
            p, q = blocks[i - 1].path, b.path
            shared = next((k for k, (x, y) in enumerate(zip(p, q, strict=False)) if x != y), min(len(p), len(q)))
            weight = ADJACENT / (1 + len(p) + len(q) - 2 * shared)
            edges.append((i - 1, i, weight if blocks[i - 1].other == b.other else ACROSS * weight))
        parent = b.path[-2] if len(b.path) > 1 else b.path[-1]
        if last_of.get(parent, i - 1) < i - 1:
            edges.append((last_of[parent], i, SIBLING if blocks[last_of[parent]].other == b.other else ACROSS * SIBLING))
        last_of[parent] = i
    return edges


def minimum_cut(gain: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels that minimise the sum of max(0, gain) of rejected blocks, max(0, -gain) of accepted ones, and the weights
    of edges whose ends differ. Blocks whose gain outweighs all their edges are decided at once; the rest by max-flow."""
    n = len(gain)
    gain, label = gain.astype(float).copy(), np.zeros(n, dtype=np.int8)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] or abs(gain[i]) < sum(near[i].values()) or gain[i] == 0:
            continue
        label[i] = 1 if gain[i] > 0 else -1
        for j, w in near[i].items():
            gain[j] += w * label[i]
            del near[j][i]
            todo.append(j)
        near[i] = {}
    open_blocks = [i for i in range(n) if not label[i]]
    for i, side in zip(open_blocks, _max_flow(open_blocks, gain, near), strict=True):
        label[i] = 1 if side else -1
    return label > 0


def _max_flow(nodes: list[int], gain: np.ndarray, near: list[dict[int, float]]) -> list[bool]:
    """Dinic's algorithm; which nodes stay on the source's side."""
    source, sink = -1, -2
    capacity: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in nodes:
        capacity[i] = dict(near[i])
    for i in nodes:
        capacity[source][i] = max(0.0, gain[i])
        capacity[i][source] = 0.0
        capacity[i][sink] = max(0.0, -gain[i])
        capacity[sink][i] = 0.0
    tiny = 1e-12
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in capacity[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [i in level for i in nodes]
        left = {u: list(capacity[u]) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(capacity[a][b] for a, b in zip(path, path[1:], strict=False))
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    capacity[a][b] -= flow
                    capacity[b][a] += flow
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if capacity[a][b] <= tiny)
                del path[cut + 1 :]
                continue
            while left[u]:
                v = left[u][-1]
                if capacity[u][v] > tiny and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
                left[u].pop()
            else:
                path.pop()
                if path:
                    left[path[-1]].pop()


def gains(blocks: list[Block], weights: np.ndarray) -> np.ndarray:
    """Log odds of content against boilerplate: those of the text, up to TEXT_LIMIT, and those of the landmarks. A landmark
    weighs at least what is assumed of it, as pages without adverts teach nothing of these."""
    x, marks = features(blocks), np.maximum(np.abs(weights[N_TEXT_FEATURES:]), np.abs(PRIOR[N_TEXT_FEATURES:])) * (-1, 1)
    text = np.clip(x[:, :N_TEXT_FEATURES] @ weights[:N_TEXT_FEATURES], -TEXT_LIMIT, TEXT_LIMIT)
    return text + x[:, N_TEXT_FEATURES:] @ marks


def main_text(page: str | None, weights: np.ndarray) -> str:
    """Text of the content blocks, joined by one space."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    kept = minimum_cut(gains(blocks, weights), smoothness(blocks))
    return " ".join(b.text for b, content in zip(blocks, kept, strict=True) if content)


def fit_weights(samples: np.ndarray, labels: np.ndarray, steps: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards PRIOR, both classes weighing the same; PRIOR where one is missing."""
    weights = np.array(PRIOR)
    if not 0 < labels.sum() < len(labels):
        return weights
    share = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum())) * len(labels)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(samples @ weights, -30, 30)))
        slope = samples.T @ (share * (p - labels)) + ridge * (weights - PRIOR)
        curve = (samples * (share * p * (1 - p))[:, None]).T @ samples + ridge * np.eye(N_FEATURES)
        weights = weights - np.linalg.solve(curve, slope)
    return weights


def fit_classifier(pages: DataFrame, html_column: str = "html") -> np.ndarray:
    """Weights learned from pages that have both kinds of landmarks, in a bounded sample."""
    rows = pages.select(F.col(f"`{html_column}`").alias("html")).filter("html IS NOT NULL")
    n = rows.count()
    share = min(1.0, 4 * SAMPLE_PAGES / max(n, 1))
    order = F.xxhash64("html")
    near = rows.filter(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(order.alias("h"), "html")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values, labels = [], [], []
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks = blocks_of(page)
                x = features(blocks)
                y, bare = known_labels(x[:, N_TEXT_FEATURES:]), x * (np.arange(N_FEATURES) < N_TEXT_FEATURES)
                for i in range(0, len(blocks), -(-len(blocks) // SAMPLE_BLOCKS) or 1):
                    for seen in (x, bare) if y[i] else ():
                        keys.append(h)
                        values.append(seen[i].tolist())
                        labels.append(float(y[i] > 0))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(values, pa.list_(pa.float64())), pa.array(labels, pa.float64())],
                                  names=["h", "x", "y"])

    found = near.mapInArrow(sample, "h long, x array<double>, y double")
    got = found.orderBy("h", "y", "x").limit(2 * SAMPLE_PAGES * SAMPLE_BLOCKS).collect()
    if not got:
        return np.array(PRIOR)
    return fit_weights(np.array([r["x"] for r in got]), np.array([r["y"] for r in got]))


def extract(pages: DataFrame, weights: np.ndarray, html_column: str = "html", carry: list[str] | None = None) -> DataFrame:
    """All rows with `text` and `n_chars`; of the input all columns, or those named in `carry`."""
    names = [c for c in (pages.columns if carry is None else carry) if c.lower() not in ("text", "n_chars")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{html_column}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), weights) for page in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    found = rows.mapInArrow(run, rows.select("row").schema.toDDL() + ", text string")
    return found.select("row.*", "text", F.length("text").cast("long").alias("n_chars"))
