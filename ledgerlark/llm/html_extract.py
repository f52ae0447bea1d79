"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks with the path of elements around each. What HTML says of the elements (an article, a menu, a
footer) is evidence of its own; a logistic classifier over a block's text and over the class and id words around it is fitted
on the blocks where that evidence is clear, and speaks for those where it is not. Their sum, the log-odds of being content,
becomes the block's capacity to one of the two terminals. Blocks that follow each other, and blocks under one element, are tied
by smoothness edges, elements to the elements around them likewise. The minimum cut, found by maximum flow, parts content from
boilerplate.

The classifier is fitted on at most ``FIT_PAGES`` pages (the least by a hash of id and address), ``FIT_BLOCKS`` blocks of each,
by penalised Newton steps from the weights in ``PRIOR``; with few clear blocks it stays near those.

Defined cases: null or empty html has an empty text; unclosed and stray tags are closed as browsers do, as far as blocks need
it; null and repeated ids and urls are passed through.
"""

from __future__ import annotations

import re
from collections import deque
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style template noscript svg math iframe object audio video canvas select datalist textarea button option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img input".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: Log-odds of content given an element around a block.
TAGS = {
    "article": 4.0, "main": 3.0, "blockquote": 0.5, "p": 1.0, "pre": 0.5, "h1": 0.8, "h2": 0.3, "h3": 0.3, "td": -0.3, "li": -0.5,
    "nav": -7.0, "footer": -7.0, "aside": -6.0, "form": -6.0, "menu": -6.0, "dialog": -6.0, "header": -4.5, "address": -2.0, "fieldset": -3.0, "figcaption": -0.3,
}
BAD = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|commentlist|respond|disqus|replies|reply|discussion|sidebar|side|aside|widget\w*|menu\w*|nav\w*|breadcrumbs?|pagination|pager|"
    r"foot|footer|header|masthead|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|trending|popular|copyright|legal|disclaimer|toolbar|search|tags?|hidden|form)(?:$|[-_ ])"
)
GOOD = re.compile(r"(?:^|[-_ ])(?:article|content|entry|post|story|main|body|text|prose)(?:$|[-_ ])")
BLOCK_TIE, PARENT_TIE, UP_TIE = 0.5, 1.0, 0.8
SCALE = 1000
FIT_PAGES, FIT_BLOCKS = 2000, 64
WORD_BITS = 8
CLEAR_CONTENT, CLEAR_REST = 3.0, -4.0
#: Weights of the text features before any fitting: intercept, words (up to 40), a sentence's end, share of link text, of digits, of capitals, long lines.
PRIOR = (-0.8, 2.4, 0.5, -4.0, 0.0, 0.0, 0.0)
PENALTY = 20.0
DIGITS, CAPITALS = re.compile("[0-9]"), re.compile("[A-ZÀ-ÖØ-Þ]")


class Blocks(HTMLParser):
    """Blocks of a page: text, number of its characters inside links, and the element it stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names, self.parents, self.scores, self.silent = ["#page"], [-1], [0.0], [False]
        self.words_of: list[frozenset[int]] = [frozenset()]
        self.stack = [0]
        self.blocks: list[tuple[str, int, int]] = []
        self.words: list[str] = []
        self.linked, self.links = 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            at = next(i for i in reversed(self.stack) if self.names[i] not in INLINE)
            self.blocks.append((text, min(self.linked, len(text)), at))
        self.words, self.linked = [], 0

    def pop_to(self, depth: int) -> None:
        if any(self.names[i] not in INLINE for i in self.stack[depth:]):
            self.flush()
        self.links -= sum(self.names[i] == "a" for i in self.stack[depth:])
        del self.stack[depth:]

    def close_in(self, names: set[str], walls: set[str] | frozenset[str]) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.names[self.stack[depth]]
            if name in names:
                return self.pop_to(depth)
            if name in walls:
                return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.words.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag == "body":
            self.close_in({"head"}, frozenset())
        if tag in CLOSES_P:
            self.close_in({"p"}, {"button", "table", "article", "section", "div", "li", "td"})
        if tag in SIBLING:
            self.close_in(SIBLING[tag], WALLS[tag])
        if tag not in INLINE:
            self.flush()
        self.names.append(tag)
        self.parents.append(self.stack[-1])
        self.scores.append(element_score(tag, attrs))
        self.words_of.append(self.words_of[self.stack[-1]] | name_words(attrs))
        self.silent.append(self.silent[self.stack[-1]] or tag in SILENT)
        self.stack.append(len(self.names) - 1)
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # In HTML the slash of <div/> means nothing; void elements have no end.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.names[self.stack[depth]]
            if name == tag:
                return self.pop_to(depth)
            if tag in INLINE and name not in INLINE:
                return None

    def handle_data(self, data: str) -> None:
        if not self.silent[self.stack[-1]]:
            self.words.append(data)
            if self.links:
                self.linked += len(data)


def element_score(tag: str, attrs: list[tuple[str, str | None]]) -> float:
    score = TAGS.get(tag, 0.0)
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id", "role", "itemprop"):
            if tag not in ("body", "html") and BAD.search(value) or value in ("navigation", "complementary", "contentinfo", "search"):
                score -= 6.0
            elif GOOD.search(value):
                score += 2.0
        elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "") or name == "aria-hidden" and value == "true":
            score -= 8.0
    return score


def name_words(attrs: list[tuple[str, str | None]]) -> frozenset[int]:
    """Hashes of the words in the class and id of an element."""
    return frozenset(crc32(w.encode()) & (1 << WORD_BITS) - 1 for name, value in attrs if name in ("class", "id") for w in re.split(r"[^a-z0-9]+", (value or "").lower()) if w)


def text_features(text: str, linked: int) -> tuple[float, ...]:
    n = len(text)
    return 1.0, min(len(text.split()), 40) / 40, float(text[-1] in ".!?…\"'"), linked / n, len(DIGITS.findall(text)) / n, len(CAPITALS.findall(text)) / n, float(n > 400)


def page_blocks(html: str) -> tuple[Blocks, list[float]]:
    """The blocks of a page, and for each element the evidence of the elements around: the sum along the path."""
    page = Blocks()
    page.feed(html)
    page.close()
    page.flush()
    around = [0.0] * len(page.names)
    for i in range(1, len(page.names)):
        around[i] = around[page.parents[i]] + page.scores[i]
    return page, [max(-9.0, min(5.0, x)) for x in around]


class TextModel:
    """Log-odds of content from a block's own text and the names around it."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.array([*PRIOR, *[0.0] * (1 << WORD_BITS)]) if weights is None else weights
        self.plain, self.named = self.weights[: len(PRIOR)].tolist(), self.weights[len(PRIOR) :].tolist()

    def odds(self, text: str, linked: int, words: frozenset[int]) -> float:
        out = sum(w * x for w, x in zip(self.plain, text_features(text, linked), strict=True)) + sum(self.named[i] for i in words)
        return max(-6.0, min(6.0, out))


def fit(features: np.ndarray, words: list[list[int]], content: np.ndarray, steps: int = 12) -> TextModel:
    """Logistic regression with a Gaussian penalty around the prior weights."""
    x = np.zeros((len(content), len(PRIOR) + (1 << WORD_BITS)))
    x[:, : len(PRIOR)] = features
    for i, own in enumerate(words):
        x[i, [len(PRIOR) + w for w in own]] = 1.0
    prior = TextModel().weights
    weights = prior.copy()
    for _ in range(steps if len(content) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (content - p) - PENALTY * (weights - prior)
        bend = (x * (p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(weights))
        move = np.linalg.solve(bend, slope)
        weights = weights + move
        if np.abs(move).max() < 1e-6:
            break
    return TextModel(weights)


def minimum_cut(net: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """The side of each node: ``net`` > 0 pulls to the content side; ``ties`` are paid where they are cut. Dinic's algorithm."""
    n = len(net)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def edge(a: int, b: int, there: int, back: int) -> None:
        heads[a].append(len(to))
        heads[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, x in enumerate(net):
        if x > 0:
            edge(source, i, round(x * SCALE), 0)
        elif x < 0:
            edge(i, sink, round(-x * SCALE), 0)
    for (a, b), w in ties.items():
        edge(a, b, round(w * SCALE), round(w * SCALE))
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                full = next(i for i, e in enumerate(path) if not room[e])
                node = to[path[full] ^ 1]
                del path[full:]
                continue
            edges = heads[node]
            while at[node] < len(edges) and not (room[edges[at[node]]] and level[to[edges[at[node]]]] == level[node] + 1):
                at[node] += 1
            if at[node] < len(edges):
                path.append(edges[at[node]])
                node = to[path[-1]]
            elif path:
                level[node] = -1
                node = to[path.pop() ^ 1]
            else:
                break


def main_text(html: str, model: TextModel | None = None) -> str:
    page, around = page_blocks(html)
    if not page.blocks:
        return ""
    model, n = model or TextModel(), len(page.blocks)
    net = [model.odds(text, linked, page.words_of[at]) + around[at] for text, linked, at in page.blocks]
    nodes: dict[int, int] = {}
    ties: dict[tuple[int, int], float] = {}

    def element(i: int) -> int:
        if i not in nodes:
            nodes[i] = n + len(nodes)
            net.append(0.0)
        return nodes[i]

    for b, (_, _, at) in enumerate(page.blocks):
        if b:
            ties[b - 1, b] = BLOCK_TIE * (2.0 if page.blocks[b - 1][2] == at or page.parents[page.blocks[b - 1][2]] == page.parents[at] else 0.5)
        # A block's own element holds no other block as a rule; its parent is what blocks share.
        up, tie = page.parents[at], PARENT_TIE
        a = b
        while up > 0:
            known = up in nodes
            ties[a, element(up)] = tie
            if known:
                break
            a, up, tie = nodes[up], page.parents[up], UP_TIE
    content = minimum_cut(net, ties)
    return " ".join(text for (text, _, _), keep in zip(page.blocks, content, strict=False) if keep)


def _clear_batches(batches):
    """Blocks whose elements say clearly what they are: text features, names around, label."""
    for batch in batches:
        rows = []
        for html in batch.column("html").to_pylist():
            page, around = page_blocks(html or "")
            clear = [(text_features(text, linked), sorted(page.words_of[at]), around[at] >= CLEAR_CONTENT) for text, linked, at in page.blocks if not CLEAR_REST < around[at] < CLEAR_CONTENT]
            rows += clear[:FIT_BLOCKS]
        columns = [*zip(*rows, strict=True)] if rows else [[]] * 3
        kinds = [pa.list_(pa.float64()), pa.list_(pa.int32()), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["features", "words", "content"])


def fit_model(pages: DataFrame) -> TextModel:
    """The text classifier, from the clear blocks of a bounded number of pages."""
    # The hash of the last page that still takes part; only hashes are sorted, never pages.
    last = pages.select(F.xxhash64("page_id", "url").alias("at")).orderBy("at").limit(FIT_PAGES).agg(F.max("at")).first()[0]
    some = pages.where(F.xxhash64("page_id", "url") <= F.lit(last)).select("html")
    rows = some.mapInArrow(_clear_batches, "features array<double>, words array<int>, content boolean").limit(FIT_PAGES * FIT_BLOCKS).toArrow()
    features = rows.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(PRIOR)) if rows.num_rows else np.zeros((0, len(PRIOR)))
    return fit(features, rows.column("words").to_pylist(), np.array(rows.column("content").to_pylist(), float))


def _extract_batches(model):
    def run(batches):
        own = TextModel(model.value)
        for batch in batches:
            texts = [main_text(h or "", own) for h in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, model: TextModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages (page_id long, url, html)``; without a model, one is fitted on the pages first."""
    spark = pages.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((model or fit_model(pages)).weights)
    return pages.select("page_id", "url", "html").mapInArrow(_extract_batches(sent), "page_id long, url string, text string, n_chars long")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
