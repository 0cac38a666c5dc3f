"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of nodes: block elements, and inline elements that have a class, id or role. Each node has features of its tag, the tokens of its
attributes and its ancestors', the density of text, links and tags in its subtree, its depth, its place in the page and statistics of its siblings.
Attribute tokens are words and character 4-grams of classes, ids and roles, hashed into `TOKEN_BUCKETS`; how far each speaks for the article is counted on other
training pages than those the trees learn from, so a name that was never seen still speaks by its parts, and a strange one says nothing.
Boosted trees, trained on the driver from pages made by rule (dom_training), give the probability that a node holds part of the article.
Decoding picks the likeliest labelling in which a node is kept only if its parent is, by one pass up and one pass down the tree; so no
text is kept inside a dropped element. A page of which nothing would be kept is decoded once more with all odds raised by `SECOND_CHANCE`.

The kept nodes' text, in page order, is cut into blocks at block elements' tags. Character references are decoded, white space inside a block becomes one space,
blocks are trimmed, empty ones dropped, and the rest joined by a blank line.

Scripts, styles, templates, head, buttons, comments and other elements that are no text are dropped by the parser. A head that isn't closed ends before the first tag
or text that can't be in it; a script, style, title or textarea that isn't closed ends at the next block element's tag, another such element is read as if it were none. Defined cases: null or empty html has the text ''. Text without any
element, or with unclosed, crossed or unknown tags, is read as browsers do in the common cases (p, li, td and the like close themselves).
Extra columns are carried along unless named like a result. Repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields, pack, table, unpack
from .dom_training import labelled_pages

TRAIN_PAGES, TREES, TREE_DEPTH, BINS = 1200, 60, 5, 32
#: Pages on which tokens are counted, and buckets they are hashed into.
TOKEN_PAGES, TOKEN_BUCKETS = 600, 1 << 14
#: Log-odds added to all nodes of a page of which nothing would be kept.
SECOND_CHANCE = 1.5
#: Characters of html parsed before the nodes are classified together.
JOB = 4 << 20

# Fixed values of the HTML language.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas audio video textarea select datalist button title noframes noembed xmp annotation annotation-xml".split())
#: What is plain text up to its end tag, and what a head may hold.
PLAIN = frozenset("script style textarea title xmp noframes noembed".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key closes an open element of these, looked for up to the barriers.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",)}
BARRIERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}
SPACE = re.compile(r"\s+")

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|data-y|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

TAG_GROUPS = [("nav", "menu"), ("header",), ("footer",), ("aside",), ("article", "main"), ("section",), ("div", "center"), ("p",), tuple(sorted(HEADINGS)), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("form", "fieldset", "legend", "search"), ("figure", "figcaption"), ("blockquote", "pre"), ("html", "body"), ("dialog", "details", "summary")]
GROUP_OF = {t: k for k, g in enumerate(TAG_GROUPS) for t in g}
OTHER = len(TAG_GROUPS)
_END_OF_PLAIN = re.compile(r"</?(?:" + "|".join(sorted(BLOCK | {"head"}, key=len, reverse=True)) + r")[\s/>]", re.I)


def tokens_of(value: str) -> list[int]:
    """The buckets of the words of a class, id or role, of neighbouring ones joined, and of the words' character 4-grams."""
    found = set()
    for name in value.split():
        parts = [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", name)]
        found |= {*parts, *map("".join, zip(parts, parts[1:]))}
        for p in parts:
            found |= {f"^{p}$"[k : k + 4] + "*" for k in range(len(p) - 1)}
    return sorted({zlib.crc32(t.encode()) % TOKEN_BUCKETS for t in found})


@dataclass
class TokenScores:
    """What attribute tokens say: log-odds of being part of the article, by bucket; 0 for what was never seen."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(TOKEN_BUCKETS))
    seen: dict[str, float] = field(default_factory=dict, repr=False)

    @classmethod
    def fit(cls, attributes: list[str], y: np.ndarray, smooth: float = 2.0) -> TokenScores:
        counts = np.zeros((2, TOKEN_BUCKETS))
        for value, label in zip(attributes, y.astype(int).tolist()):
            if value:
                counts[label, tokens_of(value)] += 1
        rate = (counts + smooth) / (counts.sum(1, keepdims=True) + smooth * TOKEN_BUCKETS) * counts.sum(1, keepdims=True).max()
        some = counts.sum(0) > 0
        return cls(np.where(some, np.log(rate[1]) - np.log(rate[0]), 0.0))

    def score(self, value: str) -> float:
        """The mean over the tokens that say anything."""
        found = self.seen.get(value)
        if found is None:
            w = self.weights[tokens_of(value)]
            w = w[w != 0]
            found = float(w.mean()) if len(w) else 0.0
            if len(self.seen) < 100_000:
                self.seen[value] = found
        return found


class Forest:
    """Nodes of many pages in document order, as parallel lists."""

    def __init__(self):
        self.parent, self.group, self.hidden, self.depth, self.label, self.attributes = [], [], [], [], [], []
        self.tags, self.text, self.linked, self.stops, self.page = [], [], [], [], []
        self.runs: list[tuple[int, str | None]] = []  # (node, text), or (-1, None) where a block ends
        self.first_run: list[int] = []

    def add_page(self, source: str) -> None:
        number = len(self.first_run)
        self.first_run.append(len(self.runs))
        open_tags: list[tuple[str, int]] = []  # every open element and the node it makes or lies in
        root = self._node(-1, "html", "", number)
        node, links, at, in_head = root, 0, 0, False
        end_of_text = len(source)
        find, runs = MARKUP.search, self.runs
        while at < end_of_text:
            m = find(source, at)
            stop = m.start() if m else end_of_text
            if stop > at:
                in_head = in_head and source[at:stop].isspace()
                if not in_head:
                    self._text(node, source[at:stop], links)
            if not m:
                break
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if tag == "head":
                in_head = not m[1]
                continue
            in_head = in_head and tag in IN_HEAD
            if m[1]:
                for k in range(len(open_tags) - 1, -1, -1):
                    name, inside = open_tags[k]
                    if name == tag:
                        links -= sum(n == "a" for n, _ in open_tags[k:])
                        if any(n in BLOCK for n, _ in open_tags[k:]):
                            runs.append((-1, None))
                        del open_tags[k:]
                        node = open_tags[-1][1] if open_tags else root
                        break
                    if name in BLOCK and tag not in BLOCK:
                        break
                continue
            if tag in RAW and not m[3].endswith("/"):
                close = _end_tag(tag).search(source, at)
                if close:
                    at = close.end()
                    continue
                if tag in PLAIN:  # never closed: up to the next block, if there is one
                    close = _END_OF_PLAIN.search(source, at)
                    at = close.start() if close else end_of_text
                    continue
            elif tag in RAW:
                continue
            if tag in VOID:
                if tag in ("br", "wbr"):
                    runs.append((node, " " if tag == "br" else ""))
                elif tag == "hr":
                    runs.append((-1, None))
                self.tags[node] += 1
                continue
            if tag in BLOCK:
                runs.append((-1, None))
                self._close(open_tags, tag)
                links = sum(n == "a" for n, _ in open_tags)
                node = open_tags[-1][1] if open_tags else root
            attrs = m[3] if m[3] and "=" in m[3] or "hidden" in m[3] else ""
            if tag in BLOCK or "class" in attrs or "id" in attrs or "role" in attrs or "data-y" in attrs:
                node = self._node(node, tag, attrs, number)
            else:
                self.tags[node] += 1
            links += tag == "a"
            open_tags.append((tag, node))
        runs.append((-1, None))

    def _close(self, open_tags: list[tuple[str, int]], tag: str) -> None:
        """Ends the elements that a block's start tag ends by itself."""
        if any(n == "p" for n, _ in open_tags[-8:]):
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == "p":
                    del open_tags[k:]
                    break
                if open_tags[k][0] in BLOCK:
                    break
        for k in range(len(open_tags) - 1, -1, -1) if tag in CLOSES else ():
            if open_tags[k][0] in BARRIERS.get(tag, ()):
                break
            if open_tags[k][0] in CLOSES[tag]:
                del open_tags[k:]
                if tag in ("dt", "dd", "li", "td", "th"):
                    break

    def _node(self, parent: int, tag: str, attrs: str, page: int) -> int:
        n, hidden, label, names = len(self.parent), False, -1, []
        for name, *values in ATTRIBUTE.findall(attrs) if attrs else ():
            value, name = "".join(values), name.lower()
            if name in ("class", "id"):
                names.append(value)
            elif name == "role":
                names.append("role" + value.capitalize() if value.isalpha() else value)
            elif name == "data-y":
                label = int(value)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
        self.parent.append(parent)
        self.group.append(GROUP_OF.get(tag, OTHER))
        self.hidden.append(hidden)
        self.attributes.append(" ".join(names))
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.label.append(label)
        self.tags.append(1)
        self.text.append(0)
        self.linked.append(0)
        self.stops.append(0)
        self.page.append(page)
        return n

    def _text(self, node: int, text: str, links: int) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.runs.append((node, text))
        n = len(text)
        self.text[node] += n
        self.stops[node] += text.count(".") + text.count(",")
        if links:
            self.linked[node] += n

    def arrays(self) -> dict[str, np.ndarray]:
        out = {k: np.array(getattr(self, k), np.int64) for k in ("parent", "group", "hidden", "depth", "label", "tags", "text", "linked", "stops", "page")}
        out["end"] = subtree_ends(out["depth"])
        out["attributes"] = self.attributes
        return out


@lru_cache(None)
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def subtree_ends(depth: np.ndarray) -> np.ndarray:
    """For nodes in document order, where each one's subtree ends: at the next node that isn't deeper."""
    n = len(depth)
    end, open_nodes, depths = np.full(n, n, np.int64), [], depth.tolist()
    for k, d in enumerate(depths):
        while open_nodes and depths[open_nodes[-1]] >= d:
            end[open_nodes.pop()] = k
        open_nodes.append(k)
    return end


def features(a: dict, scores: TokenScores) -> np.ndarray:
    """A row of features for each node."""
    n, parent, end = len(a["parent"]), a["parent"], a["end"]
    at, up = np.arange(n), np.maximum(parent, 0)
    top = parent < 0

    def subtree(x: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(x)]
        return (sums[end] - sums[at]).astype(np.float64)

    text, linked, tags, stops = (subtree(a[k]) for k in ("text", "linked", "tags", "stops"))
    paragraphs, headings = subtree(a["group"] == GROUP_OF["p"]), subtree(a["group"] == GROUP_OF["h1"])
    # what ancestors are: a node comes after its parent, so level by level from the top
    own = np.array([scores.score(v) if v else 0.0 for v in a["attributes"]])
    named = np.array([bool(v) for v in a["attributes"]], np.int64)
    above_least, above_sum, above_hidden, above_groups = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(1, int(a["depth"].max(initial=0)) + 1):
        rows = np.flatnonzero(a["depth"] == d)
        p = parent[rows]
        above_least[rows] = np.minimum(above_least[p], own[p])
        above_sum[rows] = above_sum[p] + own[p]
        above_hidden[rows] = above_hidden[p] | a["hidden"][p]
        above_groups[rows] = above_groups[p] | np.left_shift(1, a["group"][p])
    root_of = np.flatnonzero(top)[np.cumsum(top) - 1] if n else at
    text_before = np.r_[0, np.cumsum(a["text"])][at] - np.r_[0, np.cumsum(a["text"])][root_of]
    page_text = np.maximum(1, text[root_of])
    child = ~top
    siblings = np.bincount(up[child], minlength=n).astype(np.float64)[up] * child
    key = up * 64 + a["group"]
    _, which, alike = np.unique(np.where(child, key, -1), return_inverse=True, return_counts=True)
    order = np.argsort(np.where(child, up, -1), kind="stable")
    starts = np.r_[True, up[order][1:] != up[order][:-1]]
    place = np.empty(n)
    place[order] = at - np.maximum.accumulate(np.where(starts, at, 0)) if n else at
    largest = np.zeros(n)
    np.maximum.at(largest, up[child], text[child])
    mean_sibling = np.bincount(up[child], text[child], n)[up] / np.maximum(1, siblings)
    columns = [
        *(a["group"] == k for k in range(OTHER + 1)),
        own,
        named,
        a["hidden"],
        above_least,
        above_sum,
        above_hidden,
        *((above_groups >> k) & 1 for k in (0, 1, 2, 3, 4, 12, 16)),
        a["depth"],
        np.log1p(text),
        np.log1p(a["text"]),
        linked / np.maximum(1, text),
        tags / np.maximum(1, text),
        stops / np.maximum(1, text),
        np.log1p(paragraphs),
        np.log1p(headings),
        text / page_text,
        text_before / page_text,
        siblings,
        alike[which] * child,
        place,
        place / np.maximum(1, siblings),
        text / np.maximum(1, largest[up]),
        text / np.maximum(1, mean_sibling),
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1) if n else np.zeros((0, len(columns)), np.float32)


class Boosted:
    """Gradient-boosted trees of fixed depth for the logistic loss, on binned features."""

    def __init__(self):
        self.base, self.trees = 0.0, []

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = TREE_DEPTH, rate: float = 0.25, ridge: float = 2.0) -> Boosted:
        self = cls()
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
        share = min(0.99, max(0.01, y.mean()))
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            slope, curve = y - p, p * (1 - p)
            leaf, feature, value = np.zeros(len(y), np.int64), [], []
            for level in range(depth):
                gains, n_leaves = np.full(1 << level, 1e-6), 1 << level
                best_f, best_c = np.zeros(n_leaves, np.int64), np.full(n_leaves, BINS, np.int64)
                for j in range(len(cuts)):
                    cell = leaf * (BINS + 1) + binned[j]
                    g = np.cumsum(np.bincount(cell, slope, n_leaves * (BINS + 1)).reshape(n_leaves, -1), axis=1)
                    h = np.cumsum(np.bincount(cell, curve, n_leaves * (BINS + 1)).reshape(n_leaves, -1), axis=1)
                    gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                    k = gain[:, : len(cuts[j])].argmax(1) if len(cuts[j]) else np.zeros(n_leaves, np.int64)
                    found = gain[np.arange(n_leaves), k] if len(cuts[j]) else np.zeros(n_leaves)
                    better = found > gains
                    gains[better], best_f[better], best_c[better] = found[better], j, k[better]
                threshold = np.array([cuts[f][c] if c < len(cuts[f]) else np.inf for f, c in zip(best_f, best_c)])
                feature.append(best_f)
                value.append(threshold)
                leaf = 2 * leaf + (x[np.arange(len(y)), best_f[leaf]] > threshold[leaf])
            g, h = np.bincount(leaf, slope, 1 << depth), np.bincount(leaf, curve, 1 << depth)
            weight = rate * g / (h + ridge)
            z += weight[leaf]
            self.trees.append((feature, value, weight))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, value, weight in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for f, v in zip(feature, value):
                leaf = 2 * leaf + (x[rows, f[leaf]] > v[leaf])
            z += weight[leaf]
        return z


@dataclass
class Model:
    scores: TokenScores
    trees: Boosted

    def logits(self, a: dict) -> np.ndarray:
        return self.trees.logits(features(a, self.scores))


def _learnt(pages: list[str]) -> tuple[dict, np.ndarray]:
    """Nodes of labelled pages, and which belong to the article."""
    forest = Forest()
    for page in pages:
        forest.add_page(page)
    a = forest.arrays()
    label = a["label"].tolist()
    parent = a["parent"].tolist()
    for k, p in enumerate(parent):  # inherit downwards; an element that holds some of the article counts as part of it
        if label[k] < 0 and p >= 0 and label[p] >= 0:
            label[k] = label[p]
    for k in range(len(parent) - 1, 0, -1):
        if label[k] == 1 and parent[k] >= 0 and label[parent[k]] < 0:
            label[parent[k]] = 1
    return a, (np.array(label) == 1).astype(np.float64)


def train(pages: list[str], token_pages: list[str]) -> Model:
    """Tokens are counted on pages of their own: on those that the trees learn from they would look surer than they are."""
    a, y = _learnt(token_pages)
    scores = TokenScores.fit(a["attributes"], y)
    a, y = _learnt(pages)
    return Model(scores, Boosted.fit(features(a, scores), y))


@lru_cache(1)
def trained_model(pages: int = TRAIN_PAGES) -> Model:
    return train(labelled_pages(pages), labelled_pages(TOKEN_PAGES, seed=3))


def decode(a: dict, z: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the likeliest labelling in which no node is kept under a dropped one. z: log-odds."""
    n = len(z)
    keep_gain = np.minimum(0, z) - np.log1p(np.exp(-np.abs(z)))
    drop_gain = np.minimum(0, -z) - np.log1p(np.exp(-np.abs(z)))
    sums = np.r_[0.0, np.cumsum(drop_gain)]
    dropped = sums[a["end"]] - sums[:n]
    best, parent, depth = keep_gain.copy(), a["parent"], a["depth"]
    deepest = int(depth.max(initial=0))
    levels = [np.flatnonzero(depth == d) for d in range(deepest + 1)]
    for rows in reversed(levels[1:]):
        np.add.at(best, parent[rows], np.maximum(best[rows], dropped[rows]))
    kept = np.zeros(n, bool)
    if n:
        kept[levels[0]] = True  # the page itself
    for rows in levels[1:]:
        kept[rows] = kept[parent[rows]] & (best[rows] > dropped[rows])
    return kept


def extract_texts(pages: list[str], model: Model) -> list[str]:
    forest = Forest()
    for page in pages:
        forest.add_page(page)
    a = forest.arrays()
    z = model.logits(a)
    kept = decode(a, z)
    # pages that would have no text at all are decoded again, with the benefit of the doubt
    bare = np.bincount(a["page"], a["text"] * kept, len(pages)) == 0
    kept = (decode(a, z + SECOND_CHANCE * bare[a["page"]]) if bare.any() else kept).tolist()
    out = []
    for k, first in enumerate(forest.first_run):
        stop = forest.first_run[k + 1] if k + 1 < len(forest.first_run) else len(forest.runs)
        blocks, block = [], []
        for node, text in forest.runs[first:stop]:
            if node < 0:
                if block:
                    joined = " ".join("".join(block).split())
                    if joined:
                        blocks.append(joined)
                    block = []
            elif kept[node]:
                block.append(text)
        out.append("\n\n".join(blocks))
    return out


def _extractor(shared):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, job, size = [], [], 0
            for page in batch.column("html"):
                job.append(page.as_py() or "")
                size += len(job[-1])
                if size >= JOB:
                    texts += extract_texts(job, shared.value)
                    job, size = [], 0
            texts += extract_texts(job, shared.value) if job else []
            rest = batch.drop_columns(["html"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*rest.schema.names, "text", "n_chars"])

    return extract


def extract_main_text(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html, any more. Returns page_id, url, text, n_chars and the others."""
    packed = pack(pages, "page_id", "url", "html")
    shared = pages.sparkSession.sparkContext.broadcast(trained_model())
    others = [c for c in packed.columns if c != "html"]
    return unpack(packed.mapInArrow(_extractor(shared), fields(packed, *others, more="text string, n_chars long")), "page_id", "url", "text", "n_chars")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
