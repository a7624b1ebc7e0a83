"""Main content of web pages by a tree-structured graphical model.

Every DOM node is content or not. A node's features give its own potential, and an edge's
potential depends on both labels and on the child's kind (block, inline, text). Messages pass
upward from the leaves and downward from the root (sum-product), which gives every node's
exact marginal. Weights are trained by gradient ascent on the likelihood of labelled pages,
whose gradient is the difference between labels and marginals.

Labelled pages: by default those that say so themselves, by an article or main element or
role=main; what stands inside is content. That markup is hidden from the features, so the
model applies to pages without it. At most MAX_TRAIN pages, the first by a hash of page_id,
are fitted; every page is scored.

The tree: void elements, implied ends of p, li, dt, dd, tr, td, th and option, raw text of
script and style, comments dropped, unclosed elements closed at the end of their parent.

Defined results: null, empty and text-less pages give empty text and no nodes; a page without
a tag is one text; pages of any length are read whole, in time proportional to it; null page_ids are extracted but don't train; rows that repeat a
page_id are extracted one by one, and one of them trains; without a labelled page all
text is content; ties at 0.5 are content; very deep trees are cut to MAX_DEPTH levels, whose
further levels become siblings; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

MAX_TRAIN, STEPS, MAX_DEPTH = 400, 80, 200
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
TAG_MARK = re.compile(r"[>\"']")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code em font i img kbd mark q s small span strong sub sup tt u var".split())
CLOSES = {
    **dict.fromkeys("p div ul ol dl table pre blockquote article section aside nav header footer main form h1 h2 h3 h4 h5 h6 hr address fieldset figure".split(), {"p"}),
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
STOPS = frozenset("ul ol dl table div section article body html td th select nav main aside header footer".split())
LABELS = re.compile(r"^(article|main)$|role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody\b", re.I)
TAGS = "nav footer aside header form div section p span a li ul ol table td tr h1 h2 h3 h4 pre blockquote b i em strong img button input label body html #text br figure dl dd dt code".split()
TAG_INDEX = {t: k for k, t in enumerate(TAGS)}
N_KINDS, CLASS_BUCKETS = 3, 64
N_FEATURES = 2 * (len(TAGS) + 1) + CLASS_BUCKETS + 12


class Scanner:
    """Tokens of a page, each byte read a bounded number of times: what isn't found once isn't
    sought again. A quote that follows no "=" or has no end is an ordinary character, a "<" without a
    ">" is text."""

    def __init__(self, page: str):
        self.page, self.lacks = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.lacks:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.lacks.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Place of the ">" that closes a tag, outside of quoted values; -1 without one."""
        if self.find(">", at) < 0:
            return -1
        first = self.page.find(">", at)
        while m := TAG_MARK.search(self.page, at):
            if m[0] == ">":
                return m.start()
            valued = self.page[at : m.start()].rstrip().endswith("=")
            close = self.find(m[0], m.end()) if valued else -1
            at = close + 1 if close >= 0 else m.end()
        return first

    def __iter__(self) -> Iterator[tuple[str, str, str, int]]:
        """(kind, name, rest, end): text, open or close tags; send() moves the place."""
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            start = self.find("<", at)
            if start != at:
                stop = start if start >= 0 else end
                yield "text", "", page[at:stop], stop
                at = stop
                continue
            if page.startswith("<!--", at):
                close = self.find("-->", at)
                at = close + 3 if close >= 0 else end
                continue
            m = NAME.match(page, at + 1)
            close = self.tag_end(m.end()) if m else self.find(">", at) if page.startswith(("<!", "<?"), at) else -1
            if close < 0:
                yield "text", "", "<", at + 1
                at += 1
                continue
            if m:
                moved = yield "close" if m[1] else "open", m[2], page[m.end() : close], close + 1
                at = moved if moved else close + 1
            else:
                at = close + 1


class Tree:
    """Nodes in document order: tag (label markup shows as div), name as written, parent, depth,
    text, attributes; gold labels if any."""

    __slots__ = ("tag", "name", "parent", "depth", "text", "attrs", "gold", "labelled")

    def __init__(self, page: str):
        self.tag, self.name, self.parent, self.depth = ["#root"], ["#root"], [-1], [0]
        self.text, self.attrs, self.gold = [""], [""], [False]
        self.labelled = False
        open_nodes = [0]
        end = len(page)
        scanner = Scanner(page)
        tokens = iter(scanner)
        moved = None
        while True:
            try:
                kind, name, rest, at = tokens.send(moved)
            except StopIteration:
                break
            moved = None
            if kind == "text":
                if rest.strip():
                    self._add("#text", open_nodes, entities.unescape(rest))
                continue
            name = name.lower()
            if kind == "close":
                for k in range(len(open_nodes) - 1, 0, -1):
                    if self.name[open_nodes[k]] == name:
                        del open_nodes[k:]
                        break
                continue
            closes = CLOSES.get(name)
            if closes:
                for k in range(len(open_nodes) - 1, 0, -1):
                    tag = self.name[open_nodes[k]]
                    if tag in closes:
                        del open_nodes[k:]
                        if name not in ("td", "th", "tr", "li", "dt", "dd"):
                            break
                    elif tag in STOPS:
                        break
            node = self._add(name, open_nodes, "", rest)
            if name in RAW:
                stop = re.compile(f"</{name}\\s*>", re.I).search(page, at)
                if name == "textarea" and page[at : stop.start() if stop else end].strip():
                    self._add("#text", [*open_nodes, node], entities.unescape(page[at : stop.start() if stop else end]))
                moved = stop.end() if stop else end
            elif name not in VOID and not rest.endswith("/") and len(open_nodes) < MAX_DEPTH:
                open_nodes.append(node)

    def _add(self, tag: str, open_nodes: list[int], text: str, attrs: str = "") -> int:
        parent = open_nodes[-1]
        gold = self.gold[parent]
        self.name.append(tag)
        if tag != "#text" and (tag in ("article", "main") or attrs and LABELS.search(attrs)):
            gold = self.labelled = True
            tag, attrs = "div", ""
        for column, value in ((self.tag, tag), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.text, text), (self.attrs, attrs), (self.gold, gold)):
            column.append(value)
        return len(self.tag) - 1


CLASSES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Forest:
    """Nodes of many pages with features, ready for message passing."""

    def __init__(self, trees: list[Tree]):
        size = np.array([len(t.tag) for t in trees], np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)])
        n = int(self.first[-1])
        shift = np.repeat(self.first[:-1], size)
        parent = np.array([p for t in trees for p in t.parent], np.int64)
        self.root = parent < 0
        self.parent = np.where(self.root, 0, parent + shift)
        depth = np.array([d for t in trees for d in t.depth], np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        tags = [x for t in trees for x in t.tag]
        tag = np.array([TAG_INDEX.get(x, len(TAGS)) for x in tags], np.int64)
        is_text = tag == TAG_INDEX["#text"]
        self.kind = np.where(is_text, 2, np.array([x in INLINE for x in tags], np.int64))
        texts = [x for t in trees for x in t.text]
        chars = np.array(list(map(len, texts)), float)
        words = np.array([x.count(" ") + 1 if x else 0 for x in texts], float)
        stops = np.array([x.count(".") + x.count("!") + x.count("?") if x else 0 for x in texts], float)
        in_link = np.array([x == "a" for x in tags], float)
        below = {"chars": chars.copy(), "words": words.copy(), "stops": stops.copy(), "links": np.zeros(n), "nodes": np.ones(n)}
        linked = in_link.copy()
        for level in self.levels[1:]:
            linked[level] = np.maximum(linked[level], linked[self.parent[level]])
        below["links"] = chars * linked
        for level in reversed(self.levels[1:]):
            for x in below.values():
                x += np.bincount(self.parent[level], x[level], n)
        page = np.repeat(np.arange(len(trees)), size)
        total = np.maximum(below["chars"][self.first[:-1]], 1)[page] if n else chars
        f = np.zeros((n, N_FEATURES))
        f[np.arange(n), tag] = 1
        f[np.arange(n), len(TAGS) + 1 + tag[self.parent]] = 1
        at = 2 * (len(TAGS) + 1)
        for k, attrs in enumerate(a for t in trees for a in t.attrs):
            if attrs:
                for m in CLASSES.finditer(attrs):
                    for word in re.split(r"[\s_\d-]+", (m[1] or m[2] or m[3] or "").lower()):
                        if word:
                            f[k, at + xxhash.xxh64_intdigest(word) % CLASS_BUCKETS] = 1
        at += CLASS_BUCKETS
        c = below["chars"]
        f[:, at] = np.log1p(c) / 8
        f[:, at + 1] = below["links"] / np.maximum(c, 1)
        f[:, at + 2] = c / total
        f[:, at + 3] = np.minimum(3, c / below["nodes"] / 50)
        f[:, at + 4] = np.minimum(3, below["stops"] / np.maximum(below["words"], 1) * 10)
        f[:, at + 5] = depth / 10
        f[:, at + 6] = (np.arange(n) - shift) / np.maximum(np.repeat(size, size), 1)
        f[:, at + 7] = linked
        f[:, at + 8] = np.log1p(below["words"]) / 6
        f[:, at + 9] = c == 0
        f[:, at + 10] = np.minimum(3, c[self.parent] / np.maximum(total, 1))
        f[:, at + 11] = 1
        self.features = f
        self.gold = np.array([g for t in trees for g in t.gold], float)

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node; and for each node but roots the joint P(parent, node).
        edges: log potentials by kind, parent label and child label."""
        n = len(self.parent)
        unary = np.stack([np.zeros(n), self.features @ weights], 1)
        psi = edges[self.kind]
        up = unary.copy()  # a node's potential with the messages of its children
        sent = np.zeros((n, 2))
        for level in reversed(self.levels[1:]):
            joint = psi[level] + up[level][:, None, :]
            sent[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            for label in (0, 1):
                up[:, label] += np.bincount(self.parent[level], sent[level, label], n)
        down = np.zeros((n, 2))
        pair = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            rest = up[p] + down[p] - sent[level]  # the parent without this child
            joint = psi[level] + rest[:, :, None]
            down[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            down[level] -= down[level].max(1, keepdims=True)
            both = joint + up[level][:, None, :]
            both -= both.max((1, 2), keepdims=True)
            both = np.exp(both)
            pair[level] = both / both.sum((1, 2), keepdims=True)
        belief = up + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), pair


def fit(trees: list[Tree], steps: int = STEPS, rate: float = 0.3, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and edge potentials by gradient ascent with momentum (Adam); None without pages."""
    if not trees:
        return None
    forest = Forest(trees)
    y = forest.gold
    inner = ~forest.root
    theta = np.zeros(N_FEATURES + N_KINDS * 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.zeros((N_KINDS, 2, 2))
    np.add.at(gold, (forest.kind[inner], y[forest.parent[inner]].astype(int), y[inner].astype(int)), 1)
    for step in range(1, steps + 1):
        w, e = theta[:N_FEATURES], theta[N_FEATURES:].reshape(N_KINDS, 2, 2)
        p, pair = forest.marginals(w, e)
        of_edges = gold.copy()
        for kind in range(N_KINDS):
            of_edges[kind] -= pair[inner & (forest.kind == kind)].sum(0)
        gradient = np.concatenate([forest.features.T @ (y - p), of_edges.reshape(-1)]) / len(y) - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) / np.sqrt(step)
    return theta[:N_FEATURES], theta[N_FEATURES:].reshape(N_KINDS, 2, 2)


def content(trees: list[Tree], model: tuple[np.ndarray, np.ndarray] | None) -> Iterator[tuple[str, int, int, float]]:
    """(text, nodes with text, of them content, mean marginal of these) of each page."""
    forest = Forest(trees)
    p = forest.marginals(*model)[0] if model else np.ones(len(forest.parent))
    for k, tree in enumerate(trees):
        own = p[forest.first[k] : forest.first[k + 1]]
        lines, line, n, kept, total, previous = [], [], 0, 0, 0.0, -1
        for node, tag in enumerate(tree.tag):
            if tag != "#text":
                if tag not in INLINE or tag == "br":
                    if line:
                        lines.append(" ".join("".join(line).split()))
                        line = []
                continue
            n += 1
            if own[node] < 0.5:
                continue
            kept, total = kept + 1, total + own[node]
            # A text that isn't in the block of the text before starts a line.
            block = node
            while block > 0 and (tree.tag[block] == "#text" or tree.tag[block] in INLINE):
                block = tree.parent[block]
            if block != previous and line:
                lines.append(" ".join("".join(line).split()))
                line = []
            previous = block
            line.append(tree.text[node])
        if line:
            lines.append(" ".join("".join(line).split()))
        yield "\n".join(x for x in lines if x), n, kept, total / kept if kept else 0.0


def train(pages: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray] | None:
    """The model from the labelled pages among these."""
    marked = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["html"].cast("string").alias("html")).where(
        "page_id is not null and html rlike '(?i)<(article|main)[\\\\s>]|role\\\\s*=\\\\s*[\"\\']?main|articleBody'"
    )
    # The draw sorts ids alone; only the pages drawn travel, one for an id that repeats.
    drawn = marked.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_train)
    chosen = marked.join(F.broadcast(drawn), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    trees = [Tree(row["html"]) for row in chosen.orderBy(F.xxhash64("page_id"), "page_id").collect()]  # max_train pages at most
    return fit([t for t in trees if t.labelled])


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(page_id, text, n_texts, n_content, confidence) for every row."""
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                trees = [Tree(x or "") for x in part.column(1).to_pylist()]
                text, n, kept, sure = zip(*content(trees, shipped.value))
                yield pa.record_batch(
                    [part.column(0), pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32()), pa.array(sure, pa.float64())],
                    ["page_id", "text", "n_texts", "n_content", "confidence"],
                )

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, text string, n_texts int, n_content int, confidence double")
