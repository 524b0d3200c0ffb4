"""HTML main-content extraction by a tree-structured graphical model.

Every element and every text of a page's DOM is a node with two states, content or not.  A node's own potential depends on
features (tag, parent's tag, class and id, lengths, link density, marks, depth); a potential on each parent-child edge depends on
the child's tag.  Sum-product messages go up from the leaves and down from the root, for all pages of a batch at once, level by
level, which gives the exact marginals of a tree.  Both kinds of potential are learned by gradient steps on the likelihood of
labelled pages.  A text belongs to the result where its marginal is at least ``THRESHOLD``.

Labelled pages come from pages whose source document is known: a text counts as content where it is a line of the document, or
a stretch of it of ``MATCH`` characters or more; an element where most of its text is content.  Training reads at most ``TRAIN_PAGES`` pages, in
order of a hash of their ids; extraction reads every page whole.

Defined results: null and empty pages give an empty text and 0 nodes; scripts, styles, templates, noscript elements and comments are never content; tags that aren't
closed are closed by their parents, end tags without a beginning are skipped, a ``<`` that begins no tag is text; without labelled pages all
marginals are 1/2 and all text stays; repeated rows get equal results; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.bytewords import mix, slices

WEIGHTS, EDGES, TRAIN_PAGES, STEPS, MATCH, THRESHOLD = 1 << 14, 64, 300, 80, 25, 0.5

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+>|</([a-z][^\s/>]*+)[^>]*+>|<([a-z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|<([a-z][^\s/>]*+)([^>]*+)>""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s small span strong sub sup time tt u var".split())
# A new one of these ends an open one of the same kind, up to the nearest container.
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
CONTAINERS = frozenset("html body div article section main aside nav header footer ul ol dl table tbody thead form td th".split())
TEXT = 0


@dataclass
class Nodes:
    """Nodes of a batch of pages; node 0 of each page is its root, and a parent always comes before its children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    named: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    link: list[int] = field(default_factory=list)
    page: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    broken: list[bool] = field(default_factory=list)

    def add(self, parent: int, depth: int, tag: int, named: int, page: int, text: str | None = None, link: bool = False, broken: bool = False) -> int:
        self.parent.append(parent)
        self.depth.append(depth)
        self.tag.append(tag)
        self.named.append(named)
        self.page.append(page)
        self.text.append(text)
        self.broken.append(broken)
        n = len(text) if text else 0
        self.chars.append(n)
        self.marks.append(text.count(".") + text.count(",") if n else 0)
        self.link.append(n if link else 0)
        return len(self.parent) - 1


_codes: dict[str, int] = {}


def code(name: str) -> int:
    got = _codes.get(name)
    if got is None:
        got = 1 + zlib.crc32(name.encode()) % 0x7FFFFFFF
        if len(_codes) < 10000:
            _codes[name] = got
    return got


def parse(nodes: Nodes, page: int, source: str) -> None:
    """Adds the nodes of one page."""
    root = nodes.add(-1, 0, code("#root"), 0, page)
    stack: list[tuple[str, int]] = [("#root", root)]
    open_at: dict[str, list[int]] = {}  # places of the open elements of each name in the stack
    containers = [0]
    at, broken = 0, True

    def put(raw: str) -> None:
        nonlocal broken
        text = " ".join(html.unescape(raw).split()) if raw else ""
        if text:
            nodes.add(stack[-1][1], len(stack), TEXT, 0, page, text, bool(open_at.get("a")), broken)
            broken = False

    def close(names: Iterable[str], over: bool) -> None:
        """Closes the nearest open element of these names; unless ``over``, none beyond the nearest container."""
        nonlocal broken
        place = max((open_at[n][-1] for n in names if open_at.get(n)), default=0)
        if not place or not over and place < containers[-1]:
            return
        while len(stack) > place:
            name, _ = stack.pop()
            open_at[name].pop()
            if containers[-1] == len(stack):
                containers.pop()
            broken |= name not in INLINE

    # After the last ">" no tag can begin; it isn't looked for, as each "<" there would search to the end.
    stop = source.rfind(">") + 1
    for m in TOKEN.finditer(source, 0, stop):
        if m.start() > at:
            put(source[at : m.start()])
        at = m.end()
        end, name, attrs = m[2], m[3] or m[5], m[4] or m[6]
        if end:
            end = end.lower()
            close((end,), end in CONTAINERS)
        elif name:
            name = name.lower()
            shut = CLOSES.get(name) or (CLOSES["p"] if name in BLOCKS else None)
            if shut:
                close(shut, False)
            broken |= name not in INLINE
            words = "".join(" ".join(x) for x in NAMED.findall(attrs)).lower().strip() if attrs and "=" in attrs else ""
            node = nodes.add(stack[-1][1], len(stack), code(name), code(words) if words else 0, page)
            if name not in VOID and not (attrs or "").endswith("/"):
                open_at.setdefault(name, []).append(len(stack))
                if name in CONTAINERS:
                    containers.append(len(stack))
                stack.append((name, node))
        elif at == stop and not _closed(m[0], m[1]):
            return
    rest = source[at:]
    put(rest[: rest.find("<!--")] if "<!--" in rest else rest)


def _closed(token: str, raw: str | None) -> bool:
    """Whether a comment, or an element of raw text, ends; else it hides all that follows."""
    if raw:
        return re.search(rf"</{raw}\s*>\Z", token, re.I) is not None
    return not token.startswith("<!--") or len(token) > 6 and token.endswith("-->")


@dataclass
class Tree:
    parent: np.ndarray
    levels: list[np.ndarray]
    feature: np.ndarray
    edge: np.ndarray


def _bin(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(x + 1).astype(np.int64), 14)


def tree(nodes: Nodes) -> Tree:
    n = len(nodes.parent)
    parent, depth, tag, named = (np.array(x, dtype=np.int64) for x in (nodes.parent, nodes.depth, nodes.tag, nodes.named))
    chars, marks, link = (np.array(x, dtype=np.float64) for x in (nodes.chars, nodes.marks, nodes.link))
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange((depth.max() if n else 0) + 2))
    levels = [order[a:z] for a, z in zip(cuts, cuts[1:])]
    near = named.copy()
    for level in levels[1:]:
        near[level] = np.where(near[level] == 0, near[parent[level]], near[level])
    own = chars.copy()
    for level in reversed(levels[1:]):
        for x in (chars, marks, link):
            if len(level) * 8 > n:
                x += np.bincount(parent[level], x[level], n)
            else:  # levels that are small beside the page cost their own size
                np.add.at(x, parent[level], x[level])
    up = np.maximum(parent, 0)
    density = (link / np.maximum(chars, 1) * 4).astype(np.int64)
    part = (chars / np.maximum(chars[up], 1) * 4).astype(np.int64)
    ahead = (np.array([len(x or "") > 0 for x in nodes.text]) * 1).astype(np.int64)
    rows = [np.zeros(n, np.int64), tag, tag * 7 + tag[up], tag[up], tag[up] * 11 + tag[up[up]], named, near, _bin(chars), _bin(marks), density, np.minimum(depth, 12), part * 8 + ahead, _bin(own) * 32 + density]
    feature = np.stack([(mix(r.astype(np.uint64) + np.uint64((k + 1) << 48)) % np.uint64(WEIGHTS)).astype(np.int64) for k, r in enumerate(rows)], axis=1)
    return Tree(parent, levels, feature, (mix(tag.astype(np.uint64)) % np.uint64(EDGES)).astype(np.int64))


@dataclass
class Model:
    weight: np.ndarray
    edge: np.ndarray


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def sum_product(t: Tree, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (nodes, 2), and for each node but roots the marginal (nodes, 2, 2) of its parent's and its own state."""
    n = len(t.parent)
    own = np.zeros((n, 2))
    own[:, 1] = model.weight[t.feature].sum(axis=1)
    potential = model.edge[t.edge]  # parent state, own state
    below = own.copy()
    up = np.zeros((n, 2))
    for level in reversed(t.levels[1:]):
        up[level] = _log_sum(potential[level] + below[level][:, None, :], 2)
        up[level] -= up[level].max(axis=1, keepdims=True)
        np.add.at(below, t.parent[level], up[level])
    belief = below.copy()
    pair = np.full((n, 2, 2), -np.inf)
    for level in t.levels[1:]:
        outside = belief[t.parent[level]] - up[level]
        pair[level] = outside[:, :, None] + potential[level] + below[level][:, None, :]
        got = _log_sum(pair[level], 1)
        belief[level] = got - got.max(axis=1, keepdims=True)
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    inner = t.parent >= 0
    pair[~inner] = 0
    pair[inner] = np.exp(pair[inner] - pair[inner].max(axis=(1, 2), keepdims=True))
    pair[inner] /= pair[inner].sum(axis=(1, 2), keepdims=True)
    pair[~inner] = 0
    return belief / belief.sum(axis=1, keepdims=True), pair


def gold_states(nodes: Nodes, documents: list[str]) -> np.ndarray:
    """The state of each node, from the source document of each page."""
    n = len(nodes.parent)
    lines = [{" ".join(x.split()) for x in d.split("\n")} for d in documents]
    flat = [" ".join(d.split()) for d in documents]
    head = code("head")
    chars, good = np.zeros(n), np.zeros(n)
    inside = [False] * n
    for i in range(n):
        p = nodes.parent[i]
        inside[i] = nodes.tag[i] == head or (p >= 0 and inside[p])
        text = nodes.text[i]
        if text:
            chars[i] = len(text)
            d = nodes.page[i]
            if not inside[i] and (text in lines[d] or len(text) >= MATCH and text in flat[d]):
                good[i] = len(text)
    for i in range(n - 1, 0, -1):
        if nodes.parent[i] >= 0:
            chars[nodes.parent[i]] += chars[i]
            good[nodes.parent[i]] += good[i]
    return (good * 2 > chars).astype(np.int64)


def train(pages: list[tuple[str, str]], steps: int = STEPS) -> Model:
    """pages: (html, text of the source document)."""
    model = Model(np.zeros(WEIGHTS), np.zeros((EDGES, 2, 2)))
    if not pages:
        return model
    nodes = Nodes()
    for i, (source, _) in enumerate(pages):
        parse(nodes, i, source)
    t, gold = tree(nodes), gold_states(nodes, [d for _, d in pages])
    n = len(gold)
    inner = np.flatnonzero(t.parent >= 0)
    want = np.zeros((EDGES, 2, 2))
    np.add.at(want, (t.edge[inner], gold[t.parent[inner]], gold[inner]), 1)
    params = [model.weight, model.edge]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        node, pair = sum_product(t, model)
        diff = gold - node[:, 1]
        have = np.zeros((EDGES, 2, 2))
        np.add.at(have, t.edge[inner], pair[inner])
        grads = [np.bincount(t.feature.ravel(), np.repeat(diff, t.feature.shape[1]), WEIGHTS), want - have]
        for p, g, a, b in zip(params, grads, m1, m2):
            g = g / n - 1e-5 * p
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p += 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def labelled_pages(pages: DataFrame, documents: DataFrame, most: int = TRAIN_PAGES) -> list[tuple[str, str]]:
    """(html, source text) of at most ``most`` pages; a page's url ends in its document's id."""
    source = F.regexp_extract("url", r"/(\d{1,18})(?:\.html?|/)?(?:[?#].*)?$", 1)
    known = pages.where("html is not null and page_id is not null").select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html").withColumn("source", source.try_cast("bigint")).where("source is not null")
    picked = known.select("page_id", "source", F.xxhash64("page_id").alias("h")).orderBy("h", "page_id", "source").limit(most)
    ids = [(r["page_id"], r["source"]) for r in picked.collect()]
    chosen = documents.sparkSession.createDataFrame(ids, "page bigint, source_id bigint").distinct()
    # At most `most` ids, so they may be sent to all tasks; an id trains by one page and one text, however often it occurs.
    met = known.join(F.broadcast(chosen), (known["page_id"] == chosen["page"]) & (known["source"] == chosen["source_id"]))
    found = met.groupBy("page_id", "source").agg(F.min("html").alias("html")).collect()
    given = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    wanted = F.broadcast(chosen.select(F.col("source_id").alias("doc_id")).distinct())
    by = {r["doc_id"]: r["text"] for r in given.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    return [(r["html"], by[r["source"]]) for r in sorted(found, key=lambda r: (r["page_id"], r["source"])) if r["source"] in by]


def extract(pages: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, text, n_nodes, n_texts, n_content) of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html", 2 << 20):
                nodes = Nodes()
                for i, source in enumerate(b.column("html").to_pylist()):
                    if source:
                        parse(nodes, i, source)
                n = b.num_rows
                parts: list[list[str]] = [[] for _ in range(n)]
                count = [np.zeros(n, dtype=np.int64) for _ in range(3)]
                if nodes.parent:
                    content = sum_product(tree(nodes), sent.value)[0][:, 1] >= threshold
                    page = np.array(nodes.page)
                    leaf = np.array([t is not None for t in nodes.text])
                    count = [np.bincount(page[m], minlength=n) for m in (page >= 0, leaf, leaf & content)]
                    for i in np.flatnonzero(leaf & content).tolist():
                        p = parts[nodes.page[i]]
                        p.append(("\n" if nodes.broken[i] else " ") + nodes.text[i] if p else nodes.text[i])
                yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(["".join(p) for p in parts], pa.string()), *(pa.array(c, pa.int64()) for c in count)], names=["page_id", "text", "n_nodes", "n_texts", "n_content"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, text string, n_nodes bigint, n_texts bigint, n_content bigint")
