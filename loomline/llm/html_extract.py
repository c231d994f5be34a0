"""Main text of web pages: gradient-boosted trees over DOM nodes with hierarchical decoding.

The trees are fitted with Spark ML on generated pages whose truth is known (see
``html_samples``), at most ``TRAIN_PAGES`` of them. They give every element and
every text block of a page a chance to hold main text. Decoding then takes the
likeliest labelling of the whole tree in which a kept node has kept ancestors,
so an ancestor and a descendant never contradict each other.
"""

from __future__ import annotations

import hashlib
import inspect
import io
import math
import re
import sys
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession

from loomline.llm import html_samples
from loomline.llm.html_samples import sample_page
from loomline.session import shared_dir

#: Generated pages on which the trees are fitted: the bound of the training sample.
TRAIN_PAGES = 600
TREES, DEPTH, SEED = 20, 5, 7

#: Elements without content; elements whose text is no text of the page (scripts, styles, form controls and what only stands in for a plug-in frame); the last of these that end a block; elements inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template title iframe select option textarea datalist".split())
HIDDEN_BLOCKS = frozenset("head title iframe".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label map mark math meter nobr noscript object output picture progress q rp rt ruby s samp slot small span strike strong sub sup svg time tt u var video wbr".split()
)
#: Elements whose inner elements are all parts of a line.
FOREIGN = frozenset(["math", "svg"])
#: A start tag of the key ends an open element of the value's first set, unless one of the second lies between.
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_SCOPE = frozenset("html body table td th caption button object".split())
CLOSES = {
    **{t: (frozenset(["p"]), _SCOPE) for t in _BLOCKS},
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"]) | _SCOPE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _SCOPE),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _SCOPE),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["thead", "tbody", "tr"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["body"])),
}
#: Kinds of elements and of attribute words.
TAG_KINDS = {
    "article": "article main",
    "box": "div section body center td",
    "nav": "nav menu",
    "header": "header hgroup",
    "footer": "footer",
    "aside": "aside dialog",
    "paragraph": "p blockquote pre address",
    "heading": "h1 h2 h3 h4 h5 h6",
    "list": "ul ol dl",
    "entry": "li dt dd",
    "form": "form fieldset button search",
    "table": "table tbody thead tr th caption",
    "figure": "figure figcaption details summary",
}
WORD_KINDS = {
    "ad": "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion promoted outbrain taboola",
    "comment": "comment comments commentlist disqus reply replies respond discussion reactions",
    "notice": "cookie cookies consent gdpr notice alert banner popup modal overlay warning disclaimer paywall",
    "share": "share sharing social newsletter subscribe subscription signup login follow tools",
    "related": "related recommended recommendations more popular trending tags tag latest",
    "side": "sidebar side widget widgets rail aside secondary",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs topbar",
    "foot": "footer foot copyright bottom legal",
    "head": "header masthead head logo branding top",
    "main": "article content main post body entry story text prose page blog hentry",
}
_KIND_OF_TAG = {t: k for k, v in enumerate(TAG_KINDS.values()) for t in v.split()}
_KINDS_OF_WORD: dict[str, list[int]] = {}
for _k, _v in enumerate(WORD_KINDS.values()):
    for _w in _v.split():
        _KINDS_OF_WORD.setdefault(_w, []).append(_k)
_N_TAGS, _N_WORDS = len(TAG_KINDS), len(WORD_KINDS)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCT = re.compile(r"[.!?;:,]")
#: Marked sections that the standard parser knows; it raises on others.
_MARKED = re.compile(r"<!\[(?:temp|cdata|ignore|include|rcdata|if|else|endif)(?![-_.a-z0-9])", re.I)
#: Numeric references with more digits than int() takes.
_LONG_REFERENCE = re.compile(r"&#([0-9]{4300,})")


class Node:
    """An element, or a text block where ``text`` is set."""

    __slots__ = ("attrs", "children", "index", "links", "parent", "place", "tag", "text", "total")

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str] | None = None, text: str | None = None):
        self.tag, self.parent, self.attrs, self.text = tag, parent, attrs or {}, text
        self.children: list[Node] = []
        self.index, self.place, self.total, self.links = 0, 0, 0, 0


class _Builder(HTMLParser):
    """Builds blocks from tags as they come, closing what HTML closes by itself.

    ``at`` holds the places of each open tag, so that finding what a tag closes
    takes the same time at any depth.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.open: list[tuple[str, Node]] = [("html", self.root)]
        self.at: dict[str, list[int]] = {"html": [0]}
        self.blocks = [0]  # places of open elements that are not inside a line
        self.hidden = self.foreign = 0
        self.run: list[str] = []
        self.linked = 0

    def inline(self, tag: str) -> bool:
        """Whether the element is part of a line: so are elements of formulas and drawings, and custom ones."""
        return tag in INLINE or self.foreign > 0 or "-" in tag or (tag in HIDDEN and tag not in HIDDEN_BLOCKS)

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                owner = self.open[-1][1]
                leaf = Node("#text", owner, text=text)
                leaf.links = min(self.linked, len(text))
                owner.children.append(leaf)
            self.run, self.linked = [], 0

    def _push(self, tag: str, node: Node, block: bool) -> None:
        self.at.setdefault(tag, []).append(len(self.open))
        if block:
            self.blocks.append(len(self.open))
        self.hidden += tag in HIDDEN
        self.foreign += tag in FOREIGN
        self.open.append((tag, node))

    def _pop(self, to: int) -> None:
        if self.blocks[-1] >= to:
            self.flush()
        while self.blocks[-1] >= to:
            self.blocks.pop()
        for tag, _ in self.open[to:]:
            self.at[tag].pop()
            self.hidden -= tag in HIDDEN
            self.foreign -= tag in FOREIGN
        del self.open[to:]

    def _last(self, tags: frozenset[str]) -> int:
        """Place of the innermost open element of these tags, 0 without one."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def parse_html_declaration(self, i: int) -> int:
        """As HTML has it, an unknown marked section is a comment up to the next ``>``."""
        if self.rawdata.startswith("<![", i) and not _MARKED.match(self.rawdata, i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.foreign and (tag in _BLOCKS or tag == "body"):
            self._pop(min(self.at[t][0] for t in FOREIGN if self.at.get(t)))  # a block ends a formula or drawing that was left open
        if tag in CLOSES and not self.foreign:
            ends, stops = CLOSES[tag]
            above = self._last(stops)
            inside = [places[k] for t in ends if (places := self.at.get(t)) and (k := bisect_right(places, above)) < len(places)]
            if inside:
                self._pop(min(inside))
        if tag in VOID:
            if tag == "br":
                self.run.append(" ")
            elif not self.inline(tag):
                self.flush()
            return
        if tag in ("html", "body") and self.at.get(tag):
            return
        inline, owner = self.inline(tag), self.open[-1][1]
        if not inline:
            self.flush()
        if inline or tag in HIDDEN:
            self._push(tag, owner, not inline)
            return
        node = Node(tag, owner, {k: v or "" for k, v in attrs})
        owner.children.append(node)
        self._push(tag, node, True)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.foreign and tag not in VOID and tag not in FOREIGN and self.open[-1][0] == tag:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("body", "html") or not self.at.get(tag):
            return
        at = self.at[tag][-1]
        if at and not (self.inline(tag) and self.blocks[-1] > at):
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if not self.hidden and data:
            self.run.append(data)
            if self.at.get("a"):
                self.linked += len(data)


def parse(html: str) -> Node:
    """The tree of elements and text blocks of a page; broken markup costs no text behind it."""
    builder = _Builder()
    # more than seven digits are no character, however many they are
    builder.feed(_LONG_REFERENCE.sub(lambda m: "&#" + (m[1].lstrip("0") or "0")[:8], html))
    builder.close()
    builder.flush()
    return builder.root


def _nodes(root: Node) -> list[Node]:
    """All nodes in page order; sets index, place among siblings, total (characters) and links (linked characters)."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.index = len(out)
        out.append(node)
        for place, child in enumerate(node.children):
            child.place = place
        stack.extend(reversed(node.children))
    for node in reversed(out):
        if node.text is not None:
            node.total = len(node.text)
        if node.parent is not None:
            node.parent.total += node.total
            node.parent.links += node.links
    return out


N_FEATURES = 2 * (_N_TAGS + _N_WORDS) + 15


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: kinds of its tag and attribute words, kinds above it, and numbers about subtree, depth and siblings."""
    n = len(nodes)
    own = np.zeros((n, _N_TAGS + _N_WORDS), np.float32)
    above = np.zeros_like(own)
    rest = np.zeros((n, 15), np.float32)
    depth, tags, paragraphs, leaves = [0] * n, [1] * n, [0] * n, [0] * n
    for node in reversed(nodes):
        i = node.index
        leaves[i] += node.text is not None
        paragraphs[i] += node.tag == "p"
        if node.parent is not None:
            p = node.parent.index
            tags[p] += tags[i]
            paragraphs[p] += paragraphs[i]
            leaves[p] += leaves[i]
    page, before = max(1, nodes[0].total), 0
    for node in nodes:
        i, parent = node.index, node.parent
        kind = _KIND_OF_TAG.get(node.tag)
        if kind is not None:
            own[i, kind] = 1
        for key in ("class", "id", "role"):
            if value := node.attrs.get(key):
                for word in _WORD.findall(value):
                    for k in _KINDS_OF_WORD.get(word.lower(), ()):
                        own[i, _N_TAGS + k] = 1
        siblings = parent.children if parent else [node]
        if parent:
            depth[i] = depth[parent.index] + 1
            above[i] = np.maximum(above[parent.index], own[parent.index])
        total, text = node.total, node.text
        rest[i] = (
            depth[i],
            text is not None,
            math.log1p(total),
            node.links / max(1, total),
            total / tags[i],
            math.log1p(tags[i]),
            math.log1p(paragraphs[i]),
            total / max(1, leaves[i]),
            total / page,
            total / max(1, parent.total) if parent else 1,
            node.place / max(1, len(siblings)),
            math.log1p(len(siblings)),
            before / page,
            len(_PUNCT.findall(text)) / max(1, total) if text is not None else 0,
            len(node.children),
        )
        if text is not None:
            before += total
    return np.hstack([own, above, rest])


class Trees(NamedTuple):
    """The fitted trees as arrays: tree by node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray


def log_odds(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Twice the boosted margin: the log-odds of holding main text."""
    out = np.zeros(len(x))
    for t, weight in enumerate(trees.weight):
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = trees.feature[t, at]
            go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= trees.threshold[t, at], trees.left[t, at], trees.right[t, at])
            at = np.where(f < 0, at, go)
        out += weight * trees.value[t, at]
    return 2 * out


def _arrays(model) -> Trees:
    """The trees of a fitted Spark ML model."""
    rows, size = [], 2 ** (DEPTH + 1)
    for tree in model.trees:
        f, th, le, ri, va = np.full(size, -1), np.zeros(size), np.zeros(size, int), np.zeros(size, int), np.zeros(size)
        queue, used = [(tree._call_java("rootNode"), 0)], 1
        while queue:
            node, k = queue.pop()
            va[k] = node.prediction()
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                f[k], th[k], le[k], ri[k] = split.featureIndex(), split.threshold(), used, used + 1
                queue += [(node.leftChild(), used), (node.rightChild(), used + 1)]
                used += 2
        rows.append((f, th, le, ri, va))
    return Trees(*(np.stack(x) for x in zip(*rows, strict=True)), np.array(model.treeWeights))


def labelled(html: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a generated page; ``data-y`` marks what is main text (1) or not (0)."""
    nodes = _nodes(parse(html))
    y = np.zeros(len(nodes))
    mark: list[str] = ["0"] * len(nodes)
    for node in nodes:
        mark[node.index] = node.attrs.get("data-y", mark[node.parent.index] if node.parent else "0")
        y[node.index] = node.text is not None and mark[node.index] == "1"
    for node in reversed(nodes):
        if node.parent is not None and y[node.index]:
            y[node.parent.index] = 1
    return features(nodes), y


_FITTED: dict[tuple, Trees] = {}


def fit(spark: SparkSession, train_pages: int = TRAIN_PAGES, seed: int = SEED) -> Trees:
    """Boosted trees fitted with Spark ML on ``train_pages`` generated pages; once per process for the same sample."""
    if (train_pages, seed) not in _FITTED:

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    x, y = labelled(sample_page(seed * 1_000_003 + i))
                    yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(list(x.astype(float)))], ["label", "x"])

        rows = spark.range(0, train_pages, 1, 4).mapInArrow(sample, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, maxBins=32, checkpointInterval=-1).fit(rows)
        _FITTED[train_pages, seed] = _arrays(model)
    return _FITTED[train_pages, seed]


def _version(train_pages: int, seed: int) -> str:
    """Tells models apart: the sample, the trees' parameters, and the code that makes pages and features."""
    sources = [inspect.getsource(m) for m in (sys.modules[__name__], html_samples)]
    return hashlib.sha256(repr((train_pages, seed, TREES, DEPTH, *sources)).encode()).hexdigest()[:16]


def stored(spark: SparkSession, train_pages: int = TRAIN_PAGES, seed: int = SEED) -> Trees:
    """The fitted trees from the shared folder; the first driver that asks for a version fits and writes it."""
    path = f"{shared_dir(spark)}/html-trees-{_version(train_pages, seed)}.npz"
    files, name = pafs.FileSystem.from_uri(path)
    if files.get_file_info(name).type == pafs.FileType.File:
        with files.open_input_stream(name) as source, np.load(io.BytesIO(source.read())) as flat:
            return Trees(*(flat[k] for k in Trees._fields))
    trees, out = fit(spark, train_pages, seed), io.BytesIO()
    np.savez(out, **trees._asdict())
    files.create_dir(name.rsplit("/", 1)[0], recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as sink:
        sink.write(out.getvalue())
    files.move(draft, name)  # readers see whole files alone
    return trees


def decode(nodes: list[Node], odds: np.ndarray) -> str:
    """Text blocks of the likeliest labelling in which every kept node has kept ancestors, joined by line ends."""
    p1 = -np.logaddexp(0, -odds)
    p0 = -np.logaddexp(0, odds)
    none, some = p0.tolist(), p1.tolist()  # best of a subtree: nothing kept; the node kept
    for node in reversed(nodes):
        if node.parent is not None:
            i, p = node.index, node.parent.index
            some[p] += max(none[i], some[i])
            none[p] += none[i]
    kept, out = [False] * len(nodes), []
    for node in nodes:
        i = node.index
        kept[i] = some[i] > none[i] and (node.parent is None or kept[node.parent.index])
        if kept[i] and node.text is not None:
            out.append(node.text)
    return "\n".join(out)


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    The whole html is read. Character references are decoded, white space inside
    a block becomes one space, blocks are trimmed and joined in page order by a
    line end. Scripts, styles, form controls and markup comments never count;
    formulas, drawings, custom elements and what stands in for a script or an
    object are parts of their line. A page without main text, and a null or empty
    html, give an empty text. Work grows in proportion to a page's length at any
    depth. Repeated rows give repeated results, an empty table no rows; other
    columns are not read; nothing is shuffled.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(trees or stored(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                trees_of = [_nodes(parse(h.as_py() or "")) for h in part.column(2)]
                odds = log_odds(shared.value, np.concatenate([features(n) for n in trees_of]))
                texts, first = [], 0
                for nodes in trees_of:
                    texts.append(decode(nodes, odds[first : first + len(nodes)]))
                    first += len(nodes)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
