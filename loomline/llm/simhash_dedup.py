"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits are cut into SEGMENTS segments in a ring. If two
fingerprints differ in at most DISTANCE bits, then from some segment on every
chain of l consecutive segments, in the ring, differs in at most
DISTANCE * l / SEGMENTS bits. The first chains have no bit to spare: they are
the key, so fingerprints meet by an equi-join once for each segment that a chain
can start at. The longer chains prune the pairs that meet, before the full check.

Equal fingerprints are one class, and only classes meet. A key of more than
MOST_IN_KEY classes (near copies of one text in large numbers) is not compared
pair by pair: two fingerprints differ in at most two bits exactly if both are
within one bit of a third, so each goes by itself and its 64 neighbours of one
bit. At most 65 fingerprints go by one of those, whatever the texts, and each
links to the smallest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.arrow_text import LOWER, slices
from loomline.llm.components import components
from loomline.session import written

WORDS, SEED = 3, 42
DISTANCE = 2
SEGMENTS = 16
WIDTH = 64 // SEGMENTS
#: Segments of the longest chain without a bit to spare: the key.
EXACT = (SEGMENTS - 1) // DISTANCE
#: Classes that are compared pair by pair under one key.
MOST_IN_KEY = 256
#: Shingles that a 16-bit lane can count.
LANE = 65535


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each row of hashes ``bounds[i]`` to ``bounds[i + 1]``: the bits set in over half of them; zero for none."""
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    pieces = -(-sizes[some] // LANE)
    owner = np.repeat(np.arange(len(some)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = bounds[:-1][some][owner] + nth * LANE
    half = sizes[some]
    for low in range(16):  # bits low, low + 16, low + 32 and low + 48 are counted side by side
        counts = np.add.reduceat((hashes[: bounds[-1]] >> np.uint64(low)) & np.uint64(0x0001000100010001), starts)
        for lane in range(4):
            own = ((counts >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64)
            total = np.bincount(owner, own, len(some)).astype(np.int64) if len(owner) > len(some) else own
            out[some] |= (2 * total > half).astype(np.uint64) << np.uint64(low + 16 * lane)
    return out


def _fingerprints(rows: list[bytes], words: int = WORDS) -> np.ndarray:
    """Fingerprints of lower-cased texts."""
    split = [r.split() for r in rows]  # bytes.split() parts at space and U+0009 to U+000D
    sizes = np.array([len(w) for w in split], np.int64)
    flat = [w for own in split for w in own]
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    text = memoryview(b" ".join(flat))
    firsts = np.cumsum(sizes) - sizes
    grams = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    bounds = np.r_[0, np.cumsum(grams)]
    first = np.repeat(firsts, grams) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], grams)
    last = first + np.repeat(np.minimum(sizes, words), grams) - 1
    own = xxhash.xxh64_intdigest
    hashes = np.fromiter((own(text[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(first))
    return majority(hashes, bounds)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every document.

    Words are lower-cased (A-Z) runs of other characters than white space. Every
    3-word shingle counts as often as it occurs; a text with fewer words is one
    shingle, and one without words, or null, has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                low = LOWER[data]
                found = _fingerprints([low[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def chains_fit(differences: np.ndarray, start: np.ndarray, distance: int = DISTANCE, segments: int = SEGMENTS) -> np.ndarray:
    """Places of the bit differences whose chains from segment ``start`` on all keep within their budgets; the longest chain is the whole ring."""
    width = 64 // segments
    turn = (start * width).astype(np.uint64)
    ring = (differences << turn) | ((differences >> np.uint64(1)) >> (np.uint64(63) - turn))
    left = np.arange(len(ring))
    for length in range(1, segments + 1):
        budget = distance * length // segments
        if length < segments and budget == distance * (length + 1) // segments:
            continue  # the next chain has no more to spare and holds this one
        left = left[np.bitwise_count(ring[left] >> np.uint64(64 - width * length)) <= budget]
    return left


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place of the component of each of ``n`` places that the links (a, b) join."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b, root[a], root[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) links from (start, fps) rows; each fingerprint links to the smallest of those its key connects it with."""
    for batch in batches:
        lists = batch.column(1)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        values = np.asarray(lists.values)[offsets[0] : offsets[-1]]
        ends = np.repeat(offsets[1:] - offsets[0], np.diff(offsets))
        start = np.repeat(np.asarray(batch.column(0)), np.diff(offsets))
        bits = values.view(np.uint64)
        left, right = [], []
        at = np.arange(len(values))
        gap = 1
        while len(at := at[at + gap < ends[at]]):
            fit = at[chains_fit(bits[at] ^ bits[at + gap], start[at])]
            left.append(fit)
            right.append(fit + gap)
            gap += 1
        a, b = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (left, right))
        root = _roots(len(values), a, b)
        linked = np.flatnonzero(root != np.arange(len(values)))
        yield pa.RecordBatch.from_arrays([pa.array(values[root[linked]]), pa.array(values[linked])], ["u", "v"])


def _keys(classes: DataFrame) -> DataFrame:
    """fp, start and key: the bits of the EXACT segments from ``start`` on, once for each start."""
    start = F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("start")
    rows = classes.select("fp", start).withColumn("turn", F.col("start") * WIDTH)
    ring = F.expr("shiftleft(fp, turn) | shiftrightunsigned(shiftrightunsigned(fp, 1), 63 - turn)")
    return rows.select("fp", "start", F.shiftrightunsigned(ring, 64 - WIDTH * EXACT).alias("key"))


def links(classes: DataFrame, most: int = MOST_IN_KEY) -> DataFrame:
    """(u, v) pairs of fingerprints that connect all that differ in at most DISTANCE bits; ``classes`` has distinct ``fp``.

    The pairs connect the same fingerprints as all links do; they are not all links.
    """
    keys = _keys(classes)
    shared = written(keys.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-keys")
    usual = keys.join(shared.where(F.col("n") <= most).select("start", "key"), ["start", "key"], "left_semi")
    lists = usual.groupBy("start", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # at most ``most`` each
    found = lists.select("start", "fps").mapInArrow(_search, "u long, v long")
    hot = keys.join(shared.where(F.col("n") > most).select("start", "key"), ["start", "key"], "left_semi").select("fp").distinct()
    near = F.expr("concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))")
    by_middle = hot.select("fp", F.explode(near).alias("middle")).groupBy("middle").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # at most 65 each
    rest = by_middle.where("size(fps) > 1").select(F.col("fps")[0].alias("u"), F.explode(F.slice("fps", F.lit(2), F.size("fps") - 1)).alias("v"))
    return written(found.union(rest).distinct(), "simhash-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), component_id and n_class of every document.

    component_id is the smallest doc_id reachable by links between fingerprints
    that differ in at most two bits, the document's own included; texts without
    words have fingerprint zero and link like any other. n_class is the number
    of documents with this fingerprint. Null ids count as larger than all others.
    Repeated rows are copies of each other. Other columns are not read.
    """
    rows = written(fingerprints(docs), "simhash-rows")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_class")), "simhash-classes")
    roots = components(links(classes.select("fp"))).select(F.col("id").alias("fp"), "root")
    of = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rows.join(of.join(least, "root").select("fp", "component_id", "n_class"), "fp").select("doc_id", "fp", "component_id", "n_class")


def report(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
