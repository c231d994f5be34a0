"""Benchmark decontamination: training passages query a BM25 index of test items by block-max WAND.

The index holds the items; every passage of every document is a query. An
item's impacts are divided by its score for its own text, so one threshold fits
all items. Items above it are then verified by their question's and their
answer's word n-grams in the passage.

Item count, mean length and document frequencies are taken over all items in
Spark. Tasks build the index in parts of bounded size from these and write them
to the shared folder; a task that searches documents uses one part at a time, and
keeps those that fit HELD_BYTES.
Scores and verdicts do not depend on how items are dealt to parts.
"""

from __future__ import annotations

import io
import re
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.arrow_text import LOWER, prefix_sums, slices, span_hash, words
from loomline.session import new_path, written

K1, B = 1.2, 0.75
#: Share of an item's score for itself that a passage must reach.
THRESHOLD = 0.5
#: Shares of the question's and the answer's n-grams that must occur in the passage.
QUESTION, ANSWER = 0.6, 0.5
GRAM = 5
#: Words of the n-grams of short questions and of short answers.
LEAST_GRAM = 3, 1
#: Postings of a block, which has a maximum of its own.
BLOCK = 8
#: Words that occur in more than this share of the items are looked up only where the others leave a chance.
COMMON = 0.05
#: Bytes of item text in one part of the index, on average; each part sees every passage.
INDEX_BYTES = 16 << 20
#: Bytes of document text for which a task loads the parts of an index once.
BUFFER_BYTES = 16 << 20
#: Bytes of an index that a worker process keeps; a larger part is kept alone.
HELD_BYTES = 192 << 20

#: Letters, digits and non-ASCII bytes stay (A-Z lower-cased); other bytes separate words.
NORMAL = LOWER.copy()
NORMAL[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


class Stats(NamedTuple):
    """Of all items with words, whatever part they are in."""

    items: int
    mean: float  # words of an item
    most: int  # words of the longest item


class Grams(NamedTuple):
    """The n-grams of one side of every item: its n, and runs of distinct hashes."""

    size: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray


class Index(NamedTuple):
    items: np.ndarray  # ids as text
    question: Grams
    answer: Grams
    vocabulary: np.ndarray  # sorted word hashes
    starts: np.ndarray  # of each word's postings
    owner: np.ndarray  # ascending item places
    impact: np.ndarray
    common: np.ndarray  # per word: is it in many items, and not needed to find one
    item_rest: np.ndarray  # per item: what all its common words add, always under THRESHOLD
    rest: np.ndarray  # per block of items: the most of these
    most: int  # words of the longest item


def hashed_words(text: str) -> np.ndarray:
    data = NORMAL[np.frombuffer(text.encode(), np.uint8)]
    start, end, _ = words(data, np.array([0, len(data)]))
    return span_hash(prefix_sums(data), start, end)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of runs of n words."""
    if not 0 < n <= len(hashes):
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - n + 1 + j]
    return np.unique(out)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last line or sentence; an item of one sentence is all question."""
    parts = re.split(r"(?<=[.!?])\s+|\n+", text.strip())
    return (text, "") if len(parts) < 2 else (" ".join(parts[:-1]), parts[-1])


def gram_size(n_words: int, least: int) -> int:
    """Words of the n-grams of a side of ``n_words``: a quarter of them, so that one altered word leaves most n-grams, but ``least`` to GRAM."""
    return min(GRAM, max(least, n_words // 4), n_words)


def _sides(texts: list[str], least: int) -> Grams:
    """The n-grams of questions or answers."""
    hashes = [hashed_words(t) for t in texts]
    size = np.array([gram_size(len(h), least) for h in hashes], np.int64)
    found = [grams(h, n) for h, n in zip(hashes, size.tolist(), strict=True)]
    return Grams(size, np.cumsum([0, *map(len, found)]), np.concatenate(found))


def build(rows: list[tuple[object, str]], stats: Stats | None = None, frequencies: list[np.ndarray] | None = None) -> Index | None:
    """The index of (item_id, text), or of a part of all items; items without words are left out.

    For a part, ``stats`` are those of all items and ``frequencies`` holds for
    each row how many of all items have each of its distinct words, by ascending
    hash. Else both are taken from the rows.
    """
    kept = [(str(i), t, h, k) for k, (i, t) in enumerate(rows) if len(h := hashed_words(t or ""))]
    if not kept:
        return None
    lengths = np.array([len(h) for _, _, h, _ in kept])
    stats = stats or Stats(len(kept), float(lengths.mean()), int(lengths.max()))
    term, owner, tf = [], [], []
    for place, (_, _, h, _) in enumerate(kept):
        w, c = np.unique(h, return_counts=True)
        term.append(w)
        tf.append(c)
        owner.append(np.full(len(w), place))
    df = np.concatenate([frequencies[k] for *_, k in kept]) if frequencies else None
    term, owner, tf = map(np.concatenate, (term, owner, tf))
    order = np.argsort(term, kind="stable")
    term, owner, tf = term[order], owner[order], tf[order]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    starts = np.r_[first, len(term)]
    df = np.repeat(np.diff(starts), np.diff(starts)) if df is None else df[order]
    score = np.log(1 + (stats.items - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / stats.mean))
    impact = score / np.bincount(owner, score)[owner]
    common = df[first] > max(1, COMMON * stats.items)
    place = np.repeat(np.arange(len(first)), np.diff(starts))
    # an item that common words alone could retrieve is found by the weightiest of them, which then counts as rare in this part
    while (bare := (by_item := np.bincount(owner, impact * common[place], minlength=len(kept))) + 1e-9 >= THRESHOLD).any():
        some = np.flatnonzero(common[place] & bare[owner])
        some = some[np.lexsort((-impact[some], owner[some]))]
        common[place[some[np.r_[True, owner[some][1:] != owner[some][:-1]]]]] = False
    rest = np.maximum.reduceat(by_item, np.arange(0, len(kept), BLOCK))
    question, answer = (_sides([split_item(t)[k] for _, t, _, _ in kept], least) for k, least in enumerate(LEAST_GRAM))
    return Index(np.array([i for i, *_ in kept]), question, answer, term[first], starts, owner, impact, common, by_item, rest, stats.most)


def _packed(index: Index) -> bytes:
    out = io.BytesIO()
    flat = {k: v for k, v in index._asdict().items() if not isinstance(v, Grams)}
    flat |= {f"{side}_{k}": v for side in ("question", "answer") for k, v in getattr(index, side)._asdict().items()}
    np.savez(out, **flat)
    return out.getvalue()


_held: OrderedDict[str, tuple[Index, int]] = OrderedDict()


def load(path: str) -> Index:
    """A part of an index from the shared folder; a worker process keeps those used last, up to HELD_BYTES, and always one."""
    if path not in _held:
        index = _read(path)
        _held[path] = index, sum(x.nbytes for part in index for x in (part if isinstance(part, Grams) else (part,)) if isinstance(x, np.ndarray))
        while len(_held) > 1 and sum(size for _, size in _held.values()) > HELD_BYTES:
            _held.popitem(last=False)
    _held.move_to_end(path)
    return _held[path][0]


def _read(path: str) -> Index:
    files, name = pafs.FileSystem.from_uri(path)
    with files.open_input_stream(name) as source, np.load(io.BytesIO(source.read())) as flat:
        sides = [Grams(*(flat[f"{side}_{k}"] for k in Grams._fields)) for side in ("question", "answer")]
        rest = {k: flat[k] for k in Index._fields if k not in ("question", "answer", "most")}
        return Index(question=sides[0], answer=sides[1], most=int(flat["most"]), **rest)


def _postings(index: Index, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each posting of the terms: which of the terms it belongs to, and its place."""
    n = index.starts[terms + 1] - index.starts[terms]
    which = np.repeat(np.arange(len(terms)), n)
    return which, np.arange(n.sum()) + np.repeat(index.starts[terms] - np.r_[0, np.cumsum(n)[:-1]], n)


def wand(index: Index, terms: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
    """(item place, score) of all items that score at least the threshold for these distinct terms.

    Lists advance in item order. The pivot is the first item at which the
    lists' maxima reach the threshold; the maxima of the lists' blocks there
    decide whether it is scored or its blocks are skipped.
    """
    lists = []
    for t in terms.tolist():
        own, imp = index.owner[index.starts[t] : index.starts[t + 1]], index.impact[index.starts[t] : index.starts[t + 1]]
        tops = np.maximum.reduceat(imp, np.arange(0, len(imp), BLOCK)).tolist()
        lists.append([own.tolist(), imp.tolist(), tops, max(tops), 0])
    found = []
    slack = 1e-9
    while True:
        lists = [x for x in lists if x[4] < len(x[0])]
        lists.sort(key=lambda x: x[0][x[4]])
        bound, pivot = 0.0, None
        for k, x in enumerate(lists):
            bound += x[3]
            if bound + slack >= threshold:
                pivot = x[0][x[4]]
                break
        if pivot is None:
            return found
        while k + 1 < len(lists) and lists[k + 1][0][lists[k + 1][4]] == pivot:
            k += 1
        block_bound, jump = 0.0, None
        for x in lists[: k + 1]:  # shallow move: which block of each list covers the pivot
            at = x[4] // BLOCK
            while at < len(x[2]) and x[0][min((at + 1) * BLOCK, len(x[0])) - 1] < pivot:
                at += 1
            if at < len(x[2]):
                block_bound += x[2][at]
                last = x[0][min((at + 1) * BLOCK, len(x[0])) - 1]
                jump = last if jump is None else min(jump, last)
        if block_bound + slack >= threshold:
            score = 0.0
            for x in lists[: k + 1]:
                while x[4] < len(x[0]) and x[0][x[4]] < pivot:
                    x[4] += 1
                if x[4] < len(x[0]) and x[0][x[4]] == pivot:
                    score += x[1][x[4]]
                    x[4] += 1
            if score + slack >= threshold:
                found.append((pivot, score))
        else:
            target = (jump if jump is not None else pivot) + 1
            if k + 1 < len(lists):
                target = min(target, lists[k + 1][0][lists[k + 1][4]])
            target = max(target, pivot + 1) if k + 1 == len(lists) or lists[k + 1][0][lists[k + 1][4]] > pivot else target
            for x in lists[: k + 1]:
                while x[4] < len(x[0]) and x[0][x[4]] < target:
                    x[4] += 1


def _passages(bounds: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of passages of two strides, one stride apart; every word run of a stride lies in one."""
    n = np.diff(bounds)
    count = np.maximum(1, -(-n // stride) - 1) * (n > 0)
    row = np.repeat(np.arange(len(n)), count)
    first = bounds[row] + stride * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    return row, first, np.minimum(first + 2 * stride, bounds[row + 1])


def matches(index: Index, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float, int]]:
    """(row, item place) -> (score, question share, answer share, passages) of verified matches."""
    data = NORMAL[data]
    start, end, row = words(data, offsets)
    hashes = span_hash(prefix_sums(data), start, end)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    at = np.minimum(np.searchsorted(index.vocabulary, hashes), len(index.vocabulary) - 1)
    term = np.where(index.vocabulary[at] == hashes, at, -1) if len(hashes) else at
    p_row, p_first, p_end = _passages(bounds, index.most)
    if not len(p_row):
        return {}

    # bounds by rare words and item blocks, for all passages at once
    rare = np.flatnonzero((term >= 0) & ~index.common[term])
    lo, hi = np.searchsorted(rare, p_first), np.searchsorted(rare, p_end)
    n = hi - lo
    passage = np.repeat(np.arange(len(n)), n)
    use = term[rare[np.arange(n.sum()) + np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n)]]
    pairs = np.unique(passage * len(index.vocabulary) + use)
    passage, use = pairs // len(index.vocabulary), pairs % len(index.vocabulary)
    which, places = _postings(index, use)
    blocks = len(index.rest)
    cell = which * blocks + index.owner[places] // BLOCK  # a word's postings in one block of items
    if len(cell):
        head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        top = np.maximum.reduceat(index.impact[places], head)
        key, inverse = np.unique(passage[which[head]] * blocks + cell[head] % blocks, return_inverse=True)
        bound = np.bincount(inverse, top) + index.rest[key % blocks]
        some = np.unique(key[bound + 1e-9 >= THRESHOLD] // blocks)
        # the same by single items, for the passages left
        left = np.isin(passage, some)
        which, places = _postings(index, use[left])
        n_items = len(index.items)
        key, inverse = np.unique(passage[left][which] * n_items + index.owner[places], return_inverse=True)
        bound = np.bincount(inverse, index.impact[places]) + index.item_rest[key % n_items]
        some = set((key[bound + 1e-9 >= THRESHOLD] // n_items).tolist())
    else:
        some = set()

    found: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for p in sorted(some):
        own = hashes[p_first[p] : p_end[p]]
        terms = np.unique(term[p_first[p] : p_end[p]])
        hits = wand(index, terms[terms >= 0])
        text: dict[int, np.ndarray] = {}
        for place, score in hits:
            shares = []
            for side in (index.question, index.answer):
                size, wanted = int(side.size[place]), side.hashes[side.starts[place] : side.starts[place + 1]]
                if size not in text:
                    text[size] = grams(own, size)
                shares.append(float(np.isin(wanted, text[size], assume_unique=True).mean()) if len(wanted) else 1.0)
            if shares[0] >= QUESTION and shares[1] >= ANSWER:
                old = found.get((int(p_row[p]), place), (0.0, 0.0, 0.0, 0))
                found[int(p_row[p]), place] = (max(score, old[0]), max(shares[0], old[1]), max(shares[1], old[2]), old[3] + 1)
    return found


def write_index(benchmark: DataFrame) -> list[str]:
    """Build the index of all items in parts of about INDEX_BYTES of text and return their paths in the shared folder.

    Frequencies are counted by one shuffle of the items' words. A part is built
    and written by one task; the driver sees paths alone. Null texts and texts
    without words are left out; repeated items are items of their own.
    """
    spark = benchmark.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed_words(t) for t in batch.column(2).to_pylist()]
            terms = [np.unique(h).view(np.int64) for h in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(h) for h in found], pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["u", "item", "text", "n", "terms"])

    rows = benchmark.where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("u"), F.col("item_id").cast("string").alias("item"), "text")
    items = written(rows.mapInArrow(counted, "u long, item string, text string, n long, terms array<long>"), "bm25-items").where("n > 0")
    whole = items.agg(F.count(F.lit(1)).alias("items"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not whole["items"]:
        return []
    stats, parts = Stats(whole["items"], whole["mean"], whole["most"]), -(-whole["bytes"] // INDEX_BYTES)
    words_of = items.select("u", F.explode("terms").alias("term"))
    frequency = words_of.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    by_item = words_of.join(frequency, "term").groupBy("u").agg(F.collect_list(F.struct("term", "df")).alias("df"))
    dealt = items.join(by_item, "u").select(F.pmod(F.xxhash64("u"), F.lit(parts)).alias("part"), "item", "text", "df")
    out = new_path(spark, "bm25-index")

    def make(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["item"] is not None, r["item"] or "", r["text"]))
        frequencies = []
        for r in rows:  # by ascending unsigned hash, as ``build`` meets the words
            pairs = np.array([(x["term"], x["df"]) for x in r["df"]], np.int64)
            frequencies.append(pairs[np.argsort(pairs[:, 0].astype(np.uint64)), 1])
        index = build([("" if r["item"] is None else "=" + r["item"], r["text"]) for r in rows], stats, frequencies)
        files, folder = pafs.FileSystem.from_uri(out)
        files.create_dir(folder, recursive=True)
        name = f"{folder}/{uuid.uuid4().hex}.npz"
        with files.open_output_stream(name) as sink:
            sink.write(_packed(index))
        return pa.table({"path": [out.rsplit(folder, 1)[0] + name]})

    made = written(dealt.groupBy("part").applyInArrow(make, "path string"), "bm25-parts")
    return sorted(r["path"] for r in made.collect())


def _searched(docs: DataFrame, paths: list[str], schema, give: Callable) -> DataFrame:
    """``give(batches, found)`` of each buffer of documents, where found maps (row of the buffer, item) to its match."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def searched() -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, str], tuple] = {}
            for path in paths:
                index, first = load(path), 0
                for batch in held:
                    for a, _, data, offsets in slices(batch.column(place)):
                        found |= {(first + a + r, str(index.items[i])): x for (r, i), x in matches(index, data, offsets).items()}
                    first += batch.num_rows
            yield from give(held, found)

        for batch in batches:
            held.append(batch)
            size += batch.column(place).nbytes
            if size > BUFFER_BYTES:
                yield from searched()
                held, size = [], 0
        if held:
            yield from searched()

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_share, answer_share, n_passages of every document that holds a test item.

    Words are case-folded (A-Z) runs of letters, digits and non-ASCII
    characters. Passages are runs of twice the longest item's words, half
    overlapping, so an item of any length lies inside one, and whole texts are
    searched however long. A match needs the share THRESHOLD of the item's own
    BM25 score, and QUESTION and ANSWER of the n-grams; an item of one sentence
    has no answer to verify. The columns are the largest over the passages that
    match, and their number. Null and empty texts match nothing; repeated rows
    match each; items with one id and text give one match; an empty table of
    documents or items gives no rows. Other columns are not read.
    """
    id_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    names = ["doc_id", "item", "score", "question_share", "answer_share", "n_passages"]

    def give(held: list[pa.RecordBatch], found: dict) -> Iterator[pa.RecordBatch]:
        if found:
            ids = pa.concat_arrays([b.column(0) for b in held]).take(pa.array([r for r, _ in found]))
            items = pa.array([i[1:] if i else None for _, i in found], pa.string())
            yield pa.RecordBatch.from_arrays([ids, items, *(pa.array(x) for x in zip(*found.values(), strict=True))], names)

    paths = write_index(benchmark)
    rows = _searched(docs.select("doc_id", "text"), paths, f"doc_id {id_kind}, item string, score double, question_share double, answer_share double, n_passages long", give)
    # sums of one item can be taken in any order: the last digits mean nothing
    return rows.select("doc_id", F.col("item").cast(item_kind).alias("item_id"), F.round("score", 9).alias("score"), "question_share", "answer_share", "n_passages")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The input rows and columns of documents that match no test item, by the rules of ``contaminated``.

    Nothing is shuffled. Null and empty texts stay, as do repeated rows; with an
    empty table of items all rows stay. Extra columns pass through.
    """

    def give(held: list[pa.RecordBatch], found: dict) -> Iterator[pa.RecordBatch]:
        bad, first = np.array(sorted({r for r, _ in found}), np.int64), 0
        for batch in held:
            keep = np.ones(batch.num_rows, bool)
            keep[bad[(bad >= first) & (bad < first + batch.num_rows)] - first] = False
            first += batch.num_rows
            yield batch.filter(pa.array(keep))

    return _searched(docs, write_index(benchmark), docs.schema, give)
