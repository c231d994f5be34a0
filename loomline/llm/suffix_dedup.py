"""Removal of repeated byte strings by suffix order, in blocks that fit a task.

Strings of ``LENGTH`` bytes that start at more than one place of the corpus are
found exactly:

1. Every string of LENGTH bytes has an anchor, the place of its smallest k-gram
   hash. Equal strings have equal anchors at equal places inside them, so only
   places around anchors whose k-gram occurs twice can hold repeats.
2. Anchors whose whole surroundings occur twice are settled by that: all of it
   is repeated. One of each such group goes on, as evidence.
3. Surroundings that differ are halved: the strings that begin up to HALF bytes
   before the anchor all cover one core of bytes, and so do the others. Halves
   whose core occurs once hold no repeats.
4. The other halves go to blocks by core. A block is concatenated, its suffixes
   are sorted, and breadth-first backward extension on the Burrows-Wheeler
   transform sets common prefixes by increasing value. It stops at LENGTH:
   neighbours that are still unset share at least LENGTH bytes.

A core with more different halves than a block holds is settled by digests of
its strings instead, which are counted in a shuffle.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomline.llm.arrow_text import fresh, mix, powers, prefix_sums, slices
from loomline.session import written

LENGTH = 200
#: Bytes of an anchor's k-gram.
GRAM = 40
#: Strings that begin up to so many bytes before their anchor are the first half.
HALF = (LENGTH - GRAM) // 2
#: Bytes of a block.
BLOCK_BYTES = 1 << 19
#: Halves with one core that go to one block.
MOST_WINDOWS = 4096
_CHUNK = 2 << 20


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and k-gram hashes of the anchors of all strings of ``length`` bytes inside rows."""
    places, grams = [], []
    width = length - gram + 1
    for base in range(0, len(data) - length + 1, _CHUNK):
        part = data[base : base + _CHUNK + length - 1]
        sums = prefix_sums(part)
        n = len(part) - gram + 1
        hashes = mix((sums[gram:] - sums[:-gram]) * powers(len(part))[1][:n])
        key = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)  # equal hashes: the leftmost
        size = 1
        while 2 * size <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if width > size:
            key = np.minimum(key[: size - width], key[width - size :])
        inside = np.zeros(len(key) + 1, np.int32)  # starts whose string crosses a row's end are left out
        ends = offsets[1:-1] - base
        ends = ends[(ends > 0) & (ends < len(part))]
        np.add.at(inside, np.clip(ends - length + 1, 0, len(key)), 1)
        np.add.at(inside, np.clip(ends, 0, len(key)), -1)
        own = (key[np.cumsum(inside[:-1]) == 0] & np.uint64(0xFFFFFF)).astype(np.int64)
        own = own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own
        places.append(own + base)
        grams.append(hashes[own])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(grams)[first]


_TAG = (1 << 31) - 1


def text_tag(text: bytes) -> int:
    """31 bits that tell rows of one doc_id with different texts apart."""
    return xxhash.xxh64_intdigest(text, 42) & _TAG


def _text_tag() -> Column:
    """``text_tag`` of the column text, null as empty: Spark's hash has 42 as its seed."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit(_TAG))


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """gram, window (hash of the surroundings), id, place in the text and text tag of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in slices(batch.column(1)):
                places, grams = anchors(data, offsets)
                row = np.searchsorted(offsets, places, "right") - 1
                lo = np.maximum(offsets[row], places - (LENGTH - GRAM))
                hi = np.minimum(offsets[row + 1], places + LENGTH)
                view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
                windows = np.array([digest(view[x:y], p) for x, y, p in zip(lo.tolist(), hi.tolist(), (places - lo).tolist(), strict=True)], np.uint64)
                tags = np.array([text_tag(view[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int32)
                columns = [grams.view(np.int64), windows.view(np.int64), ids.slice(a, b - a).take(pa.array(row)), (places - offsets[row]).astype(np.int32), tags[row]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "window", "id", "place", "tag"])

    return docs.mapInArrow(run, "gram long, window long, id long, place int, tag int")


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes sorted by their first ``depth`` symbols at least; a symbol 0 ends a row and is unique.

    Seven symbols make the first key; then pairs of ranks double the sorted
    length, for the suffixes that are not told apart yet.
    """
    n = len(symbols)
    zero = np.flatnonzero(symbols == 0)
    left = (np.repeat(zero, np.diff(zero, prepend=-1)) - np.arange(n)).astype(np.int32)  # symbols before the row's end
    key, h = symbols.astype(np.int64), 7

    def after(x: np.ndarray, j: int) -> np.ndarray:
        """What stands j symbols on, nothing beyond the row's end."""
        out = np.zeros(n, np.int64)
        out[: max(0, n - j)] = x[j:]
        out[left < j] = 0
        return out

    two = key << 9 | after(key, 1)
    four = two << 18 | after(two, 2)
    key = (four << 18 | after(two, 4)) << 9 | after(key, 6)
    order = np.argsort(key)
    ended = left[order] < h  # equal ones of these differ by their place
    some = order[ended]
    order[ended] = some[np.lexsort((some, key[some]))]
    slots, sorted_key, rank = np.arange(n), key[order], np.zeros(n, np.int64)
    while True:
        head = np.ones(len(slots), bool)
        head[1:] = (sorted_key[1:] != sorted_key[:-1]) | (left[order[slots[1:]]] < h)
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        alone = head & np.r_[head[1:], True]
        slots = slots[~alone]
        if h >= depth or not len(slots):
            return order
        some = order[slots]
        key = rank[some] * (n + 1) + rank[np.minimum(some + h, n - 1)]
        by = np.argsort(key)
        order[slots], sorted_key = some[by], key[by]
        h *= 2


def repeated_starts(symbols: np.ndarray, length: int) -> np.ndarray:
    """Places where a string of ``length`` symbols starts that also starts elsewhere; a symbol 0 ends a row.

    Breadth-first backward extension: the intervals of all strings of m symbols
    are extended by one symbol to the left, which gives intervals for m + 1. The
    right end of an interval that was not set before has a common prefix of m;
    it is set, and only such intervals are extended again.
    """
    n = len(symbols)
    symbols = symbols.astype(np.int16)
    order = suffix_array(symbols, length)
    inverse = np.empty(n, np.int32)
    inverse[order] = np.arange(n, dtype=np.int32)
    before = symbols[order - 1]  # the Burrows-Wheeler transform
    step = inverse[order - 1]  # where a suffix goes when its preceding symbol is put before it
    real = before != 0
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    first = symbols[order]
    lo = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (first[1:] == 0)])
    hi = np.r_[lo[1:], n]
    known[hi] = True
    for _ in range(length - 1):
        width = hi - lo
        one = width == 1
        single = lo[one]
        single = step[single[real[single]]]
        single = single[~known[single + 1]]
        lo, width = lo[~one], width[~one]
        places = np.arange(width.sum()) + np.repeat(lo - np.r_[0, np.cumsum(width)[:-1]], width) if len(lo) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(lo)), width)
        inside = real[places]
        places, group = places[inside], group[inside]
        to = step[places]
        by = np.argsort(to)
        to, key = to[by], group[by] * 257 + before[places[by]]
        head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1])]) if len(to) else np.zeros(0, np.int64)
        new_lo, new_hi = to[head], np.r_[to[head[1:] - 1], to[-1:]] + 1 if len(to) else to
        new = ~known[new_hi]
        lo, hi = np.r_[single, new_lo[new]], np.r_[single + 1, new_hi[new]]
        known[hi] = True
        if not len(lo):
            break
    return order[~known[:-1] | ~known[1:]]


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by strings of ``length`` at the sorted starts."""
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]] + length


def _repeats_in(block: pd.DataFrame) -> pd.DataFrame:
    """id, tag, lo, hi of repeated spans; surroundings of one text that overlap are one row of the block."""
    block = block.sort_values(["none", "id", "tag", "lo"], ignore_index=True)
    rows: list[list] = []
    for none, id_, tag, lo, data in zip(block["none"].tolist(), block["id"].tolist(), block["tag"].tolist(), block["lo"].tolist(), block["data"], strict=True):
        last, id_ = rows[-1] if rows else None, None if none else id_
        if last and last[0] == (id_, tag) and lo <= last[1] + len(last[2]):
            last[2] += data[max(0, last[1] + len(last[2]) - lo) :]
        else:
            rows.append([(id_, tag), lo, bytearray(data)])
    joined = np.concatenate([x for r in rows for x in (np.frombuffer(r[2], np.uint8).astype(np.int64) + 1, [0])])
    starts = np.sort(repeated_starts(joined, LENGTH))
    ends = np.cumsum([len(r[2]) + 1 for r in rows])
    row = np.searchsorted(ends, starts, "right")
    found = []
    for k in np.unique(row).tolist():
        (id_, tag), at, data = rows[k]
        base = ends[k] - len(data) - 1
        found += [(id_, tag, a, b) for a, b in zip(*(x - base + at for x in _spans(starts[row == k], LENGTH)), strict=True)]
    return pd.DataFrame(found, columns=["id", "tag", "lo", "hi"]).astype({"id": "Int64"})


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups of one core, which arrive sorted, until a block is full."""
    held: pd.DataFrame | None = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        sizes = held["data"].str.len().cumsum().to_numpy()
        ends = np.flatnonzero((held["core"].to_numpy()[1:] != held["core"].to_numpy()[:-1]) | (held["gram"].to_numpy()[1:] != held["gram"].to_numpy()[:-1])) + 1
        at = 0
        while len(ends) and sizes[-1] - (sizes[at - 1] if at else 0) > BLOCK_BYTES:
            k = np.searchsorted(sizes[ends - 1], (sizes[at - 1] if at else 0) + BLOCK_BYTES)
            if k == len(ends):
                break
            yield _repeats_in(held.iloc[at : ends[k]])
            at, ends = ends[k], ends[k + 1 :]
        held = held.iloc[at:]
    if held is not None and len(held):
        yield _repeats_in(held)


def _by_text(rows: DataFrame, columns: list[str], tag: Column) -> DataFrame:
    """id, _tag and their rows as one array without repeats: one text's anchors, however many rows share the id or are its copies."""
    return rows.groupBy("id", tag.alias("_tag")).agg(F.collect_set(F.struct(*columns)).alias("rows"))


def _with_text(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    return docs.join(rows, F.col("doc_id").eqNullSafe(F.col("id")) & (_text_tag() == F.col("_tag")), how)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """id, tag (of the text), lo, hi of spans covered by repeated strings; spans may overlap."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = written(_anchor_rows(docs), "suffix-places")  # read twice: the grams alone, then what repeats
    twice = written(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "suffix-grams")
    at = F.shiftleft(F.col("place").cast("long"), 31).bitwiseOR(F.col("tag").cast("long")).alias("at")
    some = written(every.join(twice, "gram", "left_semi").select("gram", "window", "id", at), "suffix-anchors")
    windows = some.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("id"), F.first("at").alias("at"))
    place, tag = F.shiftright("at", 31), F.col("at").bitwiseAND((1 << 31) - 1)

    whole = windows.where("n > 1").select("gram", "window")
    settled = some.join(whole, ["gram", "window"], "left_semi").select("id", tag.alias("tag"), F.greatest(F.lit(0), place - (LENGTH - GRAM)).alias("lo"), (place + LENGTH).alias("hi"))

    windows = written(windows, "suffix-windows")
    differing = windows.groupBy("gram").agg(F.count(F.lit(1)).alias("windows")).where("windows > 1").select("gram")
    open_ = windows.join(differing, "gram").select("gram", "id", "at", (F.col("n") > 1).alias("many"))
    texts = _with_text(docs, _by_text(open_, ["gram", "at", "many"], tag), "inner").select("id", "text", "rows")
    cores = texts.mapInArrow(_cores, "gram long, core long, id long, at long, half int, many boolean")
    sizes = cores.groupBy("gram", "core").agg(F.count(F.lit(1)).alias("halves")).where("halves > 1")
    halves = cores.join(sizes, ["gram", "core"]).select("gram", "core", "id", "at", "half", "many", (F.col("halves") > MOST_WINDOWS).alias("wide"))
    fields = ["gram", "core", "at", "half", "many"]
    narrow = _with_text(docs, _by_text(halves.where("NOT wide"), fields, tag), "inner").select("id", "text", "rows")
    blocks = narrow.mapInArrow(_cut, "gram long, core long, none boolean, id long, tag long, lo long, data binary").repartition("gram", "core").sortWithinPartitions("gram", "core")
    found = settled.unionByName(blocks.mapInPandas(_blocks, "id long, tag long, lo long, hi long"))
    wide = _with_text(docs, _by_text(halves.where("wide"), fields, tag), "inner").select("id", "text", "rows")
    strings = wide.mapInArrow(_digests, "d1 long, d2 long, id long, tag long, lo long, many boolean")
    again = strings.groupBy("d1", "d2").agg(F.bool_or("many").alias("many"), F.count_distinct(F.struct("id", "tag", "lo")).alias("places")).where("many OR places > 1").select("d1", "d2")
    return found.unionByName(strings.join(again, ["d1", "d2"], "left_semi").select("id", "tag", "lo", (F.col("lo") + LENGTH).alias("hi")))


def _starts(p: int, n: int, half: int) -> tuple[int, int]:
    """First and last start of the strings of a half around an anchor at ``p`` of ``n`` bytes; none if the first is larger."""
    lo, hi = (p - HALF, p) if half == 0 else (p - (LENGTH - GRAM), p - HALF - 1)
    return max(0, lo), min(hi, n - LENGTH)


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each half of the given anchors that holds strings."""
    for batch in batches:
        gram, core, ids, ats, halves, many = [], [], [], [], [], []
        for id_, text, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode()
            own = text_tag(data)
            for r in rows.as_py():
                p = r["at"] >> 31
                if r["at"] & _TAG != own:
                    continue
                for half in (0, 1):
                    lo, hi = _starts(p, len(data), half)
                    if lo <= hi:
                        part = data[p : p + LENGTH - HALF] if half == 0 else data[p - HALF - 1 : p + GRAM]
                        gram.append(r["gram"])
                        core.append(xxhash.xxh3_64_intdigest(part, half) - (1 << 63))
                        ids.append(id_)
                        ats.append(r["at"])
                        halves.append(half)
                        many.append(r["many"])
        yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(core, pa.int64()), pa.array(ids, pa.int64()), pa.array(ats, pa.int64()), pa.array(halves, pa.int32()), pa.array(many, pa.bool_())], ["gram", "core", "id", "at", "half", "many"])


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, tag, text bytes, row) of the given halves whose text is the one they were found in."""
    for batch in batches:
        for id_, text, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode()
            own = text_tag(data)
            for r in rows.as_py():
                if r["at"] & _TAG == own:
                    yield id_, own, data, r


def _batched(rows: Iterator[tuple], names: tuple[str, ...], types: list[pa.DataType], most: int = 4000) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), types, strict=True)], list(names))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the strings of each half; ``none`` tells a null id, as pandas would make all ids floats."""

    def rows() -> Iterator[tuple]:
        for id_, tag, data, r in _halves(batches):
            lo, hi = _starts(r["at"] >> 31, len(data), r["half"])
            yield r["gram"], r["core"], id_ is None, id_ or 0, tag, lo, data[lo : hi + LENGTH]

    yield from _batched(rows(), ("gram", "core", "none", "id", "tag", "lo", "data"), [pa.int64()] * 2 + [pa.bool_()] + [pa.int64()] * 3 + [pa.binary()])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of every string of each half."""

    def rows() -> Iterator[tuple]:
        for id_, tag, data, r in _halves(batches):
            lo, hi = _starts(r["at"] >> 31, len(data), r["half"])
            for x in range(lo, hi + 1):
                d = xxhash.xxh3_128_intdigest(data[x : x + LENGTH])
                yield (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), id_, tag, x, r["many"]

    yield from _batched(rows(), ("d1", "d2", "id", "tag", "lo", "many"), [pa.int64()] * 5 + [pa.bool_()])


def kept_parts(data: bytes, spans: list[tuple[int, int]] | np.ndarray) -> tuple[bytes, int, int]:
    """The bytes outside the spans, the number removed, and the number of maximal removed runs."""
    spans = np.asarray(spans, np.int64).reshape(-1, 2)
    if not len(spans):
        return data, 0, 0
    lo, hi = spans[:, 0], np.minimum(spans[:, 1], len(data))
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.r_[True, lo[1:] > reach[:-1]])
    starts, ends = lo[first].tolist(), reach[np.r_[first[1:] - 1, len(lo) - 1]].tolist()
    kept = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)], strict=True))
    return kept, len(data) - len(kept), len(first)


def _apply(docs: DataFrame, make, fields: list[StructField]) -> DataFrame:
    """The docs' columns, with what ``make(text bytes, spans)`` returns as further columns."""
    names = docs.columns
    span_id, span_tag, found = fresh(names, "span_id", "span_tag", "spans")
    spans = _by_text(repeated_spans(docs), ["tag", "lo", "hi"], F.col("tag")).select(F.col("id").alias(span_id), F.col("_tag").alias(span_tag), F.col("rows").alias(found))
    joined = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(span_id)) & (_text_tag() == F.col(span_tag)), "left").drop(span_id, span_tag)
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(len(names))
            bounds, flat = rows.offsets.to_pylist(), rows.values
            tags, pairs = flat.field("tag").to_numpy(), np.stack([flat.field("lo").to_numpy(), flat.field("hi").to_numpy()], 1)
            made = []
            for k, text in enumerate(batch.column(place).cast(pa.binary())):
                data, a, b = text.as_py() or b"", bounds[k], bounds[k + 1]
                made.append(make(data, pairs[a:b][tags[a:b] == text_tag(data)] if b > a and rows[k].is_valid else ()))
            more = [pa.array(x) for x in zip(*made, strict=True)] if made else [pa.array([], pa.null()) for _ in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], [*names, *(f.name for f in fields)])

    return joined.mapInArrow(run, StructType([*docs.schema.fields, *fields]))


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A byte goes if a string of 200 bytes that covers it also starts anywhere
    else, in the same or another document; strings are judged on the input and
    never cross documents. A null text is empty; texts under 200 bytes stay
    whole. Repeated rows are copies of each other, so each loses its text.
    """

    def make(data: bytes, spans):
        kept, removed, runs = kept_parts(data, spans)
        return len(data), removed, runs, hashlib.sha256(kept).hexdigest()

    fields = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())]
    return _apply(docs.select("doc_id", "text"), make, fields).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The input rows with repeated spans cut from text, and n_chars made to fit where it exists.

    A character of which only some bytes are kept goes too. No row is dropped; a
    text of repeats alone becomes empty, and a null text stays null.
    """

    def make(data: bytes, spans):
        return (kept_parts(data, spans)[0].decode("utf-8", "ignore"),)

    names = docs.columns
    (kept,) = fresh(names, "kept")
    cut = _apply(docs, make, [StructField(kept, StringType())])
    text = F.when(F.col("text").isNotNull(), F.col(kept)).alias("text")
    count = F.length(kept).cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in names else None
    return cut.select(*[text if c == "text" else count if c == "n_chars" else F.col(f"`{c}`") for c in names])
