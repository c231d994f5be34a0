"""Periodic runs of words by online dyadic square catching.

Every completed block of 2**k words that starts at a multiple of 2**k becomes a
catcher. A square whose root has from 2**(k+1) - 1 to 2**(k+2) - 2 words holds
such a block in its first half, so it is caught when the block's words come
again within that distance: each appended word ends one window of every size,
which is compared with the few catchers of that size in reach. What a catcher
finds is a comparison of two places one period apart. Its suffixes are compared
backwards once; then each appended word takes it one word further until words
differ. All squares of a comparison are one run.

Windows are compared by 64-bit hashes. Equal windows have equal hashes, so none
is missed; every run that is reported has been compared word by word, and if two
different windows ever shared a hash, all is done again with another salt.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress, count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.arrow_text import mix, slices

#: Words of a run at least; it also has its period twice.
LEAST = 12
#: Hashes of all windows of up to 2**LOW words are kept, for extending comparisons; of larger ones only the last.
LOW = 5
#: Words appended at once; it bounds the scratch memory and changes no result.
APPEND = 1 << 18
RUNS = "array<struct<start: long, length: long, period: long>>"


class HashCollision(Exception):
    """Two different windows have one hash."""


def periods(k: int, least: int = LEAST) -> range:
    """Periods whose shortest stretch of agreeing words, max(period, least - period), surely holds a block of 2**k words but maybe none of 2**(k+1)."""
    low = (2 << k) - 1
    first = max(1, least - 2 * low)
    if first > least - low:
        first = max(first, low)
    return range(first, 2 * low + 1)


class _Level:
    """Windows of 2**k words: hashes of the last ones, or of all, and of the completed blocks."""

    def __init__(self, k: int):
        self.k, self.size, self.end = k, 1 << k, 0
        self.tail = self.caught = np.zeros(0, np.uint64)

    @property
    def base(self) -> int:
        return self.end - len(self.tail)

    def add(self, hashes: np.ndarray) -> None:
        first = -self.end % self.size
        self.caught = np.concatenate([self.caught, hashes[first :: self.size]])
        kept = self.tail if self.k <= LOW else self.tail[max(0, len(self.tail) - self.size) :]
        self.tail = np.concatenate([kept, hashes])
        self.end += len(hashes)

    def hits(self, start: int, hashes: np.ndarray, within: range) -> tuple[np.ndarray, np.ndarray]:
        """(start of a catcher, period) for the windows from ``start`` on that repeat one."""
        at = np.arange(start, start + len(hashes))
        block = (at - within.start) >> self.k
        blocks, found = [], []
        for _ in range((within.stop - within.start) // self.size + 2):
            some = np.flatnonzero((block >= 0) & (at - (block << self.k) < within.stop))
            some = some[self.caught[block[some]] == hashes[some]]
            blocks.append(block[some] << self.k)
            found.append(at[some] - blocks[-1])
            block = block - 1
        return np.concatenate(blocks), np.concatenate(found)


class Catchers:
    """Runs of a growing sequence of numbers; how it is cut into appended pieces changes no result.

    Numbers from 0 up are words; negative ones, each used once, separate
    sequences. ``longest`` bounds the words between two of them. A run comes out
    of the append that ends it, or of ``finish``: (start, length, period) rows.
    """

    def __init__(self, longest: int | None = None, least: int = LEAST, salt: int = 0):
        self.n, self.longest, self.least, self.salt = 0, longest, least, np.uint64(salt)
        self.levels = [_Level(0)]
        self.period, self.left, self.right = (np.zeros(0, np.int64) for _ in range(3))

    def _agreeing(self, a: np.ndarray, gap: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Number of words, up to ``most``, that agree at ``a`` and ``a + gap``, going right, or left from the words before."""
        far = np.zeros(len(a), np.int64)
        low = [level.tail for level in self.levels[: LOW + 1]]

        def step(some: np.ndarray, size: int, hashes: np.ndarray) -> np.ndarray:
            some = some[far[some] + size <= most[some]]
            x = a[some] - far[some] - size if back else a[some] + far[some]
            some = some[hashes[x] == hashes[x + gap[some]]]
            far[some] += size
            return some

        some = np.arange(len(a))
        while len(some):
            some = step(some, 1 << (len(low) - 1), low[-1])
        for j in reversed(range(len(low) - 1)):
            step(np.arange(len(a)), 1 << j, low[j])
        return far

    def append(self, words: np.ndarray) -> np.ndarray:
        old, self.n = self.n, self.n + len(words)
        hits = []
        fresh = mix(words.astype(np.int64).view(np.uint64) + self.salt)
        for k in count():
            if k == len(self.levels):
                if self.n < 1 << k or (self.longest is not None and self.longest < 2 * ((2 << k) - 1)):
                    break
                self.levels.append(_Level(k))
            level = self.levels[k]
            if k:
                below, start, end = self.levels[k - 1], level.end, max(0, self.n - level.size + 1)
                x = below.tail[start - below.base : end - below.base]
                y = below.tail[start + below.size - below.base : end + below.size - below.base]
                fresh = mix(x * np.uint64(0x9FB21C651E98DF25) + (y ^ (y >> np.uint64(31)))) if end > start else x[:0]
            start = level.end
            level.add(fresh)
            if len(within := periods(k, self.least)) and len(fresh):
                s, p = level.hits(start, fresh, within)
                hits.append(np.stack([p, s, s + level.size]))
        # comparisons that were open go on over the new words
        self.right = self.right + self._agreeing(self.right, self.period, self.n - self.period - self.right, False)
        if hits:
            self._open(np.concatenate(hits, axis=1))
        return self._close(self.right + self.period < self.n)

    def _open(self, hits: np.ndarray) -> None:
        """New comparisons of the caught blocks (period, start, end) that no open one covers."""
        p, s, e = hits[:, np.lexsort((hits[1], hits[0]))]
        if len(self.period):
            at = np.minimum(np.searchsorted(self.period, p), len(self.period) - 1)
            new = (self.period[at] != p) | (s < self.left[at]) | (s >= self.right[at])
            p, s, e = p[new], s[new], e[new]
        if not len(p):
            return
        first = np.r_[True, (p[1:] != p[:-1]) | (s[1:] > e[:-1])]  # blocks that touch are one comparison
        last = np.r_[first[1:], True]
        p, s, e = p[first], s[first], e[last]
        s = s - self._agreeing(s, p, s, True)
        e = e + self._agreeing(e, p, self.n - p - e, False)
        self.period, self.left, self.right = np.r_[self.period, p], np.r_[self.left, s], np.r_[self.right, e]

    def _close(self, ended: np.ndarray) -> np.ndarray:
        p, s, e = self.period[ended], self.left[ended], self.right[ended]
        order = np.argsort(self.period[~ended], kind="stable")
        self.period, self.left, self.right = (x[~ended][order] for x in (self.period, self.left, self.right))
        whole = e - s >= np.maximum(p, self.least - p)
        p, s, e = p[whole], s[whole], e[whole]
        order = np.lexsort((p, e + p, s))
        runs = np.stack([s, e - s + p, p], axis=1)[order]
        if len(runs):  # multiples of a period have the same stretch
            runs = runs[np.r_[True, (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])]]
            size = runs[:, 1] - runs[:, 2]
            at = np.arange(size.sum()) + np.repeat(runs[:, 0] - np.r_[0, np.cumsum(size)[:-1]], size)
            plain = self.levels[0].tail
            if (plain[at] != plain[at + np.repeat(runs[:, 2], size)]).any():
                raise HashCollision
        return runs

    def finish(self) -> np.ndarray:
        """The runs that the end of the sequence ends."""
        return self._close(np.ones(len(self.period), bool))


def find_runs(words: np.ndarray, longest: int | None = None, least: int = LEAST, piece: int = APPEND) -> np.ndarray:
    """(start, length, period) of all runs of the numbers, appended ``piece`` at a time, in ascending order."""
    for salt in count():
        catchers = Catchers(longest, least, salt * 0x5851F42D4C957F2D % (1 << 64))
        try:
            found = [catchers.append(words[i : i + piece]) for i in range(0, len(words), piece)]
            runs = np.concatenate([*found, catchers.finish()])
            return runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        except HashCollision:
            continue
    raise AssertionError


def _rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Words of each text, text of each run, runs, and the texts without repeats."""
    words = [t.split() for t in texts]  # bytes.split() parts at space and U+0009 to U+000D
    sizes = np.array([len(w) for w in words], np.int64)
    numbers: dict[bytes, int] = {}
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    flat = np.empty(int(ends[-1]), np.int64)
    is_word = np.ones(len(flat), bool)
    is_word[ends - 1] = False
    flat[~is_word] = -1 - np.arange(len(texts))
    flat[is_word] = np.fromiter(map(numbers.setdefault, chain.from_iterable(words), count()), np.int64, int(sizes.sum()))
    runs = find_runs(flat, int(sizes.max()))
    step = np.zeros(len(flat) + 1, np.int32)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(step[:-1]) == 0
    text_of = np.searchsorted(ends, runs[:, 0], "right")
    some = set(text_of.tolist())
    kept = [b" ".join(compress(w, stays[a : a + len(w)].tolist()) if i in some else w) for i, (w, a) in enumerate(zip(words, starts.tolist(), strict=True))]
    runs[:, 0] -= starts[text_of]
    return sizes, text_of, runs, kept


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every document.

    Words are runs of other characters than white space, numbered from 0. A run
    is a stretch of at least 12 words and two periods that agrees with itself one
    smallest period later and that no neighbouring word extends; ``runs`` has
    (start, length, period) by start, then length, then period. ``collapsed`` is
    the words that lie in no run beyond its first period, joined by one space. A
    null text has no words; collapsed is then empty, never null. Repeated rows
    and null ids are rows like any other. Other columns are not read. A task
    holds the words of about 2 MB of text, or of one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                sizes, text_of, runs, kept = _rows([data[x:y].tobytes() for x, y in pairwise(offsets.tolist())])
                struct = pa.StructArray.from_arrays([pa.array(runs[:, j]) for j in range(3)], ["start", "length", "period"])
                bounds = np.searchsorted(text_of, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), struct)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; about every tenth text becomes periodic from some word on, as its id's checksum h tells.

    With g = h div 10, n words, a = g % n and p = 1 + (n - a) div (3 + g % 8),
    word i from a on becomes word a + (i - a) % p where h % 10 = 0. A null id, or
    a text without words, changes nothing.
    """
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")).withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    periodic = F.expr("array_join(concat(slice(words, 1, a), transform(sequence(a, n - 1), i -> words[a + (i - a) % p])), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform(F.array_sort(F.transform("runs", lambda r: F.struct(r["start"], r["period"], r["length"]))), lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    exponent = F.floor(F.lit(1000) * length / period).cast("long")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
