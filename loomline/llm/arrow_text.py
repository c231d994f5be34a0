"""Zero-copy views of Arrow string columns, for vectorised work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; longer single texts are handled alone.
SLICE_BYTES = 2 << 20

#: The white space that separates words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fresh(names: list[str], *wanted: str) -> list[str]:
    """Column names for the ``wanted`` that clash with none of ``names``, whatever the case."""
    taken = {n.lower() for n in names}
    lead = "_"
    while any((lead + w).lower() in taken for w in wanted):
        lead += "_"
    return [lead + w for w in wanted]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and its row offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about ``most`` bytes."""
    data, offsets = buffer_of(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to ``n``; the table grows as needed."""
    size = max((n + 1).bit_length(), 21)
    if size not in _POWERS:
        _POWERS.clear()
        pair = []
        for base in (BASE, INVERSE):
            table = np.full(1 << size, base, np.uint64)
            table[0] = 1
            pair.append(np.multiply.accumulate(table))
        _POWERS[size] = (pair[0], pair[1])
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the bytes, so that any span hashes in constant time."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end)."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of the concatenated rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    space = SPACE[data]
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    start = np.flatnonzero(~space & (before | first[:n]))
    end = np.flatnonzero(~space & (after | first[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and the first word of each row (one entry more than rows)."""
    start, end, row = words(data, offsets)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    return span_hash(prefix_sums(LOWER[data]), start, end), bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles.

    A row with fewer than k words has its whole sequence as one shingle; a row
    without words has none.
    """
    hashes, bounds = word_hashes(data, offsets)
    weights = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    m = len(hashes)
    if m >= k:
        grams = np.zeros(m - k + 1, np.uint64)
        for j in range(k):
            grams += (hashes[j : m - k + 1 + j] ^ (hashes[j : m - k + 1 + j] >> np.uint64(29))) * weights[j]
        grams = mix(grams)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            own = hashes[a:b]
            yield mix((own * weights[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
