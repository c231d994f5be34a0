"""PNG images as numpy arrays inside Arrow-batched functions: BINARY in, BINARY or numbers out.

Eight-bit PNGs without interlacing are read; other formats need a codec that is
not installed and give null.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.sources.metadata import PNG, png_chunks

_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(data: bytes | None) -> np.ndarray | None:
    """Height by width by channels; null for what cannot be read."""
    if not data or data[:8] != PNG:
        return None
    try:
        chunks = list(png_chunks(data))
        head = dict(chunks)[b"IHDR"]
        w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
        if head[8] != 8 or head[12] or head[9] not in _CHANNELS:
            return None
        n = _CHANNELS[head[9]]
        raw = np.frombuffer(zlib.decompress(b"".join(c for k, c in chunks if k == b"IDAT")), np.uint8).reshape(h, 1 + w * n)
    except (zlib.error, ValueError, KeyError, IndexError):
        return None
    if not raw[:, 0].any():  # no line is filtered
        return raw[:, 1:].reshape(h, w, n).copy()
    out = np.zeros((h + 1, w + 1, n), np.int32)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].reshape(w, n).astype(np.int32)
        above = out[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            out[y + 1, 1:] = (line + above) & 255
        else:
            for x in range(w):
                a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                out[y + 1, x + 1] = (line[x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def encode(pixels: np.ndarray) -> bytes:
    h, w, n = pixels.shape
    kind = {v: k for k, v in _CHANNELS.items()}[n]
    chunk = lambda name, content: len(content).to_bytes(4, "big") + name + content + zlib.crc32(name + content).to_bytes(4, "big")
    raw = np.hstack([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * n)]).tobytes()
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, kind, 0, 0, 0])
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def each(content: Column, change: Callable[[np.ndarray], np.ndarray]) -> Column:
    """A change of every image's pixels; changes of one picture share a Python worker, as functions of iterators would not."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if (p := decode(x)) is None else encode(np.ascontiguousarray(change(p))))

    return run(content)


def flip(content: Column, horizontal: bool = True) -> Column:
    return each(content, lambda p: p[:, ::-1] if horizontal else p[::-1])


def crop(content: Column, left: float, top: float, right: float, bottom: float, percent: bool = False) -> Column:
    """Pixels, or shares of the sides in percent, taken off each side; at least one pixel stays."""

    def change(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        l, t, r, b = ((int(x * s / 100) if percent else int(x)) for x, s in zip((left, top, right, bottom), (w, h, w, h), strict=True))
        return p[min(t, h - 1) : max(h - b, min(t, h - 1) + 1), min(l, w - 1) : max(w - r, min(l, w - 1) + 1)]

    return each(content, change)


def curve(content: Column, points: list[tuple[int, int]]) -> Column:
    """Brightness through a curve of (in, out) points, straight between them."""
    table = np.interp(np.arange(256), *zip(*sorted(points), strict=True)).round().astype(np.uint8)
    return each(content, lambda p: np.concatenate([table[p[:, :, :3]], p[:, :, 3:]], axis=2) if p.shape[2] >= 3 else table[p])


def exposure(content: Column, gain: float, contrast: float) -> Column:
    """Brightness times a gain, then contrast around the middle."""
    return each(content, lambda p: np.clip((p.astype(float) * gain - 128) * contrast + 128, 0, 255).round().astype(np.uint8))


def overlay(content: Column, top: Column, x: int = 0, y: int = 0) -> Column:
    """A second image laid over the first by its transparency; what reaches beyond is cut."""

    @F.pandas_udf("binary")
    def run(below: pd.Series, above: pd.Series) -> pd.Series:
        def one(a: bytes | None, b: bytes | None) -> bytes | None:
            p, q = decode(a), decode(b)
            if p is None or q is None or p.shape[2] < 3 or q.shape[2] < 3:
                return a if q is None else None
            p, q = p.copy(), q[: max(0, p.shape[0] - y), : max(0, p.shape[1] - x)]
            alpha = q[:, :, 3:4] / 255 if q.shape[2] == 4 else 1.0
            part = p[y : y + q.shape[0], x : x + q.shape[1], :3]
            p[y : y + q.shape[0], x : x + q.shape[1], :3] = (part * (1 - alpha) + q[:, :, :3] * alpha).round().astype(np.uint8)
            return encode(p)

        return pd.Series([one(a, b) for a, b in zip(below, above, strict=True)], dtype=object)

    return run(content, top)


def split_grid(images: DataFrame, columns: int, rows: int) -> DataFrame:
    """path, row, column, content: every image as an even grid of images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if (p := decode(content)) is not None:
                    out += [(path, r, c, encode(np.ascontiguousarray(cell))) for r, band in enumerate(np.array_split(p, rows, axis=0)) for c, cell in enumerate(np.array_split(band, columns, axis=1))]
            yield pd.DataFrame(out, columns=["path", "row", "column", "content"])

    return images.select("path", "content").mapInPandas(run, "path string, row int, column int, content binary")


def histogram(content: Column) -> Column:
    """Shares of the 256 values of red, green and blue, one after the other; a grey image counts for all three."""

    @F.pandas_udf("array<double>")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x: bytes | None):
            p = decode(x)
            if p is None:
                return None
            channels = p[:, :, :3] if p.shape[2] >= 3 else np.repeat(p[:, :, :1], 3, axis=2)
            counts = np.stack([np.bincount(channels[:, :, k].ravel(), minlength=256) for k in range(3)])
            return (counts / np.maximum(counts.sum(1, keepdims=True), 1)).ravel()  # as an array: a list of numbers is four times as large

        for batch in values:
            for at in range(0, max(len(batch), 1), 500):  # many numbers a row: they leave in pieces
                yield batch[at : at + 500].map(one)

    return run(content)
