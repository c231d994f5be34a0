"""Boxes as structs of x, y, w, h, score and src."""

from __future__ import annotations

import math
import statistics
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    side = lambda p, s: F.greatest(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]), F.lit(0))
    both = side("x", "w") * side("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def expand(box: Column, share: float, width: Column, height: Column) -> Column:
    """A box grown on all sides by a share of its own, inside the image."""
    dx, dy = F.floor(box["w"] * share), F.floor(box["h"] * share)
    x, y = F.greatest(box["x"] - dx, F.lit(0)), F.greatest(box["y"] - dy, F.lit(0))
    return F.struct(x.alias("x"), y.alias("y"), (F.least(box["x"] + box["w"] + dx, width) - x).alias("w"), (F.least(box["y"] + box["h"] + dy, height) - y).alias("h"))


def suppressed(boxes: Column, threshold: float) -> Column:
    """Non-maximum suppression inside a row: boxes by score and area, those that overlap a kept one go."""
    ranked = F.reverse(F.array_sort(F.transform(boxes, lambda b: F.struct(b["score"].alias("score"), (b["w"] * b["h"]).alias("area"), b.alias("b")))))
    start = F.slice(F.transform(ranked, lambda r: r["b"]), 1, 0)
    return F.aggregate(F.transform(ranked, lambda r: r["b"]), start, lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) > threshold), kept).otherwise(F.concat(kept, F.array(b))))


def top(boxes: Column, k: int) -> Column:
    """The k boxes with the highest score, then area."""
    ranked = F.reverse(F.array_sort(F.transform(boxes, lambda b: F.struct(b["score"].alias("score"), (b["w"] * b["h"]).alias("area"), b.alias("b")))))
    return F.transform(F.slice(ranked, 1, k), lambda r: r["b"])


def faces(boxes: Column, width: Column, height: Column, least_share: float, aspect: tuple[float, float], threshold: float, k: int) -> Column:
    """Boxes of enough of the image and a sound aspect, suppressed, the best k."""
    fit = F.filter(boxes, lambda b: (b["w"] * b["h"] >= least_share * width * height) & (b["w"] / F.nullif(b["h"], F.lit(0))).between(*aspect))
    return top(suppressed(fit, threshold), k)


def agreement(rows: DataFrame, threshold: float, detectors: int) -> DataFrame:
    """path, x, y, w, h, votes: boxes on which enough detectors agree.

    Rows are (path, x, y, w, h, score, src). Per image, boxes by falling score
    join the first group whose median box they overlap; a group counts with
    enough different detectors. An image's boxes are a row; a call of Python
    takes many images.
    """
    numbers = ("x", "y", "w", "h", "score")
    schema = pa.schema([("path", pa.string()), *((c, pa.float64()) for c in "xywh"), ("votes", pa.int64())])

    def kept(path: str | None, boxes: list[tuple]) -> Iterator[tuple]:
        groups: list[list[tuple]] = []
        for x, y, w, h, _, src in sorted(boxes, key=lambda b: tuple((v is None or v != v, v if v is not None and v == v else 0) for v in (-b[4], b[5] or "", b[0], b[1]))):
            for g in groups:
                gx, gy, gw, gh = _middle_box(g)
                both = max(0, min(gx + gw, x + w) - max(gx, x)) * max(0, min(gy + gh, y + h) - max(gy, y))
                if both > 0 and both / (gw * gh + w * h - both) >= threshold:
                    g.append((x, y, w, h, src))
                    break
            else:
                groups.append([(x, y, w, h, src)])
        for g in groups:
            if (votes := len({b[4] for b in g})) >= detectors:
                yield (path, *_middle_box(g), votes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("boxes")
            columns = [c.to_pylist() for c in lists.flatten().flatten()]
            boxes = zip(*([math.nan if v is None else v for v in c] for c in columns[:5]), columns[5], strict=True)
            found = [row for path, n in zip(batch.column("path").to_pylist(), lists.value_lengths().to_pylist(), strict=True) for row in kept(path, list(islice(boxes, n)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema=schema)

    boxes = F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in numbers], F.col("src").cast("string").alias("src")))
    return rows.groupBy("path").agg(boxes.alias("boxes")).mapInArrow(run, "path string, x double, y double, w double, h double, votes long")


def _middle_box(group: list[tuple]) -> list[float]:
    return [math.nan if any(v != v for v in side) else statistics.median(side) for side in list(zip(*group, strict=True))[:4]]


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 text, in hexadecimal."""

    @F.pandas_udf("string")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in values:
            out = []
            for v in batch:
                if v is None:
                    out.append(None)
                    continue
                h = 2166136261
                for b in v.encode():
                    h = (h ^ b) * 16777619 & 0xFFFFFFFF
                out.append(f"{h:08x}")
            yield pd.Series(out, dtype=object)

    return run(text)
