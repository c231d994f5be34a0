"""Pictures of outlined shapes on plain backgrounds, with captions: a plan as a table, then the pixels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.imaging import hex_colours, whole
from loomline.functions.pixels import encode
from loomline.operators.ordering import drawn_number

SHAPES = ("square", "triangle", "circle", "parallel lines", "rectangle", "pentagon", "star")
#: Names and values of the colours of lines and backgrounds.
COLOURS = {"white": "#FFFFFF", "black": "#000000", "red": "#FF0000", "green": "#00FF00", "blue": "#0000FF", "gray": "#808080"}
#: Line widths in thousandths of the side; up to the first bound a line is thin, up to the second normal, else thick.
WIDTHS, THIN, NORMAL = (20, 150), 55, 90


def shape_plan(rows: DataFrame, identity: Column, seed: int = 0) -> DataFrame:
    """The rows with shape, colour, background, width, rotation and caption, drawn by the identity and the seed.

    A background never has the colour of the line. Rows of one identity get one
    picture; order and partitions change nothing.
    """

    def one(name: str, count: int) -> Column:
        return (drawn_number(identity, F.lit(name), seed=seed) % count).cast("int")

    names = F.array(*[F.lit(c) for c in COLOURS])
    ink = one("colour", len(COLOURS))
    paper = (ink + 1 + one("background", len(COLOURS) - 1)) % len(COLOURS)
    low, high = WIDTHS
    made = rows.withColumns({"shape": F.array(*[F.lit(s) for s in SHAPES])[one("shape", len(SHAPES))], "colour": names[ink], "background": names[paper], "width": one("width", high - low + 1) + low, "rotation": one("rotation", 4) * 90})
    line = F.when(F.col("width") <= THIN, "thin").when(F.col("width") <= NORMAL, "normal").otherwise("thick")
    values = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    caption = F.concat("colour", F.lit(" "), "shape", F.lit(", "), line, F.lit(" line, "), "background", F.lit(" background, "), values[F.col("background")], F.lit(" background"))
    return made.withColumn("caption", caption)


def _corners(shape: str) -> list[np.ndarray]:
    """Closed or open lines of a shape in a square from 0 to 1, a tenth away from its edges."""
    around = lambda n, radius: np.array([(0.5 + r * np.cos(t), 0.5 + r * np.sin(t)) for t, r in zip(2 * np.pi * np.arange(n) / n - np.pi / 2, np.resize(radius, n), strict=True)])
    closed = lambda p: np.vstack([p, p[:1]])
    lines = {
        "square": [closed(np.array([(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9)]))],
        "rectangle": [closed(np.array([(0.1, 0.25), (0.9, 0.25), (0.9, 0.75), (0.1, 0.75)]))],
        "triangle": [closed(np.array([(0.5, 0.1), (0.9, 0.9), (0.1, 0.9)]))],
        "parallel lines": [np.array([(0.1, y), (0.9, y)]) for y in (1 / 3, 2 / 3)],
        "pentagon": [closed(around(5, [0.4]))],
        "star": [closed(around(10, [0.4, 0.16]))],
    }
    return lines.get(shape, [])


@lru_cache(32)
def distance(shape: str, side: int) -> np.ndarray:
    """How far the middle of each pixel is from a shape's line, in sides."""
    at = (np.arange(side) + 0.5) / side
    x, y = np.meshgrid(at, at)
    if shape == "circle":
        return abs(np.hypot(x - 0.5, y - 0.5) - 0.4)
    out = np.full((side, side), np.inf)
    for line in _corners(shape):
        for (ax, ay), (bx, by) in zip(line[:-1], line[1:], strict=True):
            dx, dy = bx - ax, by - ay
            t = np.clip(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0, 1)
            out = np.minimum(out, np.hypot(x - ax - t * dx, y - ay - t * dy))
    return out


def picture(shape: str, colour: str, background: str, width: int, rotation: int, side: int) -> np.ndarray:
    """An RGB square; a line's edge is softened over one pixel."""
    ink, paper = (np.array(c, float) for c in hex_colours([COLOURS[colour], COLOURS[background]]))
    share = np.clip((width / 2000 - distance(shape, side)) * side + 0.5, 0, 1)[:, :, None]
    return np.rot90(whole(paper + (ink - paper) * share), rotation // 90)


def drawn_shapes(planned: DataFrame, side: int) -> DataFrame:
    """The plan's rows with content, a PNG of ``side`` pixels a side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = batch[["shape", "colour", "background", "width", "rotation"]].itertuples(index=False)
            yield batch.assign(content=[encode(np.ascontiguousarray(picture(*row, side))) for row in columns])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in planned.schema)
    return planned.mapInPandas(run, f"{kept}, content binary")
