"""Sizes and rectangles: native arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shrink_to_area(width: Column, height: Column, side: int) -> Column:
    """width, height scaled so that the area is at most ``side`` squared; fractions are cut off."""
    ratio = F.least(F.lit(1.0), F.sqrt(F.lit(float(side * side)) / (width.cast("double") * height)))
    return F.struct((width * ratio).cast("int").alias("width"), (height * ratio).cast("int").alias("height"))


def long_side(width: Column, height: Column, target: int) -> Column:
    """width, height scaled to a longer side of ``target``; halves round to even."""
    ratio = F.lit(float(target)) / F.greatest(width, height)
    return F.struct(F.bround(width * ratio, 0).cast("int").alias("width"), F.bround(height * ratio, 0).cast("int").alias("height"))


def scale_within(width: Column, height: Column, least: int | None, most: int | None) -> Column:
    """The factor that brings the shorter side to ``least`` at least and the longer to ``most`` at most; null where both cannot be."""
    up = F.greatest(F.lit(1.0), F.lit(float(least)) / F.least(width, height)) if least else F.lit(1.0)
    cap = F.lit(float(most)) / F.greatest(width, height) if most else F.lit(float("inf"))
    need = F.lit(float(least)) / F.least(width, height) if least else F.lit(0.0)
    return F.when(need <= cap, F.least(up, cap))


def distribute(total: Column, parts: int) -> Column:
    """A whole number as ``parts`` whole numbers that differ by one at most, larger ones first."""
    each, rest = F.floor(total / parts), total % parts
    return F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda k: (each + F.when(k <= rest, 1).otherwise(0)).cast("int"))


def grid(width: Column, height: Column, columns: int, rows: int) -> Column:
    """The cells (row, column, x, y, w, h) of an even grid; explode for a row per cell."""
    def spans(total, parts):
        sizes = distribute(total, parts)
        return F.transform(sizes, lambda s, k: F.struct(F.aggregate(F.slice(sizes, 1, k), F.lit(0), lambda a, x: a + x).alias("at"), s.alias("size"), k.alias("k")))

    return F.flatten(F.transform(spans(height, rows), lambda r: F.transform(spans(width, columns), lambda c: F.struct(r["k"].alias("row"), c["k"].alias("column"), c["at"].alias("x"), r["at"].alias("y"), c["size"].alias("w"), r["size"].alias("h")))))


def largest_in_rotated(width: Column, height: Column, degrees: Column) -> Column:
    """width, height of the largest upright rectangle inside one rotated by an angle."""
    s, c = F.abs(F.sin(F.radians(degrees))), F.abs(F.cos(F.radians(degrees)))
    long, short = F.greatest(width, height), F.least(width, height)
    half = F.lit(0.5) * short
    tight = (short <= 2 * s * c * long) | (F.abs(s - c) < 1e-10)
    wide = width >= height
    by = lambda x, d: F.when(d.cast("double") == 0, F.lit(None)).otherwise(x / d)
    cos2 = c * c - s * s
    w = F.when(tight, F.when(wide, F.coalesce(by(half, s), width)).otherwise(F.coalesce(by(half, c), width))).otherwise((width * c - height * s) / F.nullif(cos2, F.lit(0.0)))
    h = F.when(tight, F.when(wide, F.coalesce(by(half, c), height)).otherwise(F.coalesce(by(half, s), height))).otherwise((height * c - width * s) / F.nullif(cos2, F.lit(0.0)))
    return F.struct(w.alias("width"), h.alias("height"))


def bell_weights(n: int, centre: float, sigma: float) -> Column:
    """n shares of 1 in the shape of a bell."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.exp(F.lit(-0.5) * F.pow((k - F.lit(centre)) / F.lit(sigma), F.lit(2.0))))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def linear(value: Column, low: float, high: float) -> Column:
    """A value's place between two bounds, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.lit(high - low)))
