"""Distances between arrays of doubles: native higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def intersection(a: Column, b: Column) -> Column:
    """Sum of the smaller values: the histogram intersection."""
    return _sum(F.zip_with(a, b, lambda x, y: F.least(x, y)))


def chi_squared(a: Column, b: Column) -> Column:
    """Half the sum of squared differences over sums; empty places count nothing."""
    return _sum(F.zip_with(a, b, lambda x, y: F.when(x + y != 0, (x - y) * (x - y) / (x + y)).otherwise(0.0))) / 2


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation; null where a side is constant."""
    n = F.size(a)
    ma, mb = _sum(a) / n, _sum(b) / n
    both = F.zip_with(a, b, lambda x, y: F.struct((x - ma).alias("x"), (y - mb).alias("y")))
    total = lambda f: _sum(F.transform(both, f))
    spread = F.sqrt(total(lambda p: p["x"] * p["x"]) * total(lambda p: p["y"] * p["y"]))
    return F.when(spread > 0, total(lambda p: p["x"] * p["y"]) / spread)


def normalise(histogram: Column) -> Column:
    """Shares of the total; an empty histogram stays as it is."""
    total = _sum(histogram)
    return F.transform(histogram, lambda x: x / F.when(total == 0, 1.0).otherwise(total))
