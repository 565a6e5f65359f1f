"""Histogram arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(lo: float, hi: float, n: int) -> Column:
    """n + 1 evenly spaced edges."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.lit(float(lo)) + i * (float(hi) - float(lo)) / n)


def bin_index(v: Column, lo, hi, n: int) -> Column:
    """0 to n - 1; the last bin has its right edge; null outside."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return F.when(v.between(lo, hi), F.least(F.floor((v - lo) * n / (hi - lo)), F.lit(n - 1)).cast("int"))


def adaptive_range(lo: float, hi: float, least: Column, most: Column) -> tuple[Column, Column]:
    """The settings' range, widened to the data; never empty."""
    low, high = F.least(F.lit(float(lo)), least), F.greatest(F.lit(float(hi)), most)
    return low, F.when(high <= low, low + 1).otherwise(high)


def inside_bin(target: Column, before: Column, n: Column, left: Column, width: Column, empty: str = "middle") -> Column:
    """A quantile within its bin: linear between the edges, clamped; an empty bin gives its middle or
    its left edge."""
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (target - before) / n))
    return F.when(n <= 0, left + width / 2 if empty == "middle" else left).otherwise(left + width * part)
