"""Zonal statistics of pixels: partials for each tile, merged measures, histograms, quantiles, covers.

``pixels`` needs columns ``v`` (value), ``valid`` (boolean) and ``area`` (of a pixel); ``keys`` name the
tile or zone. All are one shuffle of partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hist, text

QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def _when(c: Column) -> Column:
    return F.when(F.col("valid"), c)


def hits(threshold: float) -> str:
    return "n_ge_" + f"{threshold:g}".replace(".", "_")


def tile_partials(pixels: DataFrame, keys: list[str], thresholds: tuple[float, ...] = ()) -> DataFrame:
    """Counts, sums, extremes, areas and threshold hits; of a tile without valid pixels the extremes
    are null, which a merge skips."""
    v = F.col("v")
    return pixels.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if("valid").alias("n"),
        F.coalesce(F.sum(_when(v)), F.lit(0)).alias("s"),
        F.coalesce(F.sum(_when(v * v)), F.lit(0)).alias("s2"),
        F.min(_when(v)).alias("lo"),
        F.max(_when(v)).alias("hi"),
        F.coalesce(F.sum(_when(F.col("area"))), F.lit(0)).alias("valid_area"),
        F.sum("area").alias("total_area"),
        F.coalesce(F.sum(_when(v * F.col("area"))), F.lit(0)).alias("volume"),
        *[F.count_if(F.col("valid") & (v >= t)).alias(hits(t)) for t in thresholds],
    )


def merge_partials(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Partials of a coarser key from those of a finer one."""
    sums = [c for c in partials.columns if c not in (*keys, "lo", "hi") and (c in ("total", "n", "s", "s2", "valid_area", "total_area", "volume") or c.startswith("n_ge_"))]
    return partials.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def moments(n: Column, s: Column, s2: Column) -> dict[str, Column]:
    """Mean, population variance from the moments (never negative), deviation, coefficient of variation.
    Without pixels the mean is null, and the others are 0."""
    mean = F.try_divide(s, n)
    variance = F.greatest(F.lit(0.0), F.try_divide(s2, n) - mean * mean)
    return {"mean": mean, "variance": variance, "stddev": F.sqrt(variance), "cv": F.when(mean > 0, F.sqrt(variance) / mean).otherwise(0.0)}


def histogram(pixels: DataFrame, keys: list[str], lo: float, hi: float, bins: int) -> DataFrame:
    """keys, bin, n of the valid pixels inside the range; empty bins have no row."""
    return pixels.where("valid").withColumn("bin", hist.bin_index(F.col("v"), lo, hi, bins)).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def adaptive_histogram(pixels: DataFrame, keys: list[str], lo: float, hi: float, bins: int) -> DataFrame:
    """As histogram, over each key's range widened to its data."""
    low, high = hist.adaptive_range(lo, hi, F.min("v").cast("double"), F.max("v").cast("double"))
    ranges = pixels.where("valid").groupBy(*keys).agg(low.alias("range_lo"), high.alias("range_hi"))
    both = pixels.where("valid").join(ranges, keys)
    return both.withColumn("bin", hist.bin_index(F.col("v"), F.col("range_lo"), F.col("range_hi"), bins)).groupBy(*keys, "range_lo", "range_hi", "bin").agg(F.count("*").alias("n"))


def histogram_quantiles(histogram: DataFrame, keys: list[str], lo: float, hi: float, bins: int, quantiles: tuple[float, ...] = QUANTILES, empty: str = "middle") -> DataFrame:
    """p10, p25, ...: the first bin whose running count reaches the share, and the place within it.
    The window's groups are bins, not pixels."""
    by = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    runs = histogram.withColumn("upto", F.sum("n").over(by)).withColumn("all", F.sum("n").over(whole))
    width = (hi - lo) / bins
    out = []
    for q in quantiles:
        target = F.lit(q) * F.col("all")
        place = hist.inside_bin(target, F.col("upto") - F.col("n"), F.col("n"), F.lit(float(lo)) + F.col("bin") * (float(hi) - float(lo)) / bins, F.lit(width), empty)
        out.append(F.min_by(place, F.when(F.col("upto") >= target, F.col("bin"))).alias(f"p{round(100 * q)}"))
    return runs.groupBy(*keys).agg(*out)


def exact_quantiles(pixels: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Linear interpolation between order statistics. Counts of different values are shuffled, not pixels."""
    counts = pixels.where("valid").groupBy(*keys, "v").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(*[F.percentile("v", F.lit(q), F.col("n")).alias(f"p{round(100 * q)}") for q in quantiles])


def threshold_cover(partials: DataFrame, keys: list[str], thresholds: tuple[float, ...]) -> DataFrame:
    """A row for each key and threshold: pixels at or above it, their share of the valid ones and area."""
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(hits(t)).alias("hits")) for t in thresholds]))
    ratio = F.when(F.col("n") > 0, F.col("x.hits") / F.col("n")).otherwise(0.0)
    return partials.withColumn("x", rows).select(*keys, "x.threshold", "x.hits", ratio.alias("ratio"), (100 * ratio).alias("percent"), (F.col("valid_area") * ratio).alias("area"))


def range_cover(cover: DataFrame, partials: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint ranges from the cover by thresholds: below the first, between neighbours, from the last."""
    by = Window.partitionBy(*keys).orderBy("threshold")
    ranges = cover.select(*keys, "threshold", "hits").withColumn("upper", F.lead("threshold").over(by)).withColumn("above", F.lead("hits").over(by)).withColumn("i", F.row_number().over(by))
    inner = ranges.select(*keys, F.col("threshold").alias("lower"), "upper", (F.col("hits") - F.coalesce("above", F.lit(0))).alias("hits"))
    below = ranges.where("i = 1").join(partials.select(*keys, "n"), keys).select(*keys, F.lit(None).cast("double").alias("lower"), F.col("threshold").alias("upper"), (F.col("n") - F.col("hits")).alias("hits"))
    return inner.unionByName(below).withColumn("label", text.range_label(F.col("lower"), F.col("upper"))).withColumn("hits", F.greatest(F.lit(0), F.col("hits")))


def zonal_summary(pixels: DataFrame, keys: list[str], thresholds: tuple[float, ...] = (5, 10, 20), lo: float = 0.0, hi: float = 120.0, bins: int = 512) -> DataFrame:
    """One row a zone: counts, extremes, moments, histogram quantiles, covers, areas and volume.

    The pixels are read once and aggregated by zone and bin, so that no more than bins + 1 rows a zone
    and task are shuffled whatever the values are; everything else comes from those rows.
    """
    bin_ = F.when(F.col("valid"), hist.bin_index(F.col("v"), lo, hi, bins))
    parts = tile_partials(pixels.withColumn("bin", bin_), [*keys, "bin"], thresholds)
    whole = merge_partials(parts, keys)
    quantiles = histogram_quantiles(parts.where("bin is not null").select(*keys, "bin", "n"), keys, lo, hi, bins)
    m = moments(F.col("n"), F.col("s"), F.col("s2"))
    out = whole.join(quantiles, keys, "left")
    return out.select(*keys, "total", "n", "lo", "hi", *[c.alias(k) for k, c in m.items()], *[f"p{round(100 * q)}" for q in QUANTILES], (F.col("p75") - F.col("p25")).alias("iqr"), "valid_area", "total_area", "volume", (F.col("n") / F.col("total")).alias("coverage"), *[F.try_divide(F.col(hits(t)), F.col("n")).alias(hits(t).replace("n_ge", "cover")) for t in thresholds])


def weighted_histogram(pixels: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Whole-number bins 0 to bins - 1: weight by pixel area, and the volume in cubic kilometres."""
    b = F.floor("v").cast("int")
    return pixels.where("valid").where(b.between(0, bins - 1)).groupBy(*keys, b.alias("bin")).agg(F.sum("area").alias("weight"), (F.sum(F.col("v") * F.col("area")) / 1e9).alias("volume_km3"))


def coverage(partials: DataFrame, keys: list[str], window: Column) -> DataFrame:
    """Share of valid pixels: of the area of interest, and of the whole bounding window."""
    return partials.select(*keys, (F.col("n") / F.col("total")).alias("of_aoi"), (F.col("n") / window).alias("of_window"))


def yearly_mean(cells: DataFrame, year: str, value: Column) -> DataFrame:
    return cells.groupBy(year).agg(F.sum(value).alias("s"), F.count("*").alias("n")).select(year, (F.col("s") / F.col("n")).alias("mean"))
