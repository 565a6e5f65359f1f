"""Pixel values and validity from tile bands. What one pixel means depends on its whole tile, so the
flags of the tile come as columns (operators.tiles.tile_flags)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the tile formats: metres a step of the red channel, luminance weights, not-a-value.
RED_STEP = 0.4
LUMINANCE = (0.2126, 0.7152, 0.0722)
CLASS_NODATA = -32768


def packed(r: Column, g: Column) -> Column:
    return F.shiftleft(r.cast("int"), 8) + g.cast("int")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return sum((c.cast("double") * w for c, w in zip((g, b), LUMINANCE[1:], strict=True)), r.cast("double") * LUMINANCE[0]).cast("float")


def height(r: Column, g: Column, b: Column, blue_zero: Column, green_zero: Column, p95: Column) -> Column:
    """Metres as float: red steps, packed decimetres, plain red, or luminance, as the tile's flags say."""
    return F.when(blue_zero & green_zero, (r.cast("float") * F.lit(RED_STEP).cast("float")).cast("float")).when(blue_zero & (p95 > 255), (packed(r, g).cast("float") / F.lit(10).cast("float")).cast("float")).when(blue_zero, r.cast("float")).otherwise(luminance(r, g, b))


def biomass(r: Column, g: Column, b: Column, blue_zero: Column, green_zero: Column, p95: Column) -> Column:
    """As height, without steps: red, packed, red, or luminance."""
    return F.when(blue_zero & green_zero, r.cast("float")).when(blue_zero & (p95 > 255), packed(r, g).cast("float")).when(blue_zero, r.cast("float")).otherwise(luminance(r, g, b))


def class_id(bands: Column, b0: Column, encoded: Column) -> Column:
    """The class of a pixel: the first band of one- and two-band tiles and of class-encoded colour
    tiles; null in true colour tiles."""
    return F.when(bands <= 2, b0.cast("int")).when(encoded, b0.cast("int"))


def class_valid(bands: Column, b0: Column, b1: Column, b2: Column, b3: Column, class_: Column) -> Column:
    """Alpha of four bands; else class above 0; else any band not 0. Two-band alpha does not count."""
    return F.when(bands >= 4, b3 > 0).when(class_.isNotNull(), class_ > 0).when(bands == 1, b0 > 0).otherwise((b0 != 0) | (b1 != 0) | (b2 != 0))


def value_valid(bands: Column, b1: Column, b3: Column) -> Column:
    """The second band of two, the fourth of four; all of one or three."""
    return F.when(bands == 2, b1 > 0).when(bands >= 4, b3 > 0).otherwise(F.lit(True))


def in_range(v: Column, lo: float, hi: float) -> Column:
    return v.isNotNull() & ~F.isnan(v.cast("double")) & v.between(lo, hi)


def close_to(v: Column, other: Column) -> Column:
    """numpy's isclose with its default tolerances; null is close to nothing."""
    return F.coalesce(F.abs(v - other) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(other), F.lit(False))


def biomass_valid(raw: Column, scale: Column, nodata: Column, compat_nodata: bool = False) -> Column:
    """Finite, not nodata and not negative. nodata is compared before scaling; with compat_nodata the
    scaled value is compared with the unscaled nodata."""
    v = raw / scale
    return raw.isNotNull() & ~F.isnan(raw.cast("double")) & ~close_to(v if compat_nodata else raw, nodata) & (v >= 0)


def band_valid(v: Column, nodata: Column, floating: bool) -> Column:
    return (v.isNotNull() & ~F.isnan(v.cast("double")) & ~close_to(v, nodata)) if floating else (v.isNotNull() & F.coalesce(v != nodata, F.lit(True)))


def scale_factor(tags: Iterable[Column], default: float = 10.0) -> Column:
    """The first tag that is a number above 0."""
    numbers = [F.expr("null").cast("double")]
    for t in tags:
        n = t.try_cast("double")
        numbers.append(F.when(n > 0, n))
    return F.coalesce(*numbers, F.lit(default))


def default_nodata(declared: Column, dtype: Column) -> Column:
    """Declared, else the greatest value of an integer type, else -9999."""
    greatest = F.when(dtype == "uint8", 255.0).when(dtype == "int16", 32767.0).when(dtype == "uint16", 65535.0).when(dtype == "int32", 2147483647.0).when(dtype == "uint32", 4294967295.0)
    return F.coalesce(declared, greatest, F.lit(-9999.0))


def to_rgb(bands: Column, b0: Column, b1: Column, b2: Column) -> Column:
    """Grey is repeated, alpha is dropped."""
    grey = bands <= 2
    return F.struct(b0.alias("r"), F.when(grey, b0).otherwise(b1).alias("g"), F.when(grey, b0).otherwise(b2).alias("b"))


def clean_density(v: Column) -> Column:
    """Negative, missing and not-a-number become 0, and so enter a mean."""
    return F.when((v >= 0) & ~F.isnan(v.cast("double")), v).otherwise(F.lit(0).cast("double"))
