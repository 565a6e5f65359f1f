"""Coordinates, map tiles and pixel grids as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere of EPSG:3857 and the latitude at which its square ends.
RADIUS = 6378137.0
MAX_LATITUDE = 85.0511287798066
CIRCUMFERENCE = 2 * math.pi * RADIUS
#: WGS 84, for UTM.
A, FLATTENING, K0 = 6378137.0, 1 / 298.257223563, 0.9996


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.lit(RADIUS) * F.radians(lon), F.lit(RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """326xx north, 327xx south of the equator, of the zone that holds the longitude."""
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    return F.when(lat >= 0, F.lit(32600) + zone).otherwise(F.lit(32700) + zone)


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in the zone of utm_epsg, by the Krueger series to third order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    middle = (F.floor((lon + 180) / 6) * 6 - 177).cast("double")
    e = 2 * math.sqrt(n) / (1 + n)
    sin = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin) - e * F.atanh(e * sin))
    d = F.radians(lon - middle)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + K0 * radius * east, F.when(lat < 0, 10000000.0).otherwise(0.0) + K0 * radius * north


def tile_side(z: Column) -> Column:
    return F.lit(CIRCUMFERENCE) / F.pow(F.lit(2.0), z)


def tile_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    side = tile_side(z)
    left, top = x * side - CIRCUMFERENCE / 2, F.lit(CIRCUMFERENCE / 2) - y * side
    return {"left": left, "right": left + side, "top": top, "bottom": top - side}


def pixel_area_ha(z: Column, width: Column, height: Column) -> Column:
    """Planar area of a pixel in EPSG:3857; not the area on the ground."""
    return F.abs(tile_side(z) / width * (tile_side(z) / height)) / 10000.0


def pixel_centre(left: Column, top: Column, width: Column, height: Column, row: Column, col: Column) -> tuple[Column, Column]:
    """width, height: of a pixel."""
    return left + (col + 0.5) * width, top - (row + 0.5) * height


def tile_column(lon: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return F.greatest(F.lit(0.0), F.least(n - 1, F.floor((lon + 180.0) / 360.0 * n))).cast("int")


def tile_row(lat: Column, z: Column) -> Column:
    """Latitudes beyond the square are clamped."""
    n = F.pow(F.lit(2.0), z)
    bounded = F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat)))
    return F.greatest(F.lit(0.0), F.least(n - 1, F.floor((1 - F.log(F.tan(bounded) + 1 / F.cos(bounded)) / math.pi) / 2 * n))).cast("int")


def quadkey(z: Column, x: Column, y: Column) -> Column:
    """One digit 0 to 3 a level, the coarsest first."""
    bit = lambda v, i: F.call_function("shiftright", v.cast("int"), (z - i).cast("int")).bitwiseAND(F.lit(1))
    digits = F.transform(F.sequence(F.lit(1), z.cast("int")), lambda i: (bit(x, i) + 2 * bit(y, i)).cast("string"))
    return F.when(z < 1, F.lit("")).otherwise(F.array_join(digits, ""))


def overview_levels(width: Column, height: Column) -> Column:
    """Of 2, 4, 8, 16, 32 those by which the shorter side can be divided; 2 where none can."""
    fits = F.filter(F.array(*[F.lit(x) for x in (2, 4, 8, 16, 32)]), lambda x: F.least(width, height) >= x)
    return F.when(F.size(fits) > 0, fits).otherwise(F.array(F.lit(2)))


def square_rule(width_m: Column, height_m: Column, side_km: float = 30.0) -> Column:
    """The first rule that an area of interest breaks: too large, not square; null if none."""
    w, h = width_m / 1000, height_m / 1000
    return F.when((w > side_km) | (h > side_km), "too large").when(F.abs(w - h) > max(0.5, 0.1 * side_km), "not square")


def covers_extent(aoi: dict[str, Column], raster: dict[str, Column], px: Column, py: Column) -> Column:
    """Whether the raster covers the area but for two pixels (at least two metres)."""
    slack = 2 * F.greatest(px, py, F.lit(1.0))
    return (raster["left"] <= aoi["left"] + slack) & (raster["right"] >= aoi["right"] - slack) & (raster["bottom"] <= aoi["bottom"] + slack) & (raster["top"] >= aoi["top"] - slack)
