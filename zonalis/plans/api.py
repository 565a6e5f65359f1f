"""Whole requests: an area of interest, pixels and settings in, a result record out.

Measures come from one DataFrame plan as one row; errors for empty areas and the rounding of results
are done on that row.
"""

from __future__ import annotations

import json
import math
import os
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode, geo, hist
from ..operators import change, polygon, tiles, zonal
from ..sources import frames as files
from ..sources.pmtiles import TYPES


class RequestError(ValueError):
    pass


class ResourceError(RequestError, TimeoutError):
    """A request that ran out of time or memory."""


@dataclass(frozen=True)
class Settings:
    """Defaults of the service's limits and histograms."""

    height_range: tuple[float, float] = (0.0, 120.0)
    biomass_range: tuple[float, float] = (0.0, 300.0)
    bins: int = 512
    height_thresholds: tuple[float, ...] = (5.0, 10.0, 20.0)
    biomass_thresholds: tuple[float, ...] = (50.0, 100.0, 150.0)
    max_thresholds: int = 10
    max_payload_bytes: int = 1_000_000
    max_area_km2: float = 1600.0
    max_vertices: int = 50_000
    max_tiles: int = 256
    crop_tiles: int = 16
    square_side_km: float = 30.0
    forest: tuple[int, ...] = (3, 5, 76)
    retries: int = 5
    base_delay: float = 0.5
    max_delay: float = 8.0
    request_timeout: float = 240.0
    extra: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Aoi:
    """An area of interest: edges in lon/lat and EPSG:3857, and its planar area."""

    vertices: DataFrame
    edges: DataFrame
    area_ha: float
    bounds: tuple[float, float, float, float]


def thresholds(custom: list[float] | None, defaults: tuple[float, ...], most: int) -> tuple[float, ...]:
    out = tuple(sorted({float(x) for x in (custom or defaults) if x > 0}))
    if not out:
        raise RequestError("no threshold is above 0")
    if len(out) > most:
        raise RequestError(f"more than {most} thresholds")
    return out


def geometry_types(value: object) -> set[str]:
    """Types of all geometries of a GeoJSON object, those in collections included."""
    if not isinstance(value, dict):
        return set()
    kind = value.get("type")
    if kind == "FeatureCollection":
        return set().union(*(geometry_types(f) for f in value.get("features") or []))
    if kind == "Feature":
        return geometry_types(value.get("geometry"))
    if kind == "GeometryCollection":
        return {kind}.union(*(geometry_types(g) for g in value.get("geometries") or []))
    return {str(kind)}


def aoi(spark: SparkSession, geojson: dict | str, settings: Settings = Settings(), square: bool = False, boundary: DataFrame | None = None, collection: bool = False) -> Aoi:
    """Parse and check an area: payload size, type, crossings, bounds, vertices, area, and on demand the
    square rule, that it meets a boundary (edges in lon/lat), and that it comes as a FeatureCollection. An area
    that holds anything but polygons is refused, as a whole."""
    text = geojson if isinstance(geojson, str) else json.dumps(geojson)
    if len(text.encode()) > settings.max_payload_bytes:
        raise RequestError("payload too large")
    try:
        body = json.loads(text)
    except ValueError as e:
        raise RequestError("not JSON") from e
    if collection and not (isinstance(body, dict) and body.get("type") == "FeatureCollection"):
        raise RequestError("not a FeatureCollection")
    if not (kinds := geometry_types(body)) or kinds - {"Polygon", "MultiPolygon"}:
        raise RequestError("type")
    rows = spark.createDataFrame([("aoi", text)], "id string, json string")
    vertices = polygon.parse_geojson(rows, "json").cache()
    box = polygon.bounds(vertices).first()
    if box is None:
        raise RequestError("type")
    lonlat = polygon.edges(vertices)
    x, y = geo.to_mercator(F.col("x"), F.greatest(F.lit(-geo.MAX_LATITUDE), F.least(F.lit(geo.MAX_LATITUDE), F.col("y"))))
    metres = polygon.edges(vertices.withColumn("_x", x).withColumn("y", y).withColumn("x", F.col("_x")).drop("_x")).cache()
    if box.n_vertices > settings.max_vertices:
        raise RequestError("vertices")  # before the edges are compared
    area = polygon.slab_areas(metres).first()
    area_ha = (area.area if area else 0.0) / 10_000
    checked = spark.range(1).select(polygon.aoi_problem(F.lit("Polygon"), F.lit(area_ha > 0), F.lit(box.west), F.lit(box.south), F.lit(box.east), F.lit(box.north), F.lit(box.n_vertices), F.lit(area_ha / 100))).first()[0]
    if checked:
        raise RequestError(checked)
    if square:
        side = metres.agg(F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).first()
        broken = spark.range(1).select(geo.square_rule(F.lit(float(side[0])), F.lit(float(side[1])), settings.square_side_km)).first()[0]
        if broken:
            raise RequestError(broken)
    if boundary is not None:
        whole = polygon.intersecting_tiles(boundary, spark.createDataFrame([("aoi", box.west, box.south, box.east, box.north)], "tile string, west double, south double, east double, north double"))
        if whole.isEmpty():
            raise RequestError("outside the boundary")
    return Aoi(vertices, metres, area_ha, (box.west, box.south, box.east, box.north))


def tile_count(area: Aoi, zoom: int, settings: Settings = Settings()) -> int:
    """Tiles that cover the area's bounds; an error where there is none, or more than a request may read."""
    box = area.vertices.sparkSession.createDataFrame([area.bounds], "west double, south double, east double, north double")
    n = tiles.tile_cover(box.withColumn("id", F.lit(0)), F.lit(zoom)).count()
    if not n:
        raise RequestError("no tiles meet the area")
    if n > settings.max_tiles:
        raise RequestError(f"{n} tiles, more than {settings.max_tiles}")
    return n


def same_archives(base: dict, comp: dict) -> None:
    """Two years' archive headers can be compared: both hold PNG tiles."""
    kinds = [TYPES.get(h["tile_type"], "unknown") for h in (base, comp)]
    if kinds != ["png", "png"]:
        raise RequestError(f"tile types are {' and '.join(kinds)}, not png")


def tile_pixels(pixels: DataFrame, area: Aoi, zoom: int, tile_size: int = 256) -> DataFrame:
    """Pixels (z, x, y, row, col, ...) of a zoom whose centre is inside the area.

    The area's scanlines are made once on the zoom's whole pixel grid and cut at tile edges, and join on
    tile and row. The bounding box becomes a filter on z, x and y, which the tile source takes.
    """
    size = geo.CIRCUMFERENCE / 2**zoom / tile_size
    side = tile_size << zoom
    grid = area.edges.withColumn("id", F.col("part"))
    spans = polygon.scanlines(polygon.to_grid(grid, -geo.CIRCUMFERENCE / 2, geo.CIRCUMFERENCE / 2, size, size), side, side)
    cut = spans.withColumn("x", F.explode(F.sequence(F.floor(F.col("c0") / tile_size).cast("int"), F.floor((F.col("c1") - 1) / tile_size).cast("int"))))
    local = cut.select(
        "x", F.floor(F.col("row") / tile_size).cast("int").alias("y"), (F.col("row") % tile_size).alias("row"),
        F.greatest(F.lit(0), F.col("c0") - F.col("x") * tile_size).alias("c0"), F.least(F.lit(tile_size), F.col("c1") - F.col("x") * tile_size).alias("c1"),
    )
    gathered = local.groupBy("x", "y", "row").agg(F.collect_list(F.struct("c0", "c1")).alias("_spans"))
    box = area.edges.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    first = lambda v: max(0, min((1 << zoom) - 1, math.floor((v + geo.CIRCUMFERENCE / 2) / size / tile_size)))
    near = pixels.where((F.col("z") == zoom) & (F.col("x") >= first(box[0])) & (F.col("x") <= first(box[1])) & (F.col("y") >= first(-box[3])) & (F.col("y") <= first(-box[2])))
    return near.join(gathered, ["x", "y", "row"]).where(F.exists("_spans", lambda s: (F.col("col") >= s["c0"]) & (F.col("col") < s["c1"]))).drop("_spans")


def _n(x, digits: int = 4):
    return None if x is None else round(float(x), digits)


def _label(lower: float | None, upper: float | None) -> str:
    return "all" if lower is None and upper is None else f"<{upper:g}m" if lower is None else f">={lower:g}m" if upper is None else f"{lower:g}-{upper:g}m"


def canopy_stats(pixels: DataFrame, custom: list[float] | None = None, settings: Settings = Settings(), aoi_area_ha: float | None = None) -> dict:
    """Height statistics of pixels inside an area: v (metres), valid (of the source), area (hectares)."""
    at = thresholds(custom, settings.height_thresholds, settings.max_thresholds)
    lo, hi = settings.height_range
    own = pixels.withColumn("v", F.col("v").cast("double")).withColumn("valid", F.col("valid") & decode.in_range(F.col("v"), lo, hi)).withColumn("zone", F.lit(0))
    r = zonal.zonal_summary(own, ["zone"], at, lo, hi, settings.bins).first()
    if r is None or not r.total:
        raise RequestError("no coverage of the area")
    if not r.n:
        raise RequestError("no valid pixels in the area")
    ratios = [r[zonal.hits(t).replace("n_ge", "cover")] for t in at]
    counts = [round(x * r.n) for x in ratios]
    edges = [None, *at, None]
    ranges = [r.n - counts[0], *(a - b for a, b in zip(counts, [*counts[1:], 0], strict=True))]
    cover = lambda x: {"coverRatio": _n(x, 6), "coverPercent": _n(100 * x), "coverAreaHa": _n(r.valid_area * x)}
    return {
        "minHeightM": _n(r.lo), "maxHeightM": _n(r.hi), "meanHeightM": _n(r["mean"]), "medianHeightM": _n(r.p50), "stdDevHeightM": _n(r.stddev), "varianceHeightM2": _n(r.variance),
        **{f"p{p}HeightM": _n(r[f"p{p}"]) for p in (10, 25, 75, 90, 95)}, "interquartileRangeM": _n(r.p75 - r.p25), "coefficientOfVariation": _n(r.cv, 6),
        "totalCanopyVolumeProxyM3": _n(r.volume * 10_000), "analyzedAreaHa": _n(r.valid_area), "aoiAreaHa": _n(aoi_area_ha if aoi_area_ha is not None else r.total_area), "coverageFraction": _n(r.n / r.total, 6), "validPixelCount": r.n,
        "canopyCoverByThreshold": [{"thresholdM": _n(t), **cover(x)} for t, x in zip(at, ratios, strict=True)],
        "canopyCoverByRange": [{"lowerBoundM": _n(a), "upperBoundM": _n(b), "label": _label(a, b), **cover(max(0, k) / r.n)} for a, b, k in zip(edges[:-1], edges[1:], ranges, strict=True)],
        "metadata": {"histogramBins": settings.bins, "thresholdsM": ",".join(f"{t:g}" for t in at)},
    }


def biomass_stats(cells: DataFrame, aoi_area_ha: float, custom: list[float] | None = None, settings: Settings = Settings()) -> dict:
    """Biomass of two years over an area's cells: base and comp (null where not valid)."""
    at = thresholds(custom, settings.biomass_thresholds, settings.max_thresholds)
    base, comp = F.col("base").cast("double"), F.col("comp").cast("double")
    d = comp - base
    r = cells.agg(
        F.count("*").alias("total"), F.count("comp").alias("n"), F.count("base").alias("nb"), F.avg(comp).alias("mean"), F.avg(base).alias("base_mean"), F.var_pop(comp).alias("var"), F.min(comp).alias("lo"), F.max(comp).alias("hi"),
        F.percentile(comp, F.array(*map(F.lit, zonal.QUANTILES))).alias("q"), F.count(d).alias("common"), F.sum(F.greatest(d, F.lit(0.0))).alias("up"), F.sum(F.greatest(-d, F.lit(0.0))).alias("down"),
        F.count_if(d > 0).alias("n_up"), F.count_if(d < 0).alias("n_down"), *[F.count_if(comp >= t).alias(f"h{i}") for i, t in enumerate(at)],
    ).first()
    if not r.total:
        raise RequestError("no coverage of the area")
    if not r.n:
        raise RequestError("no valid pixels in the area")
    area, base_area = aoi_area_ha * r.n / r.total, aoi_area_ha * r.nb / r.total
    total, base_total = r["mean"] * area, (r.base_mean or 0.0) * base_area
    cell = aoi_area_ha * (r.common / r.total) / r.common if r.common else 0.0
    lo, hi = settings.biomass_range
    low, high = min(lo, r.lo), max(hi, r.hi)
    high = low + 1 if high <= low else high
    sd, net = math.sqrt(r["var"]), total - base_total
    p = dict(zip((10, 25, 50, 75, 90, 95), r.q, strict=True))
    sample = cells.where("comp is not null").where(hist.bin_index(comp, low, high, settings.bins).isNotNull()).count()
    return {
        "minAgbMgHa": _n(r.lo), "maxAgbMgHa": _n(r.hi), "meanAgbMgHa": _n(r["mean"]), "medianAgbMgHa": _n(p[50]), "stdDevAgbMgHa": _n(sd), "varianceAgbMgHa2": _n(r["var"]), **{f"p{k}AgbMgHa": _n(p[k]) for k in (10, 25, 75, 90, 95)},
        "interquartileRangeMgHa": _n(p[75] - p[25]), "coefficientOfVariation": _n(sd / r["mean"] if r["mean"] > 0 else 0.0, 6), "totalAgbMg": _n(total), "totalAgbMgHa": _n(total / area if area else 0.0), "baselineTotalAgbMg": _n(base_total), "comparisonTotalAgbMg": _n(total),
        "agbIncreaseMg": _n((r.up or 0.0) * cell), "agbDecreaseMg": _n((r.down or 0.0) * cell), "agbIncreaseAreaHa": _n(r.n_up * cell), "agbDecreaseAreaHa": _n(r.n_down * cell), "netChangeAgbMg": _n(net), "netChangeAgbMgHa": _n(net / area if area else 0.0),
        "netChangePercent": _n(100 * net / base_total if base_total > 0 else 0.0), "analyzedAreaHa": _n(area), "aoiAreaHa": _n(aoi_area_ha), "coverageFraction": _n(r.n / r.total, 6), "validPixelCount": r.n,
        "agbCoverByThreshold": [{"thresholdMgHa": _n(t), "coverRatio": _n(r[f"h{i}"] / r.n, 6), "coverPercent": _n(100 * r[f"h{i}"] / r.n), "coverAreaHa": _n(area * r[f"h{i}"] / r.n)} for i, t in enumerate(at)],
        "metadata": {"histogramBins": settings.bins, "histogramMinMgHa": _n(low), "histogramMaxMgHa": _n(high), "histogramSampleCount": sample, "thresholdsMgHa": ",".join(f"{t:g}" for t in at)},
    }


def landcover_change(pixels: DataFrame, aoi_area_ha: float | None = None, settings: Settings = Settings(), raster_window: int | None = None) -> dict:
    """Forest change of pixels with classes b and c, valid, and area (hectares). With raster_window (the
    number of pixels of the bounding window) areas are shares of the area of interest times
    valid / window, as for rasters; without it sums of pixel areas, as for tiles."""
    forest = list(settings.forest)
    r = change.forest_change(pixels, [], F.col("b").isin(forest), F.col("c").isin(forest), F.col("valid"), F.col("area")).first()
    if not r.total:
        raise RequestError("no coverage of the area")
    if not r.valid:
        raise RequestError("no valid pixels in the area")
    names = {"forestLossHa": "loss", "forestGainHa": "gain", "baselineForestHa": "base_forest", "comparisonForestHa": "comp_forest"}
    if raster_window:
        coverage = r.valid / raster_window
        analysed = (aoi_area_ha if aoi_area_ha is not None else r.total_area) * coverage
        areas = {k: analysed * r[v] / r.valid for k, v in names.items()}
    else:
        coverage, analysed = r.valid / r.total, r.valid_area
        areas = {k: r[f"{v}_area"] for k, v in names.items()}
    return {
        **{k: _n(v) for k, v in areas.items()}, "forestLossPct": _n(100 * areas["forestLossHa"] / analysed if analysed else 0.0), "forestGainPct": _n(100 * areas["forestGainHa"] / analysed if analysed else 0.0),
        "netForestChangeHa": _n(areas["comparisonForestHa"] - areas["baselineForestHa"]), "analyzedAreaHa": _n(analysed), "aoiAreaHa": _n(aoi_area_ha if aoi_area_ha is not None else r.total_area), "coverageFraction": _n(coverage, 6), "validPixelCount": r.valid,
    }


def with_retries(action: Callable[[], object], settings: Settings = Settings(), sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None):
    """The action's result; after each failure a growing pause with jitter, and the last error in the end."""
    rng = rng or random.Random()
    for k in range(1, settings.retries + 1):
        try:
            return action()
        except Exception as e:  # noqa: BLE001  every failure is retried
            if k == settings.retries:
                raise RequestError(f"failed after {k} attempts: {e}") from e
            delay = min(settings.max_delay, settings.base_delay * 2 ** (k - 1))
            sleep(delay + rng.uniform(0, min(0.25, 0.25 * delay)))


def tolerate(results: list[tuple[object, Exception | None]], all_needed: bool) -> list:
    """Results of tiles: any failure fails where all are needed; else one success is enough."""
    failed = [e for _, e in results if e is not None]
    if failed and (all_needed or len(failed) == len(results)):
        raise RequestError("tiles failed: " + "; ".join(map(str, failed[:3])))
    return [r for r, e in results if e is None]


def resident_mb() -> float:
    """Memory that this process holds."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


class Deadline:
    """Stops a request's Spark jobs after a time, beyond so many MB of the driver's memory, or on demand."""

    def __init__(self, spark: SparkSession, group: str, seconds: float, most_mb: float | None = None):
        self.context, self.group, self.end, self.most_mb = spark.sparkContext, group, time.monotonic() + seconds, most_mb
        self.context.setJobGroup(group, group, interruptOnCancel=True)

    def check(self, cancelled: bool = False) -> None:
        late = time.monotonic() > self.end
        full = self.most_mb is not None and resident_mb() > self.most_mb
        if cancelled or late or full:
            self.context.cancelJobGroup(self.group)
            if cancelled:
                raise RequestError("cancelled")
            raise ResourceError("timeout" if late else "memory")


def with_fallback(primary: Callable[[], dict], second: Callable[[str], dict], resource: tuple[type[Exception], ...] = (MemoryError, TimeoutError)) -> dict:
    """The second artifact where the first fails for want of resources; other errors pass."""
    try:
        return primary()
    except resource as e:
        return second(type(e).__name__)


def write_frames(frames: DataFrame, folder: str, head: dict, deadline: Deadline | None = None) -> dict:
    """All frames as an archive with its head; where time or memory run out, those that are made as a zip with
    the reason."""

    def whole() -> dict:
        if deadline:
            deadline.check()
        return files.write_tar(frames, os.path.join(folder, "frames.tar.gz"), head)

    return with_fallback(whole, lambda reason: files.write_zip(frames, os.path.join(folder, "frames.zip"), reason))
