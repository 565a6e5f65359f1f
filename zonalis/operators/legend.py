"""Legends, overlays and feature routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Fixed value: what a feature's ``source`` says if it is an overlay.
OVERLAY_SOURCE = "threat-map-overlay"
#: Style of an overlay that names none; strokes and fills differ by kind.
STROKE = {"polygon": "#fff200", "point": "#ff4e4e"}
STYLE = {"marker": "#ff4e4e", "marker_outline": "#ffffff", "label_color": "#212730", "label_background": "#ffffff", "stroke_width": 2.0, "fill_opacity": 0.15, "marker_size": 8.0}


def first_source(sources: list[DataFrame]) -> DataFrame:
    """The rows of the first source that has any."""
    ranked = [s.withColumn("_s", F.lit(i)) for i, s in enumerate(sources)]
    whole = ranked[0]
    for s in ranked[1:]:
        whole = whole.unionByName(s)
    least = whole.agg(F.min("_s").alias("_m"))
    return whole.join(F.broadcast(least), F.col("_s") == F.col("_m")).drop("_s", "_m")


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_i = 1").drop("_i")


def valid_entries(entries: DataFrame) -> DataFrame:
    """Entries (class_code, label, color) whose colour parses and that have a code or a label."""
    named = (F.coalesce(F.trim("class_code"), F.lit("")) != "") | (F.coalesce(F.trim("label"), F.lit("")) != "")
    return entries.withColumn("rgb", text.hex_colour(F.col("color"))).where(F.col("rgb").isNotNull() & named)


def layout(entries: DataFrame, order: list[str]) -> DataFrame:
    """row and col of each entry in one or two columns, and the band's height."""
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = entries.withColumn("i", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("n", F.count("*").over(whole))
    columns, _, height = text.legend_rows(F.col("n"))
    return placed.withColumn("row", F.floor(F.col("i") / columns).cast("int")).withColumn("col", (F.col("i") % columns).cast("int")).withColumn("band_height", height).drop("n")


def route(features: DataFrame) -> DataFrame:
    """Where a feature (source, geometry type) belongs: aoi, overlay_polygon, overlay_point or dropped."""
    polygon, point = F.col("type").isin("Polygon", "MultiPolygon"), F.col("type").isin("Point", "MultiPoint")
    overlay = F.coalesce(F.col("source") == OVERLAY_SOURCE, F.lit(False))
    return features.withColumn("route", F.when(polygon & overlay, "overlay_polygon").when(polygon, "aoi").when(point, "overlay_point").otherwise("dropped"))


def point_name(features: DataFrame, keys: list[str]) -> DataFrame:
    """The first point name that is not blank."""
    return features.where((F.col("route") == "overlay_point") & (F.trim("name") != "")).groupBy(*keys).agg(F.min_by(F.trim("name"), "ord").alias("name"))


def layers(overlays: DataFrame) -> DataFrame:
    """Overlay parts (id, label, legend_order, kind polygon or point): polygons before points, the first
    part of a layer in the legend, ordered by legend order, lower-case label and id."""
    kind = F.when(F.col("kind") == "polygon", 0).otherwise(1)
    part = Window.partitionBy("id").orderBy(kind, "part")
    whole = Window.orderBy("legend_order", F.lower("label"), "id", kind, "part")
    return overlays.withColumn("in_legend", F.row_number().over(part) == 1).withColumn("ord", F.row_number().over(whole))


def styled(overlays: DataFrame) -> DataFrame:
    """Styles of overlays (kind, stroke, fill and the names of STYLE) with their defaults; opacity between
    0 and 1; ``problem`` says whether a given colour does not parse."""
    colours = ["stroke", "fill", "marker", "marker_outline", "label_color", "label_background"]
    bad = F.lit(False)
    for c in colours:
        bad = bad | (F.col(c).isNotNull() & text.hex_colour(F.col(c)).isNull())
    out = overlays.withColumn("problem", F.when(bad, "colour"))
    default = F.when(F.col("kind") == "polygon", STROKE["polygon"]).otherwise(STROKE["point"])
    for name, value in {"stroke": default, "fill": default, **{k: F.lit(v) for k, v in STYLE.items()}}.items():
        out = out.withColumn(name, F.coalesce(F.col(name), value))
    return out.withColumn("fill_opacity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fill_opacity"))))


def overlay_entries(overlays: DataFrame) -> DataFrame:
    """Legend entries of overlay parts that show in the legend: code, label and colour, in order."""
    point = F.col("kind") == "point"
    shown = layers(overlays).where("in_legend")
    return shown.select("ord", F.when(point, "PT").otherwise("OVL").alias("class_code"), "label", F.when(point, F.col("marker")).otherwise(F.col("stroke")).alias("color"))


#: Limits and defaults of frames, with little memory and without.
FRAME_SIZES = {True: {"any": 512}, False: {"balanced": 768, "high": 1024}}
FRAME_MAX = {True: 512, False: 1024}
FRAME_FPS = {True: 0.5, False: 0.67}
FRAME_SECONDS = 1.5


def frame_options(requests: DataFrame, low_memory: bool = True, allow_high: bool = False) -> DataFrame:
    """width, height, fps and seconds of frame requests (payload_bytes, preset, width, height, fps, seconds,
    null where not given) with defaults, and the first check that fails."""
    most = FRAME_MAX[low_memory]
    base = F.lit(512) if low_memory else F.when(F.col("preset") == "high", 1024).otherwise(768)
    wide, high = F.coalesce("width", base), F.coalesce("height", base)
    problem = F.coalesce(
        F.when(F.col("payload_bytes") > 1_000_000, "payload"),
        F.when(F.col("preset") == "ultra", "ultra"),
        F.when(F.col("width") > 1024, "width"),
        F.when(F.col("height") > 1024, "height"),
        F.when((F.col("preset") == "high") & F.lit(not allow_high), "high"),
        F.when((wide > most) | (high > most), "size"),
    )
    return requests.withColumns({"problem": problem, "width": wide, "height": high, "fps": F.coalesce("fps", F.lit(FRAME_FPS[low_memory])), "seconds": F.coalesce("seconds", F.lit(FRAME_SECONDS))})


def normalised_thresholds(custom: Column, defaults: list[float], most: int = 10) -> Column:
    """struct(values, problem): positive, distinct, sorted; the defaults where none are given."""
    given = F.when(custom.isNull() | (F.size(custom) == 0), F.array(*map(F.lit, defaults))).otherwise(custom)
    values = F.array_sort(F.array_distinct(F.filter(given, lambda x: x > 0)))
    return F.struct(values.alias("values"), F.when(F.size(values) == 0, "empty").when(F.size(values) > most, "too many").alias("problem"))
