"""Geometries of GeoJSON as rows of parts: polygons and points, out of collections of any of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import polygon

#: Collections within collections that are looked into.
DEPTH = 8
_GEOMETRY = "struct<type:string,coordinates:string,geometries:string>"


def geometries(rows: DataFrame, column: str) -> DataFrame:
    """id, f (place of the feature), g (place in it), type, coordinates (JSON text) of every geometry in a
    Feature, FeatureCollection or geometry. Collections are replaced by what they hold, down to ``DEPTH``."""
    whole = rows.select("id", F.from_json(column, f"struct<type:string,features:array<struct<geometry:{_GEOMETRY}>>,geometry:{_GEOMETRY},coordinates:string,geometries:string>").alias("j"))
    one = F.struct("j.type", "j.coordinates", "j.geometries")
    shapes = F.when(F.col("j.type") == "FeatureCollection", F.transform("j.features", lambda f: f["geometry"])).when(F.col("j.geometry").isNotNull(), F.array("j.geometry")).otherwise(F.array(one))
    level = whole.select("id", F.posexplode(shapes).alias("f", "s")).where("s is not null").select("id", "f", F.array(F.lit(0)).alias("at"), "s")
    out = None
    for _ in range(DEPTH):
        plain = level.where("s.type <> 'GeometryCollection'").select("id", "f", "at", "s.type", "s.coordinates")
        out = plain if out is None else out.unionByName(plain)
        inner = level.where("s.type = 'GeometryCollection'").select("id", "f", "at", F.posexplode(F.from_json("s.geometries", f"array<{_GEOMETRY}>")).alias("k", "s"))
        level = inner.where("s is not null").select("id", "f", F.concat("at", F.array("k")).alias("at"), "s")
    place = F.row_number().over(Window.partitionBy("id", "f").orderBy("at")) - 1
    return out.withColumn("g", place).drop("at")


def split(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Vertices of the polygons (id, part, ring, seq, x, y) and points (id, ord, x, y), in the order of the text.
    Lines and empty geometries have no rows."""
    own = geometries(rows, column)
    points = F.when(F.col("type") == "Point", F.array(F.from_json("coordinates", "array<double>"))).when(F.col("type") == "MultiPoint", F.from_json("coordinates", "array<array<double>>"))
    rings = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", "array<array<array<double>>>"))).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", "array<array<array<array<double>>>>"))
    by = Window.partitionBy("id").orderBy("f", "g", "p")
    found = own.select("id", "f", "g", F.posexplode(points).alias("p", "c")).where("size(c) >= 2")
    marks = found.select("id", (F.row_number().over(by) - 1).alias("ord"), F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(1)).alias("y"))
    parts = own.select("id", "f", "g", F.posexplode(rings).alias("p", "rings")).withColumn("part", F.row_number().over(by) - 1)
    flat = parts.select("id", "part", F.posexplode("rings").alias("ring", "points")).select("id", "part", "ring", F.posexplode("points").alias("seq", "c"))
    return flat.select("id", "part", "ring", "seq", F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(1)).alias("y")), marks


def repaired(vertices: DataFrame) -> DataFrame:
    """Features without rings that enclose nothing; a feature of such rings alone stays as it is."""
    areas = polygon.ring_areas(polygon.edges(vertices)).withColumn("_some", F.abs("area") > 0)
    known = areas.withColumn("_any", F.bool_or("_some").over(Window.partitionBy("id"))).select(*polygon.RING, "_some", "_any")
    return vertices.join(known, polygon.RING, "left").where(F.coalesce(F.col("_some") | ~F.col("_any"), F.lit(True))).drop("_some", "_any")


def overlay_point(points: DataFrame, epsg: int = 4326) -> DataFrame:
    """id, x, y in lon/lat of each feature's first point, and problem: the check that it fails, or null. Many
    points stand for their first."""
    first = points.groupBy("id").agg(F.min_by(F.struct("x", "y"), "ord").alias("c")).select("id", "c.x", "c.y")
    if epsg == 3857:
        lon, lat = geo.from_mercator(F.col("x"), F.col("y"))
        first = first.select("id", lon.alias("x"), lat.alias("y"))
    elif epsg != 4326:
        raise ValueError(f"EPSG:{epsg} is not supported")
    return first.withColumn("problem", point_problem(F.col("x"), F.col("y")))


def point_problem(x: Column, y: Column) -> Column:
    """The first check that a lon/lat point fails, or null."""
    return F.when(x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y), "empty").when((F.abs(x) > 180) | (F.abs(y) > 90), "bounds")
