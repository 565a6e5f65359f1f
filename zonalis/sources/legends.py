"""Legends from colour files, manifests and project archives, and GeoJSON tile indexes."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import legend, parts, polygon

ENTRIES = "class_code string, label string, color string, ord bigint"


def colour_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``code R G B A # label``; blank, short and non-numeric lines and comments go."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).withColumn("line", F.trim("value")).where("line <> '' and not startswith(line, '#')")
    body = F.split(F.trim(F.substring_index("line", "#", 1)), r"\s+")
    label = F.when(F.instr("line", "#") > 0, F.trim(F.expr("substr(line, instr(line, '#') + 1)"))).otherwise("")
    rgb = [F.get(body, F.lit(i)).try_cast("int") for i in (1, 2, 3)]
    parsed = lines.select("ord", F.get(body, F.lit(0)).alias("class_code"), label.alias("label"), *[c.alias(n) for c, n in zip(rgb, "rgb", strict=True)]).where("r is not null and g is not null and b is not null")
    hex_ = F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(c), 2, "0")) for c in "rgb"])
    return parsed.select("class_code", text.bilingual(F.col("label"), F.col("class_code")).alias("label"), hex_.alias("color"), "ord")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON with ``entries`` of class_code, label and color."""
    rows = spark.read.schema("entries array<struct<class_code:string,label:string,color:string>>").json(path, multiLine=True)
    return rows.select(F.posexplode("entries").alias("ord", "e")).select("e.class_code", text.bilingual(F.coalesce("e.label", F.lit("")), F.col("e.class_code")).alias("label"), "e.color", F.col("ord").cast("bigint").alias("ord"))


def _projects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for data in b.column("content").to_pylist():
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    name = next((n for n in z.namelist() if n.lower().endswith(".qgs")), None)
                    out.append(z.read(name).decode("utf-8", "replace") if name else None)
            except zipfile.BadZipFile:
                out.append(None)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["xml"])


def project(spark: SparkSession, path: str) -> DataFrame:
    """Palette entries of the first project in a zip archive; of a code the first counts. A broken
    archive gives no rows."""
    xml = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_projects, "xml string").where("xml is not null")
    tags = xml.select(F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<paletteEntry\b([^>]*)"), F.lit(1))).alias("ord", "tag"))
    value = lambda name: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract("tag", rf'\b{name}="([^"]*)"', 1), "&quot;", '"'), "&lt;", "<"), "&amp;", "&"))
    rows = tags.select("ord", value("value").alias("class_code"), value("label").alias("label"), value("color").alias("color")).where("class_code <> '' and color <> ''")
    own = legend.first_per_key(rows, "class_code", "ord")
    return own.select("class_code", text.bilingual(F.col("label"), F.col("class_code")).alias("label"), "color", F.col("ord").cast("bigint").alias("ord"))


def entries(spark: SparkSession, colours: str | None = None, manifests: str | None = None, projects: tuple[str, ...] = ()) -> DataFrame:
    """The first of colour file, manifest and projects that has entries."""
    sources = [colour_file(spark, colours)] if colours else []
    sources += [manifest(spark, manifests)] if manifests else []
    sources += [project(spark, p) for p in projects]
    return legend.first_source(sources) if sources else spark.createDataFrame([], ENTRIES)


class TileIndex:
    """Features of a GeoJSON file with their tile names, read again after ``ttl`` seconds."""

    def __init__(self, spark: SparkSession, path: str, ttl: float = 86_400.0, name: str = "tile"):
        self.spark, self.path, self.ttl, self.name = spark, path, ttl, name
        self.read_at, self.rows = float("-inf"), None

    def frame(self) -> DataFrame:
        """tile, west, south, east, north."""
        if self.rows is None or time.monotonic() - self.read_at > self.ttl:
            schema = f"features array<struct<properties:struct<{self.name}:string>,geometry:struct<type:string,coordinates:string>>>"
            rows = self.spark.read.schema(schema).json(self.path, multiLine=True).select(F.explode("features").alias("f"))
            one = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
            many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
            parts = F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", many)
            outer = rows.select(F.col("f.properties").getField(self.name).alias("tile"), F.explode(parts).alias("rings"))
            points = outer.select("tile", F.explode(F.get("rings", F.lit(0))).alias("p"))
            x, y = F.get("p", F.lit(0)), F.get("p", F.lit(1))
            self.rows = points.groupBy("tile").agg(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north")).cache()
            self.read_at = time.monotonic()
        return self.rows


def boundary(spark: SparkSession, path: str) -> DataFrame:
    """Edges (id, part, ring, x1, y1, x2, y2) in lon/lat of a boundary file's polygons, each with an id of its own:
    what meets any of them meets their union. Coordinates in EPSG:3857, where the file says so, are turned into
    lon/lat. A file without polygons is an error."""
    text_ = spark.read.text(path, wholetext=True).select(F.lit(0).alias("id"), F.col("value").alias("json"))
    metres = F.get_json_object("json", "$.crs.properties.name").rlike("3857")
    own = text_.withColumn("metres", F.coalesce(metres, F.lit(False)))
    vertices, _ = parts.split(own, "json")
    if vertices.isEmpty():
        raise ValueError(f"{path} holds no polygon")
    if own.first()["metres"]:
        lon, lat = geo.from_mercator(F.col("x"), F.col("y"))
        vertices = vertices.select("id", "part", "ring", "seq", lon.alias("x"), lat.alias("y"))
    return polygon.edges(vertices.withColumn("id", F.col("part")))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.withColumn("i", F.row_number().over(Window.orderBy("ord")) - 1)
