"""Polygons as relations of vertices and edges: masks, areas, checks.

``vertices``: id, part, ring, seq, x, y (rings closed). The even-odd rule holds within a feature, so
holes and self-intersections come out; features are united by OR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = ["id", "part", "ring"]
GEOJSON = "struct<type:string,coordinates:string>"


def edges(vertices: DataFrame) -> DataFrame:
    """id, part, ring, x1, y1, x2, y2: each vertex with the next one of its ring."""
    by = Window.partitionBy(*RING).orderBy("seq")
    return vertices.select(*RING, F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(by).alias("x2"), F.lead("y").over(by).alias("y2")).where("x2 is not null")


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a join that has rows for each feature: both sides are shuffled, never broadcast, as its size
    grows with the features, and a few broadcasts at once fill the driver's memory."""
    return df.hint("merge")


def scanlines(edges: DataFrame, rows: int, cols: int) -> DataFrame:
    """id, row, c0, c1: spans of columns [c0, c1) whose pixel centres are inside, on a unit grid with
    rows downwards. Work grows with the boundary's length in rows; a centre on the left or upper boundary
    is inside, on the right or lower one outside."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.greatest(F.lit(0), F.ceil(low - 0.5)).cast("int"), F.least(F.lit(rows - 1), F.ceil(high - 0.5) - 1).cast("int")
    crossing = edges.withColumn("_first", first).withColumn("_last", last).where("_first <= _last").withColumn("row", F.explode(F.sequence("_first", "_last")))
    x = F.col("x1") + (F.col("row") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    by = Window.partitionBy("id", "row").orderBy("cx")
    paired = crossing.select("id", "row", x.alias("cx")).withColumn("i", F.row_number().over(by)).withColumn("cy", F.lead("cx").over(by))
    spans = paired.where("i % 2 = 1 and cy is not null")
    return spans.select("id", "row", F.greatest(F.lit(0), F.ceil(F.col("cx") - 0.5)).cast("int").alias("c0"), F.least(F.lit(cols), F.ceil(F.col("cy") - 0.5)).cast("int").alias("c1")).where("c0 < c1")


def mask_cells(spans: DataFrame) -> DataFrame:
    """row, col of the united features' cells."""
    return spans.withColumn("col", F.explode(F.sequence("c0", F.col("c1") - 1))).select("row", "col").distinct()


def mask_pixels(pixels: DataFrame, spans: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """Pixels inside any feature: spans of a row are gathered, and the row joins on equality."""
    gathered = spans.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("c0", "c1")).alias("_spans"))
    inside = F.exists("_spans", lambda s: (F.col(col) >= s["c0"]) & (F.col(col) < s["c1"]))
    return pixels.join(gathered, F.col(row) == F.col("_row")).where(inside).drop("_row", "_spans")


def to_grid(edges: DataFrame, x0: float, y0: float, width: float, height: float) -> DataFrame:
    """Edges in pixels of a grid with upper left corner (x0, y0)."""
    return edges.select(*RING, *[((F.col(c) - x0) / width if c[0] == "x" else (F.lit(y0) - F.col(c)) / height).alias(c) for c in ("x1", "y1", "x2", "y2")])


def all_touched(edges: DataFrame, rows: int, cols: int) -> DataFrame:
    """row, col of cells that the boundary passes or whose centre is inside."""
    r0, r1 = F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2"))
    cut = edges.withColumn("row", F.explode(F.sequence(F.greatest(F.lit(0), r0).cast("int"), F.greatest(F.greatest(F.lit(0), r0), F.least(F.lit(rows - 1), r1)).cast("int"))))
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.lit(None)).otherwise(F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    top, bottom = F.greatest(F.col("row").cast("double"), F.least("y1", "y2")), F.least(F.col("row") + 1.0, F.greatest("y1", "y2"))
    a, b = F.coalesce(at(top), F.col("x1")), F.coalesce(at(bottom), F.col("x2"))
    c0, c1 = F.greatest(F.lit(0), F.floor(F.least(a, b))).cast("int"), F.least(F.lit(cols - 1), F.floor(F.greatest(a, b))).cast("int")
    line = cut.where(F.col("row") < rows).withColumn("c0", c0).withColumn("c1", c1).where("c0 <= c1").withColumn("col", F.explode(F.sequence("c0", "c1"))).select("row", "col")
    return line.union(mask_cells(scanlines(edges, rows, cols))).distinct()


def ring_areas(edges: DataFrame) -> DataFrame:
    """id, part, ring, signed area (shoelace)."""
    return edges.groupBy(*RING).agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))


def polygon_areas(edges: DataFrame) -> DataFrame:
    """id, area: outer rings (ring 0) less their holes, for simple rings."""
    area = F.when(F.col("ring") == 0, F.abs("area")).otherwise(-F.abs("area"))
    return ring_areas(edges).groupBy("id").agg(F.sum(area).alias("area"))


def centroids(edges: DataFrame) -> DataFrame:
    """id, x, y: area centroid of outer rings less holes (of simple rings), and the middle of the bounds."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    ring = edges.groupBy(*RING).agg((F.sum(cross) / 2).alias("a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"), F.min("x1").alias("x0"), F.max("x1").alias("x9"), F.min("y1").alias("y0"), F.max("y1").alias("y9"))
    sign = F.signum("a") * F.when(F.col("ring") == 0, 1).otherwise(-1)
    whole = ring.groupBy("id").agg(F.sum(sign * F.col("a")).alias("a"), F.sum(sign * F.col("sx")).alias("sx"), F.sum(sign * F.col("sy")).alias("sy"), F.min("x0").alias("x0"), F.max("x9").alias("x9"), F.min("y0").alias("y0"), F.max("y9").alias("y9"))
    return whole.select("id", F.try_divide(F.col("sx"), 6 * F.col("a")).alias("x"), F.try_divide(F.col("sy"), 6 * F.col("a")).alias("y"), ((F.col("x0") + F.col("x9")) / 2).alias("mid_x"), ((F.col("y0") + F.col("y9")) / 2).alias("mid_y"))


def meetings(edges: DataFrame) -> DataFrame:
    """id, proper, x, y for each two edges of a feature that meet: proper with the point where they cross, or
    not proper (x, y null) where one's end lies on the other. Edges with a common end are left out, unless
    they cross.

    Edges meet by the cells of a square grid that they pass through, not all with all. The grid has a cell's
    side in proportion to the root of the feature's number of edges, so short edges fill few cells and long
    ones share a cell with few others.
    """
    own = edges.groupBy("id").agg(
        F.min(F.least("x1", "x2")).alias("_west"), F.max(F.greatest("x1", "x2")).alias("_east"), F.min(F.least("y1", "y2")).alias("_south"), F.max(F.greatest("y1", "y2")).alias("_north"),
        F.least(F.lit(2048.0), F.greatest(F.lit(2.0), F.ceil(2 * F.sqrt(F.count("*"))).cast("double"))).alias("_g"),
    )
    wide = lambda lo, hi: F.greatest((F.col(hi) - F.col(lo)) / F.col("_g"), F.lit(1e-12))
    numbered = edges.join(_dealt(own), "id").withColumn("_e", F.xxhash64("part", "ring", "x1", "y1", "x2", "y2")).withColumn("_w", wide("_west", "_east")).withColumn("_h", wide("_south", "_north"))
    cell = lambda v, lo, size: F.floor((v - F.col(lo)) / F.col(size)).cast("int")
    rows = numbered.withColumn("_row", F.explode(F.sequence(cell(F.least("y1", "y2"), "_south", "_h") - 1, cell(F.greatest("y1", "y2"), "_south", "_h") + 1)))
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.lit(None)).otherwise(F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    slack = 1e-6 * F.col("_h")  # a row reaches a little over its edges, so that no rounding parts two edges
    low, high = F.col("_south") + F.col("_row") * F.col("_h") - slack, F.col("_south") + (F.col("_row") + 1) * F.col("_h") + slack
    bottom, top = F.greatest(low, F.least("y1", "y2")), F.least(high, F.greatest("y1", "y2"))
    near = rows.where(bottom <= top)
    a, b = F.coalesce(at(bottom), F.col("x1")), F.coalesce(at(top), F.col("x2"))
    reach = 1e-6 * F.col("_w")
    cut = near.withColumn("_col", F.explode(F.sequence(cell(F.least(a, b) - reach, "_west", "_w"), cell(F.greatest(a, b) + reach, "_west", "_w")))).select("id", "_row", "_col", "_e", "x1", "y1", "x2", "y2")
    other = cut.select("id", "_row", "_col", *[F.col(c).alias(f"o{c}") for c in ("_e", "x1", "y1", "x2", "y2")])
    side = lambda ax, ay, bx, by, cx, cy: (F.col(bx) - F.col(ax)) * (F.col(cy) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(cx) - F.col(ax))
    over = (F.least("x1", "x2") <= F.greatest("ox1", "ox2")) & (F.greatest("x1", "x2") >= F.least("ox1", "ox2")) & (F.least("y1", "y2") <= F.greatest("oy1", "oy2")) & (F.greatest("y1", "y2") >= F.least("oy1", "oy2"))
    both = cut.join(_dealt(other), ["id", "_row", "_col"]).where((F.col("_e") < F.col("o_e")) & over)
    d1, d2 = side("x1", "y1", "x2", "y2", "ox1", "oy1"), side("x1", "y1", "x2", "y2", "ox2", "oy2")
    d3, d4 = side("ox1", "oy1", "ox2", "oy2", "x1", "y1"), side("ox1", "oy1", "ox2", "oy2", "x2", "y2")
    proper = (d1 * d2 < 0) & (d3 * d4 < 0)
    same = lambda i, j: (F.col(f"x{i}") == F.col(f"ox{j}")) & (F.col(f"y{i}") == F.col(f"oy{j}"))
    joined = same(1, 1) | same(1, 2) | same(2, 1) | same(2, 2)
    touch = ~joined & (d1 * d2 <= 0) & (d3 * d4 <= 0)
    t = d3 / (d3 - d4)
    met = both.where(proper | touch).withColumn("proper", proper)
    point = [F.when(F.col("proper"), F.col(f"{c}1") + t * (F.col(f"{c}2") - F.col(f"{c}1"))).alias(c) for c in "xy"]
    return met.select("id", "_e", "o_e", "proper", *point).distinct().select("id", "proper", "x", "y")


def crossings(edges: DataFrame) -> DataFrame:
    """id, x, y where edges of a feature cross properly."""
    return meetings(edges).where("proper").select("id", "x", "y")


def slab_areas(edges: DataFrame) -> DataFrame:
    """id, area by the even-odd rule, exact for crossing rings.

    A feature of one ring that neither crosses nor touches itself has the shoelace's area. Of others y is cut
    at every vertex and crossing into slabs, every edge is dealt to the slabs between the ranks of its ends,
    and the trapezoids of inside intervals are summed. A feature that encloses nothing has no row.
    """
    met = meetings(edges)
    rings = edges.groupBy("id", "part", "ring").agg(F.count("*").alias("n"), F.count_distinct("x1", "y1").alias("points")).groupBy("id").agg(F.count("*").alias("rings"), F.min(F.col("n") == F.col("points")).alias("once"))
    plain = _dealt(rings.where("rings = 1 and once").join(_dealt(met.select("id").distinct()), "id", "left_anti").select("id"))
    rest = edges.join(plain, "id", "left_anti")
    ys = rest.select("id", F.col("y1").alias("y")).union(rest.select("id", "y2")).union(met.where("proper").join(plain, "id", "left_anti").select("id", "y")).distinct()
    by = Window.partitionBy("id").orderBy("y")
    slabs = ys.withColumn("top", F.lead("y").over(by)).withColumn("rank", F.row_number().over(by))
    place = lambda c: _dealt(slabs.select("id", F.col("y").alias(c), F.col("rank").alias(f"_{c}")))
    ranked = rest.where("y1 <> y2").join(place("y1"), ["id", "y1"]).join(place("y2"), ["id", "y2"])
    dealt = ranked.withColumn("rank", F.explode(F.sequence(F.least("_y1", "_y2"), F.greatest("_y1", "_y2") - 1)))
    within = dealt.join(_dealt(slabs), ["id", "rank"])
    at = lambda y: F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    lines = within.select("id", "y", "top", at(F.col("y")).alias("a"), at(F.col("top")).alias("b"), at((F.col("y") + F.col("top")) / 2).alias("m"))
    order = Window.partitionBy("id", "y").orderBy("m", "a", "b")
    spans = lines.withColumn("i", F.row_number().over(order)).withColumn("a2", F.lead("a").over(order)).withColumn("b2", F.lead("b").over(order)).where("i % 2 = 1 and a2 is not null")
    cut = spans.groupBy("id").agg(F.sum((F.col("a2") - F.col("a") + F.col("b2") - F.col("b")) / 2 * (F.col("top") - F.col("y"))).alias("area"))
    return polygon_areas(edges.join(plain, "id", "left_semi")).unionByName(cut).where("area > 0")


def bounds(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("id").agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"), F.sum(F.when(F.col("ring") == 0, 1).otherwise(0)).alias("n_vertices"))


#: Limits of an area of interest.
MAX_VERTICES, MAX_AREA_KM2 = 50_000, 1_600.0


def aoi_problem(kind: Column, valid: Column, west: Column, south: Column, east: Column, north: Column, n_vertices: Column, area_km2: Column) -> Column:
    """The first check that fails, or null: type, validity, bounds, vertices of outer rings, planar area."""
    return F.coalesce(
        F.when(~kind.isin("Polygon", "MultiPolygon"), "type"),
        F.when(~valid, "invalid"),
        F.when((west < -180) | (east > 180) | (south < -90) | (north > 90), "bounds"),
        F.when(n_vertices > MAX_VERTICES, "vertices"),
        F.when(area_km2 > MAX_AREA_KM2, "area"),
    )


def intersecting_tiles(edges: DataFrame, tiles: DataFrame, cell: float = 1.0) -> DataFrame:
    """id, tile of features and tiles (tile, west, south, east, north) that have a point in common.

    Boxes are cut by a grid of ``cell`` degrees and meet on its cells; a pair is kept if an edge touches
    the box, or one holds a corner of the other.
    """
    steps = lambda lo, hi: F.sequence(F.floor(lo / cell).cast("int"), F.floor(hi / cell).cast("int"))
    box = edges.groupBy("id").agg(F.min("x1").alias("a"), F.min("y1").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("d"))
    left = box.withColumn("gx", F.explode(steps(F.col("a"), F.col("c")))).withColumn("gy", F.explode(steps(F.col("b"), F.col("d"))))
    right = tiles.withColumn("gx", F.explode(steps(F.col("west"), F.col("east")))).withColumn("gy", F.explode(steps(F.col("south"), F.col("north"))))
    near = left.join(right, ["gx", "gy"]).where("a <= east and c >= west and b <= north and d >= south").select("id", "tile", "west", "south", "east", "north").distinct()
    lines = near.join(edges, "id")
    side = lambda x, y: (F.col("x2") - F.col("x1")) * (F.col(y) - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col(x) - F.col("x1"))
    corners = [side(x, y) for x in ("west", "east") for y in ("south", "north")]
    touches = (F.least("x1", "x2") <= F.col("east")) & (F.greatest("x1", "x2") >= F.col("west")) & (F.least("y1", "y2") <= F.col("north")) & (F.greatest("y1", "y2") >= F.col("south")) & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)
    crosses = (F.least("y1", "y2") <= F.col("south")) & (F.greatest("y1", "y2") > F.col("south")) & (F.col("x1") + (F.col("south") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")) > F.col("west"))
    seen = lines.groupBy("id", "tile").agg(F.bool_or(touches).alias("touches"), F.count_if(crosses).alias("n"))
    return seen.where("touches or n % 2 = 1").select("id", "tile")


def sanitise(vertices: DataFrame) -> DataFrame:
    """Rings without missing or infinite coordinates and consecutive duplicates, closed; rings of fewer
    than three different or four closed vertices go."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    by = Window.partitionBy(*RING).orderBy("seq")
    here, before = F.struct("x", "y"), F.lag(F.struct("x", "y")).over(by)
    kept = vertices.where(fine("x") & fine("y")).withColumn("_same", F.coalesce(before == here, F.lit(False))).where("not _same").drop("_same")
    ring = kept.groupBy(*RING).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).withColumn("p", F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))))
    closed = F.when(F.element_at("p", 1) == F.element_at("p", -1), F.col("p")).otherwise(F.concat("p", F.array(F.element_at("p", 1))))
    whole = ring.where(F.size(F.array_distinct("p")) >= 3).withColumn("p", closed).where(F.size("p") >= 4)
    return whole.select(*RING, F.posexplode("p").alias("seq", "v")).select(*RING, "seq", "v.x", "v.y")


def parse_geojson(rows: DataFrame, column: str) -> DataFrame:
    """id, part, ring, seq, x, y of polygons in a Feature, FeatureCollection or geometry, as JSON text.

    Parts of all features are parts of one geometry (their union under OR of masks); geometries of other
    types have no rows. ``rows`` needs id.
    """
    whole = rows.select("id", F.from_json(column, "struct<type:string,features:array<struct<geometry:struct<type:string,coordinates:string>>>,geometry:struct<type:string,coordinates:string>,coordinates:string>").alias("g"))
    one = F.struct(F.col("g.type").alias("type"), F.col("g.coordinates").alias("coordinates"))
    shapes = F.when(F.col("g.type") == "FeatureCollection", F.transform("g.features", lambda f: f["geometry"])).when(F.col("g.type") == "Feature", F.array(F.col("g.geometry"))).otherwise(F.array(one))
    polygon = F.array(F.from_json(F.col("s.coordinates"), "array<array<array<double>>>"))
    parts = F.when(F.col("s.type") == "Polygon", polygon).when(F.col("s.type") == "MultiPolygon", F.from_json(F.col("s.coordinates"), "array<array<array<array<double>>>>"))
    cut = whole.select("id", F.posexplode(shapes).alias("f", "s")).select("id", "f", F.posexplode(parts).alias("p", "rings")).select("id", F.dense_rank().over(Window.partitionBy("id").orderBy("f", "p")).alias("part"), F.posexplode("rings").alias("ring", "points"))
    return cut.select("id", "part", "ring", F.posexplode("points").alias("seq", "point")).select("id", (F.col("part") - 1).alias("part"), "ring", "seq", F.get("point", F.lit(0)).alias("x"), F.get("point", F.lit(1)).alias("y"))


def square_around(x: Column, y: Column, side: float) -> Column:
    """Closed ring of a square, as an array of points."""
    h = side / 2
    return F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ((-h, -h), (h, -h), (h, h), (-h, h), (-h, -h))])


def disc_around(x: Column, y: Column, radius: float, n: int = 64) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((x + radius * F.cos(2 * F.pi() * i / n)).alias("x"), (y + radius * F.sin(2 * F.pi() * i / n)).alias("y")))
