"""Operators on tiles and rasters as relations of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decode, geo


def tile_flags(pixels: DataFrame, tile: list[str]) -> DataFrame:
    """What decides a tile's decoding, from bands b0, b1, b2: all blue zero, all green zero, the 95th
    percentile of packed values above zero, and whether it is class-encoded.

    Class-encoded: among pixels of red above zero, all have green 127 or all green 0, blue being 0;
    a tile without such pixels is not. Different packed values are counted before they meet in a task.
    """
    r, g, b = (F.col(c) for c in ("b0", "b1", "b2"))
    red = r > 0
    value = decode.packed(r, g)
    counts = pixels.groupBy(*tile, value.alias("_p")).agg(
        F.count("*").alias("_n"),
        F.bool_and(b == 0).alias("_blue"),
        F.bool_and(g == 0).alias("_green"),
        F.bool_or(red).alias("_any"),
        F.bool_and(~red | ((g == 127) & (b == 0))).alias("_c127"),
        F.bool_and(~red | ((g == 0) & (b == 0))).alias("_c0"),
    )
    return counts.groupBy(*tile).agg(
        F.bool_and("_blue").alias("blue_zero"),
        F.bool_and("_green").alias("green_zero"),
        F.percentile(F.when(F.col("_p") > 0, F.col("_p")), F.lit(0.95), F.col("_n")).alias("p95"),
        (F.bool_or("_any") & (F.bool_and("_c127") | F.bool_and("_c0"))).alias("encoded"),
    )


def decode_tiles(pixels: DataFrame, tile: list[str], kind: str) -> DataFrame:
    """Add v (height or biomass) or class (class) to pixels with bands b0, b1, b2 of colour tiles."""
    flagged = pixels.join(tile_flags(pixels, tile), tile)
    bands = [F.col(c) for c in ("b0", "b1", "b2", "blue_zero", "green_zero", "p95")]
    added = {"height": lambda: ("v", decode.height(*bands)), "biomass": lambda: ("v", decode.biomass(*bands)), "class": lambda: ("class", decode.class_id(F.lit(3), F.col("b0"), F.col("encoded")))}[kind]()
    return flagged.withColumn(*added).drop("blue_zero", "green_zero", "p95", "encoded")


def overview(pixels: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """Averages of the valid pixels (row, col, v, valid) in blocks of factor by factor."""
    return pixels.where("valid").groupBy(*keys, F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.sum("v").alias("s"), F.count("*").alias("n")).select(*keys, "row", "col", (F.col("s") / F.col("n")).alias("v"))


def mosaic_first(pixels: DataFrame, cell: list[str], order: str, value: str) -> DataFrame:
    """Of the valid pixels of a cell the one of the first tile in order. Partial aggregation keeps one
    candidate a cell and task."""
    return pixels.where("valid").groupBy(*cell).agg(F.min_by(value, order).alias(value), F.min(order).alias(order))


def band_stats(pixels: DataFrame, keys: list[str], value: str, valid: Column) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.min(F.when(valid, F.col(value))).alias("lo"), F.max(F.when(valid, F.col(value))).alias("hi"), F.count_if(valid).alias("n"), F.count("*").alias("total")).withColumn("fraction", F.col("n") / F.col("total"))


def align_nearest(target: DataFrame, source: DataFrame, target_grid: dict[str, float], source_grid: dict[str, float]) -> DataFrame:
    """row, col of the target grid with the source's value at the nearest pixel (null outside).

    Grids: x0, y0 (upper left corner), width, height of a pixel, rows, cols. The source cell is computed
    from the target's centre, so the join is on equality.
    """
    x, y = geo.pixel_centre(F.lit(target_grid["x0"]), F.lit(target_grid["y0"]), F.lit(target_grid["width"]), F.lit(target_grid["height"]), F.col("row"), F.col("col"))
    keyed = target.select("row", "col", F.floor((F.lit(source_grid["y0"]) - y) / source_grid["height"]).cast("int").alias("_r"), F.floor((x - source_grid["x0"]) / source_grid["width"]).cast("int").alias("_c"))
    own = source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "v")
    return keyed.join(own, ["_r", "_c"], "left").select("row", "col", "v")


def tile_cover(boxes: DataFrame, zoom: Column) -> DataFrame:
    """Tiles of lon/lat boxes (west, south, east, north; other columns stay). A box that ends on a
    tile's edge does not reach the next tile; the square's end clamps latitudes."""
    tiny = 1e-11
    z = boxes.withColumn("z", zoom.cast("int"))
    x0, x1 = geo.tile_column(F.col("west"), F.col("z")), geo.tile_column(F.col("east") - tiny, F.col("z"))
    y0, y1 = geo.tile_row(F.col("north"), F.col("z")), geo.tile_row(F.col("south") + tiny, F.col("z"))
    return z.withColumn("x", F.explode(F.sequence(x0, F.greatest(x0, x1)))).withColumn("y", F.explode(F.sequence(y0, F.greatest(y0, y1))))


def tile_count(boxes: DataFrame, zoom: Column) -> Column:
    tiny = 1e-11
    wide = F.greatest(F.lit(1), geo.tile_column(F.col("east") - tiny, zoom) - geo.tile_column(F.col("west"), zoom) + 1)
    return wide * F.greatest(F.lit(1), geo.tile_row(F.col("south") + tiny, zoom) - geo.tile_row(F.col("north"), zoom) + 1)


def choose_zoom(boxes: DataFrame, key: str, requested: int, most: int, max_tiles: int) -> DataFrame:
    """The finest zoom from the requested one whose tiles stay within the limit, with all coarser ones;
    null zoom where the requested one is already above."""
    zooms = boxes.withColumn("z", F.explode(F.sequence(F.lit(requested), F.lit(most))))
    counted = zooms.withColumn("tiles", tile_count(zooms, F.col("z")))
    fits = F.bool_and(F.col("tiles") <= max_tiles).over(Window.partitionBy(key).orderBy("z"))
    return counted.withColumn("fits", fits).groupBy(key).agg(F.max(F.when(F.col("fits"), F.struct("z", "tiles"))).alias("best")).select(key, F.col("best.z").alias("zoom"), F.col("best.tiles").alias("tiles"))


def missing_tiles(wanted: DataFrame, decoded: DataFrame, tile: list[str]) -> DataFrame:
    return wanted.join(decoded, tile, "left_anti")


def frame_pixels(tiles: DataFrame, width: int, height: int) -> DataFrame:
    """Destination pixels of tiles in a frame, and the tile pixel that each shows.

    tiles: z, x, y, size (pixels a side) and the frame's box (left, right, top, bottom in metres). The
    tile is clipped to the box; the destination's edges are rounded half to even, it is one pixel at
    least, and the source pixel is the nearest to the destination's centre.
    """
    b = geo.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    left, right = F.greatest(b["left"], F.col("left")), F.least(b["right"], F.col("right"))
    top, bottom = F.least(b["top"], F.col("top")), F.greatest(b["bottom"], F.col("bottom"))
    sx, sy = F.lit(float(width)) / (F.col("right") - F.col("left")), F.lit(float(height)) / (F.col("top") - F.col("bottom"))
    side = geo.tile_side(F.col("z"))
    edges = {
        "px0": F.bround((left - F.col("left")) * sx), "px1": F.bround((right - F.col("left")) * sx), "py0": F.bround((F.col("top") - top) * sy), "py1": F.bround((F.col("top") - bottom) * sy),
        "s0": F.floor((left - b["left"]) / side * F.col("size")), "s1": F.ceil((right - b["left"]) / side * F.col("size")), "t0": F.floor((b["top"] - top) / side * F.col("size")), "t1": F.ceil((b["top"] - bottom) / side * F.col("size")),
    }
    cut = tiles.where((left < right) & (bottom < top)).select("z", "x", "y", *[c.cast("int").alias(n) for n, c in edges.items()])
    cut = cut.withColumns({"px1": F.greatest(F.col("px0") + 1, F.col("px1")), "py1": F.greatest(F.col("py0") + 1, F.col("py1")), "s1": F.greatest(F.col("s0") + 1, F.col("s1")), "t1": F.greatest(F.col("t0") + 1, F.col("t1"))})
    rows = cut.withColumn("py", F.explode(F.sequence(F.col("py0"), F.col("py1") - 1))).withColumn("px", F.explode(F.sequence(F.col("px0"), F.col("px1") - 1)))
    nearest = lambda p, p0, p1, s0, s1: F.col(s0) + F.floor((F.col(p) - F.col(p0) + 0.5) * (F.col(s1) - F.col(s0)) / (F.col(p1) - F.col(p0))).cast("int")
    inside = rows.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))
    return inside.select("z", "x", "y", "py", "px", nearest("py", "py0", "py1", "t0", "t1").alias("row"), nearest("px", "px0", "px1", "s0", "s1").alias("col"))


def paint(pixels: DataFrame, cell: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """What is painted last stays: the greatest in order."""
    return pixels.groupBy(*cell).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("p")).select(*cell, "p.*")


def overlay_pixel(lon: Column, lat: Column, box: dict[str, Column], width: int, height: int) -> tuple[Column, Column]:
    """Pixel of a place in a frame of lon/lat box, whose last pixel lies on the box's edge."""
    return F.bround((lon - box["west"]) / (box["east"] - box["west"]) * (width - 1)).cast("int"), F.bround((box["north"] - lat) / (box["north"] - box["south"]) * (height - 1)).cast("int")


def mismatched_tiles(base: DataFrame, comp: DataFrame, tile: list[str], cell: tuple[str, str] = ("row", "col")) -> DataFrame:
    """Tiles of both years whose numbers of rows or columns differ: tile, base and comp as (rows, cols)."""
    size = lambda df, name: df.groupBy(*tile).agg(F.struct((F.max(cell[0]) + 1).alias("rows"), (F.max(cell[1]) + 1).alias("cols")).alias(name))
    return size(base, "base").join(size(comp, "comp"), tile).where(F.col("base") != F.col("comp"))
