"""More of the catalogue: joins on masks, scalar expressions, legends, overlays, sets and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decode, geo, text
from ..operators import change, legend, parts, polygon, tiles, zonal
from . import relations as R
from .queries import CELL, PLACES, TILE, _micro, _places, query, values

CLASS_LIST = "(3), (5), (76)"


@query(f"with {R.PAIRS} select tile_x, count(*) n from pairs where b in (select c from (values {CLASS_LIST}) t(c)) group by 1")
def f03_class_membership(spark, sf):
    return R.pairs(spark, sf).join(F.broadcast(values(spark, "k", CLASS_LIST)), F.col("b") == F.col("k"), "left_semi").groupBy("tile_x").agg(F.count("*").alias("n"))


COLOUR_LIST = "(10, 0, 0), (20, 40, 1), (3, 7, 0)"


@query(f"with {R.RGB} select tile_x, count(*) n from rgb where (b0, b1, b2) in (select (r, g, b) from (values {COLOUR_LIST}) t(r, g, b)) group by 1")
def f04_colour_membership(spark, sf):
    forest = values(spark, "r, g, b", COLOUR_LIST)
    p = R.rgb(spark, sf)
    return p.join(F.broadcast(forest), (p.b0 == forest.r) & (p.b1 == forest.g) & (p.b2 == forest.b), "left_semi").groupBy("tile_x").agg(F.count("*").alias("n"))


@query(f"with {R.CELLS} select tile_x, count_if(v between 5 and 40) n from pixels group by 1")
def f06_value_range(spark, sf):
    return R.pixels(spark, sf).groupBy("tile_x").agg(F.count_if(decode.in_range(F.col("v"), 5, 40)).alias("n"))


@query(f"with {R.CELLS} select tile_x, count_if(v <> 50) whole, count_if(abs(v / 3.0::double - 5) > 1e-8::double + 1e-5::double * 5) real_ from pixels group by 1")
def f08_band_validity(spark, sf):
    v = F.col("v")
    return R.pixels(spark, sf).groupBy("tile_x").agg(F.count_if(decode.band_valid(v, F.lit(50), False)).alias("whole"), F.count_if(decode.band_valid(v / 3.0, F.lit(5.0), True)).alias("real_"))


EXTENTS = "(1, 0, 1000, 0, 1000, 10), (2, 0, 990, 15, 1000, 10), (3, 0, 100, 0, 1000, 10), (4, 1, 998, 1, 999, 0)"


@query(f"select id, l <= 0 + 2 * greatest(px, 1) and r >= 1000 - 2 * greatest(px, 1) and b <= 0 + 2 * greatest(px, 1) and t >= 1000 - 2 * greatest(px, 1) ok from (values {EXTENTS}) e(id, l, r, b, t, px)")
def f15_extent(spark, sf):
    e = values(spark, "id, l, r, b, t, px", EXTENTS)
    fixed = {"left": F.lit(0), "right": F.lit(1000), "bottom": F.lit(0), "top": F.lit(1000)}
    return e.select("id", geo.covers_extent(fixed, {"left": F.col("l"), "right": F.col("r"), "bottom": F.col("b"), "top": F.col("t")}, F.col("px"), F.col("px")).alias("ok"))


REQUESTS = "(1, 10, 'balanced', null, null), (2, 1000001, 'balanced', null, null), (3, 10, 'ultra', 2000, null), (4, 10, 'balanced', 2048, null), (5, 10, 'high', null, null), (6, 10, 'balanced', 600, 100), (7, 10, 'balanced', 512, 64)"


@query(f"select id, case when bytes > 1000000 then 'payload' when preset = 'ultra' then 'ultra' when w > 1024 then 'width' when h > 1024 then 'height' when preset = 'high' then 'high' when coalesce(w, 512) > 512 or coalesce(h, 512) > 512 then 'size' end problem, cast(coalesce(w, 512) as int) width, cast(coalesce(h, 512) as int) height, 0.5::double fps, 1.5::double as \"seconds\" from (values {REQUESTS}) t(id, bytes, preset, w, h)")
def f16_frame_checks(spark, sf):
    rows = values(spark, "id, payload_bytes, preset, width, height", REQUESTS).withColumn("fps", F.lit(None).cast("double")).withColumn("seconds", F.lit(None).cast("double"))
    return legend.frame_options(rows).select("id", "problem", "width", "height", "fps", "seconds")


ENTRIES = "('3', 'Forest', '#1f8d49'), ('', '', '#000000'), ('5', null, 'nope'), (null, 'Only', 'ffffff'), ('9', null, ' 7A5900 ')"


@query(f"select class_code, label, color from (values {ENTRIES}) t(class_code, label, color) where regexp_matches(lower(ltrim(trim(color), '#')), '^[0-9a-f]{{6}}$') and (coalesce(trim(class_code), '') <> '' or coalesce(trim(label), '') <> '')")
def f19_legend_entries(spark, sf):
    return legend.valid_entries(values(spark, "class_code, label, color", ENTRIES)).drop("rgb")


OVERLAYS = "('b', 'Beta', 1, 'polygon', 0, '#111111', '#aaaaaa'), ('b', 'Beta', 1, 'point', 1, '#222222', '#bbbbbb'), ('a', 'alpha', 1, 'point', 0, '#333333', '#cccccc'), ('c', 'Gamma', 0, 'polygon', 0, '#444444', '#dddddd')"


@query(f"with p as (select *, row_number() over (partition by id order by case kind when 'polygon' then 0 else 1 end, part) = 1 shown, cast(row_number() over (order by legend_order, lower(label), id, case kind when 'polygon' then 0 else 1 end, part) as int) ord from (values {OVERLAYS}) t(id, label, legend_order, kind, part, stroke, marker)) select ord, case kind when 'point' then 'PT' else 'OVL' end class_code, label, case kind when 'point' then marker else stroke end color from p where shown")
def g04_overlay_layers(spark, sf):
    return legend.overlay_entries(values(spark, "id, label, legend_order, kind, part, stroke, marker", OVERLAYS))


@query("select c_custkey as id, k as i, cast(c_custkey % 100 as double) + case when k in (0, 3, 4) then -15.0::double else 15.0 end x, cast(c_custkey % 70 as double) + case when k in (0, 1, 4) then -15.0::double else 15.0 end y from customer, generate_series(0, 4) t(k)")
def g06_centroid_square(spark, sf):
    k = F.col("c_custkey")
    ring = polygon.square_around((k % 100).cast("double"), (k % 70).cast("double"), 30.0)
    return spark.read.parquet(f"{sf}/customer.parquet").select(k.alias("id"), F.posexplode(ring).alias("i", "p")).select("id", F.col("i").cast("bigint").alias("i"), "p.x", "p.y")


@query("select p_partkey as id, cast(case when p_size % 4 = 1 then true when p_size % 4 = 2 then p_size > 25 when p_size % 4 = 3 then true else p_partkey % 2 > 0 end as boolean) ok from part")
def p09_value_bands(spark, sf):
    n = F.when(F.col("p_size") % 4 == 0, 4).otherwise(F.col("p_size") % 4)
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), decode.value_valid(n, F.when(F.col("p_size") > 25, 1).otherwise(0), F.col("p_partkey") % 2).alias("ok"))


TAGS = "(1, null, '4', null), (2, '0', '-1', 'x'), (3, '2.5', '4', '1'), (4, 'x', null, '8')"


@query(f"select id, coalesce(case when try_cast(a as double) > 0 then try_cast(a as double) end, case when try_cast(b as double) > 0 then try_cast(b as double) end, case when try_cast(c as double) > 0 then try_cast(c as double) end, 10.0::double) scale from (values {TAGS}) t(id, a, b, c)")
def p11_scale_factor(spark, sf):
    return values(spark, "id, a, b, c", TAGS).select("id", decode.scale_factor([F.col("a"), F.col("b"), F.col("c")]).alias("scale"))


@query("select k as dtype, coalesce(d, case k when 'uint8' then 255 when 'int16' then 32767 when 'uint16' then 65535 when 'int32' then 2147483647 when 'uint32' then 4294967295 end, -9999)::double nodata from (values ('uint8', null), ('int16', null), ('uint16', 7), ('float32', null), ('int32', null)) t(k, d)")
def p12_nodata(spark, sf):
    return values(spark, "dtype, d", "('uint8', null), ('int16', null), ('uint16', 7D), ('float32', null), ('int32', null)").select("dtype", decode.default_nodata(F.col("d").cast("double"), F.col("dtype")).alias("nodata"))


@query(f"with {R.RGB} select tile_x, cast(sum(b0) as bigint) r, cast(sum(case when tile_x < 4 then b0 else b1 end) as bigint) g, cast(sum(case when tile_x < 4 then b0 else b2 end) as bigint) b from rgb group by 1")
def p21_to_rgb(spark, sf):
    rgb = decode.to_rgb(F.when(F.col("tile_x") < 4, 2).otherwise(3), F.col("b0"), F.col("b1"), F.col("b2"))
    return R.rgb(spark, sf).withColumn("c", rgb).groupBy("tile_x").agg(F.sum("c.r").alias("r"), F.sum("c.g").alias("g"), F.sum("c.b").alias("b"))


@query("select o_orderkey as id, octet_length(encode('{\"k\":' || o_orderkey || ',\"s\":\"' || o_orderstatus || 'é\"}')) n from orders")
def p28_payload_bytes(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), text.payload_bytes(F.struct(F.col("o_orderkey").alias("k"), F.concat("o_orderstatus", F.lit("é")).alias("s"))).cast("bigint").alias("n"))


TIMES = "(1, '2026-01-02T03:04:05Z'), (2, 'nope'), (3, null), (4, '2026-01-02 03:04:05')"


@query(f"select id, epoch_us(coalesce(try_cast(replace(replace(s, 'T', ' '), 'Z', '') as timestamp), timestamp '1970-01-01')) us from (values {TIMES}) t(id, s)")
def p27_utc(spark, sf):
    return values(spark, "id, s", TIMES).select("id", F.unix_micros(text.utc(F.col("s"))).alias("us"))


@query(f"with {R.BIOMASS} select cell, case when comp_c - 5000 >= 0 then (comp_c - 5000)::double else 0 end v from biomass")
def p32_clean_density(spark, sf):
    return R.biomass(spark, sf).select("cell", decode.clean_density((F.col("comp_c") - 5000).cast("double")).alias("v"))


LINES = "3 31 141 73 255 # Forest Formation|# comment|5 x 0 0 # bad|short 1||99 1 2 3"


@query(f"with l as (select unnest(string_split('{LINES}', '|')) line), p as (select *, string_split(trim(string_split(line, '#')[1]), ' ') t from l where trim(line) <> '' and not starts_with(trim(line), '#')), v as (select t[1] class_code, try_cast(t[2] as int) r, try_cast(t[3] as int) g, try_cast(t[4] as int) b from p) select class_code, r, g, b from v where r is not null and g is not null and b is not null")
def s13_colour_lines(spark, sf):
    lines = spark.range(1).select(F.explode(F.split(F.lit(LINES), r"\|")).alias("line")).where("trim(line) <> '' and not startswith(trim(line), '#')")
    t = F.split(F.trim(F.substring_index("line", "#", 1)), r"\s+")
    rgb = [F.get(t, F.lit(i)).try_cast("int").alias(n) for i, n in ((1, "r"), (2, "g"), (3, "b"))]
    return lines.select(F.get(t, F.lit(0)).alias("class_code"), *rgb).where("r is not null and g is not null and b is not null")


@query(f"with {R.CELLS}, p as (select tile_x, tile_y, count(*) total, count_if(valid) n, cast(sum(v) filter (valid) as bigint) s from pixels group by 1, 2) select tile_x, cast(sum(total) as bigint) total, cast(sum(n) as bigint) n, cast(sum(s) as bigint) s from p group by 1")
def a02b_merge_partials(spark, sf):
    parts = zonal.tile_partials(R.pixels(spark, sf), TILE)
    return zonal.merge_partials(parts, ["tile_x"]).select("tile_x", "total", "n", "s")


@query(f"with shapes as ({R.shapes_sql()}), {R.EDGES}, g as (select cast(r as int) r, cast(c as int) c from generate_series(0, 11) a(r), generate_series(0, 11) b(c)), k as (select r as \"row\", c as col, id from g, edges where least(y1, y2) <= r + 0.5 and greatest(y1, y2) > r + 0.5 and x1 + (r + 0.5::double - y1) * (x2 - x1) / (y2 - y1) <= c + 0.5 group by 1, 2, 3 having count(*) % 2 = 1) select distinct \"row\", col from k")
def u03_union_mask(spark, sf):
    return polygon.mask_cells(polygon.scanlines(polygon.edges(R.shapes(spark)), 12, 12))


@query("select ord, code from (select 0 s, i ord0, code from (values (0, 'OVL'), (1, 'PT')) t(i, code) union all select 1, i, code from (values (0, '3'), (1, '5')) t(i, code)) u, lateral (select cast(s * 2 + ord0 as int) ord)")
def u04_concat_legends(spark, sf):
    first, second = values(spark, "i, code", "(0, 'OVL'), (1, 'PT')"), values(spark, "i, code", "(0, '3'), (1, '5')")
    both = first.withColumn("s", F.lit(0)).unionByName(second.withColumn("s", F.lit(1)))
    return both.select((F.col("s") * 2 + F.col("i")).alias("ord"), "code")


@query(f"with {R.TRIANGLES}, {R.EDGES} select id, part, ring, x1, y1, x2, y2 from edges")
def w03_ring_edges(spark, sf):
    return polygon.edges(R.triangles(spark, sf))


@query(f"with {R.PAIRS} select b as class_, min(tile_x * 65536 + px_row * 256 + px_col) first_, arg_min(c, (tile_x * 4 + tile_y) * 65536 + px_row * 256 + px_col) c from pairs group by 1")
def w04_first_per_key(spark, sf):
    p = R.pairs(spark, sf).withColumn("_o", (F.col("tile_x") * 4 + F.col("tile_y")) * 65536 + F.col("px_row") * 256 + F.col("px_col"))
    return p.groupBy(F.col("b").alias("class_")).agg(F.min(F.col("tile_x") * 65536 + F.col("px_row") * 256 + F.col("px_col")).alias("first_"), F.min_by("c", "_o").alias("c"))


@query(f"with {R.CELLS} select tile_x, count(*) n from (select distinct tile_x, px_row, px_col from cells where h > 10) group by 1")
def u05_distinct(spark, sf):
    return R.cells(spark, sf).where("h > 10").select("tile_x", *CELL).distinct().groupBy("tile_x").agg(F.count("*").alias("n"))


QUADS = "with p as (select cast(c_custkey as bigint) id, c_custkey % 1024 as x, c_custkey * 7 % 1024 as y from customer)"


@query(f"{QUADS} select id, array_to_string([cast(((x >> (10 - i)) & 1) + 2 * ((y >> (10 - i)) & 1) as varchar) for i in generate_series(1, 10)], '') q from p")
def p05b_quadkeys(spark, sf):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf}/customer.parquet").select(k.cast("bigint").alias("id"), geo.quadkey(F.lit(10), (k % 1024).cast("int"), (k * 7 % 1024).cast("int")).alias("q"))


def _utm_sql() -> str:
    """The third-order series, its constants worked out here."""
    n = geo.FLATTENING / (2 - geo.FLATTENING)
    radius = geo.A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240
    e = 2 * n**0.5 / (1 + n)
    term = lambda f, g: " + ".join(f"{a!r}::double * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    scale = f"{geo.K0 * radius!r}::double"
    return f"""t as (select *, sinh(atanh(sin(radians(lat))) - {e!r}::double * atanh({e!r}::double * sin(radians(lat)))) t, radians(lon - (floor((lon + 180) / 6) * 6 - 177)) d from p),
u as (select *, atan2(t, cos(d)) xi, atanh(sin(d) / sqrt(1 + t * t)) eta from t)
select id, cast(case when lat >= 0 then 32600 else 32700 end + floor((lon + 180) / 6) + 1 as int) epsg,
  cast(floor((500000 + {scale} * (eta + {term('cos', 'sinh')})) * 1000 + 0.5) as bigint) easting_mm,
  cast(floor((case when lat < 0 then 10000000 else 0 end + {scale} * (xi + {term('sin', 'cosh')})) * 1000 + 0.5) as bigint) northing_mm from u"""


@query(f"with p as ({PLACES}), {_utm_sql()}")
def p03_utm(spark, sf):
    p = _places(spark, sf)
    x, y = geo.to_utm(F.col("lon"), F.col("lat"))
    return p.select("id", geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"), _micro(x).alias("easting_mm"), _micro(y).alias("northing_mm"))


@query(f"with {R.TRIANGLES}, {R.EDGES}, a as (select id, abs(sum(x1 * y2 - x2 * y1)) / 2 area from edges group by id) select id, area from a where area > 0")
def g01_slab_area(spark, sf):
    return polygon.slab_areas(polygon.edges(R.triangles(spark, sf)))


@query(f"with shapes as ({R.shapes_sql()}), a as (select * from (values (1, 28.5::double), (2, 84.0::double), (3, 32.0::double)) t(id, area)) select id, area from a")
def g01b_crossing_area(spark, sf):
    return polygon.slab_areas(polygon.edges(R.shapes(spark))).select("id", F.round("area", 9).alias("area"))


@query("select cast(c_custkey as bigint) id, 'https://store.example/agb/' || 'global_agb_100m_landsat0024_all_' || cast(1990 + c_custkey % 35 as varchar) || '_densenet_l1_agb_mosaic_100m_base_cd_ts' || case when c_custkey % 2 = 1 then '_uncertainty_sem.tif' else '.tif' end url from customer")
def s18_raster_url(spark, sf):
    k = F.col("c_custkey")
    variable = F.when(k % 2 == 1, "uncertainty").otherwise("agb")
    return spark.read.parquet(f"{sf}/customer.parquet").select(k.cast("bigint").alias("id"), text.raster_url((1990 + k % 35).cast("int"), variable, "https://store.example", "/agb/").alias("url"))


@query(f"with {R.CELLS}, s as (select tile_x, max(px_row) + 1 r1, max(px_col) + 1 c1, max(px_row) filter (px_row < 252 + tile_x) + 1 r2, max(px_col) filter (px_row < 252 + tile_x) + 1 c2 from pixels group by 1) select tile_x, cast(r1 as int) base_rows, cast(c1 as int) base_cols, cast(r2 as int) comp_rows, cast(c2 as int) comp_cols from s where r2 is not null and (r1 <> r2 or c1 <> c2)")
def f22_tile_sizes(spark, sf):
    p = R.pixels(spark, sf)
    out = tiles.mismatched_tiles(p, p.where("px_row < 252 + tile_x"), ["tile_x"], ("px_row", "px_col"))
    return out.select("tile_x", *[F.col(f"{y}.{c}").cast("int").alias(f"{y}_{c}") for y in ("base", "comp") for c in ("rows", "cols")])


POINTS = "select cast(c_custkey as bigint) id, c_custkey % 4 k, c_custkey % 400 - 200 x, c_custkey * 3 % 190 - 95 y from customer"


@query(f"with p as ({POINTS}) select id, cast(x as double) x, cast(y as double) y, case when abs(x) > 180 or abs(y) > 90 then 'bounds' end problem from p where k < 3")
def g05_overlay_point(spark, sf):
    """Points, many points and collections by turns; every fourth feature is a polygon, which has none."""
    p = spark.sql("select * from {t}", t=spark.read.parquet(f"{sf}/customer.parquet")).selectExpr("cast(c_custkey as bigint) id", "c_custkey % 4 k", "c_custkey % 400 - 200 x", "c_custkey * 3 % 190 - 95 y")
    at = F.format_string("[%d,%d]", "x", "y")
    many = F.concat(F.lit('{"type":"MultiPoint","coordinates":['), at, F.lit(",[1,2]]}"))
    one = F.concat(F.lit('{"type":"Point","coordinates":'), at, F.lit("}"))
    ring = F.lit('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}')
    both = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), ring, F.lit(","), one, F.lit("]}"))
    shape = F.when(F.col("k") == 0, one).when(F.col("k") == 1, many).when(F.col("k") == 2, both).otherwise(ring)
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit("}"))
    _, points = parts.split(p.select("id", feature.alias("json")), "json")
    return parts.overlay_point(points)


@query(
    f"""with {R.TRIANGLES}, {R.EDGES}, e as (select *, least(y1, y2) lo, greatest(y1, y2) hi from edges),
r as (select *, unnest(generate_series(cast(floor(lo) as int), cast(least(11, floor(hi)) as int))) as "row" from e),
s as (select *, case when y1 = y2 then x1 else x1 + (greatest("row", lo) - y1) * (x2 - x1) / (y2 - y1) end a, case when y1 = y2 then x2 else x1 + (least("row" + 1, hi) - y1) * (x2 - x1) / (y2 - y1) end b from r),
l as (select "row", unnest(generate_series(cast(floor(least(a, b)) as int), cast(least(11, floor(greatest(a, b))) as int))) as col from s),
g as (select cast(r as int) r, cast(c as int) c from generate_series(0, 11) a(r), generate_series(0, 11) b(c)),
k as (select id, r, c from g, edges where least(y1, y2) <= r + 0.5 and greatest(y1, y2) > r + 0.5 and x1 + (r + 0.5::double - y1) * (x2 - x1) / (y2 - y1) <= c + 0.5 group by 1, 2, 3 having count(*) % 2 = 1)
select "row", col from l union select r, c from k"""
)
def f02_all_touched(spark, sf):
    return polygon.all_touched(polygon.edges(R.triangles(spark, sf)), 12, 12)


@query(f"with {R.CELLS}, b as (select * from pixels where v > 25) select count(*) n from b where not exists (select 1 from pixels p where p.tile_x = b.tile_x and p.tile_y = b.tile_y and p.px_row = b.px_row and p.px_col = b.px_col and p.v < 30)")
def f23b_misaligned(spark, sf):
    p = R.pixels(spark, sf)
    keys = [*TILE, *CELL]
    return change.misaligned(p.where("v > 25"), p.where("v < 30"), keys).join(p.where("v > 25").select(*keys), keys, "left_semi").agg(F.count("*").alias("n"))


@query(f"with {R.CELLS} select tile_x, px_row // 128 as \"row\", px_col // 128 as col, sum(v) / count(*) v from pixels where valid group by all")
def a19b_coarse_overview(spark, sf):
    return tiles.overview(R.pixels(spark, sf).withColumnsRenamed({"px_row": "row", "px_col": "col"}), ["tile_x"], 128)
