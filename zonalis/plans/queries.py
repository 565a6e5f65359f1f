"""The catalogue: one query for each operator, over relations derived from the driver's tables, and the
DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode, geo, hist, text
from ..operators import change, jobs, legend, polygon, tiles, zonal
from . import relations as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TILE = ["tile_x", "tile_y"]
CELL = ["px_row", "px_col"]
THRESHOLDS = (5, 10, 20)


def plain_counts(sql: str) -> str:
    """count_if as a count, which is a BIGINT in DuckDB."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(case when {sql[at + 9 : end - 1]} then 1 end){sql[end:]}"
    return sql


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = plain_counts(sql)
        return f

    return register


def values(spark: SparkSession, columns: str, rows: str) -> DataFrame:
    return spark.sql(f"select * from values {rows} t({columns})")


PARTS = "count(*) total, count_if(valid) n, cast(coalesce(sum(v) filter (valid), 0) as bigint) s, cast(coalesce(sum(v * v) filter (valid), 0) as bigint) s2, min(v) filter (valid) lo, max(v) filter (valid) hi, cast(coalesce(sum(area) filter (valid), 0) as bigint) valid_area, cast(sum(area) as bigint) total_area, cast(coalesce(sum(v * area) filter (valid), 0) as bigint) volume"
HITS = ", ".join(f"count_if(valid and v >= {t}) n_ge_{t}" for t in THRESHOLDS)
BIN = "least(cast(floor(v * 512.0::double / 120.0::double) as int), 511)"


def quantile_sql(source: str, key: str) -> str:
    """CTEs cum and q over source(key, bin, n): quantiles within their bins."""
    picks = ", ".join(
        f"min_by(bin * 120.0::double / 512 + (120.0::double / 512) * greatest(0.0::double, least(1.0::double, ({q}::double * tot - (cum - n)) / n)), bin) filter (cum >= {q}::double * tot) p{round(100 * q)}" for q in zonal.QUANTILES
    )
    return f"cum as (select *, sum(n) over (partition by {key} order by bin) cum, sum(n) over (partition by {key}) tot from {source}), q as (select {key}, {picks} from cum group by {key})"


@query(f"with {R.CELLS} select tile_x, tile_y, {PARTS}, {HITS} from pixels group by tile_x, tile_y")
def a01_tile_partials(spark, sf):
    return zonal.tile_partials(R.pixels(spark, sf), TILE, THRESHOLDS)


@query(
    f"""with {R.CELLS}, p as (select zone, {PARTS}, {HITS} from pixels group by zone),
m as (select *, s / n mean_, greatest(0.0::double, s2 / n - (s / n) * (s / n)) var_ from p),
h as (select zone, {BIN} bin, count(*) n from pixels where valid group by 1, 2), {quantile_sql('h', 'zone')}
select zone, r_name as name, total, n, lo, hi, mean_ as mean, var_ as variance, sqrt(var_) stddev, sqrt(var_) / mean_ cv, p10, p25, p50, p75, p90, p95, p75 - p25 iqr,
valid_area, total_area, volume, n / total coverage, n_ge_5 / n cover_5, n_ge_10 / n cover_10, n_ge_20 / n cover_20
from m join q using (zone) join region on zone = r_regionkey"""
)
def a02_zonal_summary(spark, sf):
    names = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").cast("int").alias("zone"), F.col("r_name").alias("name"))
    return zonal.zonal_summary(R.pixels(spark, sf), ["zone"], THRESHOLDS).join(names, "zone")


@query(f"with {R.CELLS}, p as (select zone, {PARTS} from pixels group by zone), m as (select zone, s / n mean, greatest(0.0::double, s2 / n - (s / n) * (s / n)) variance from p) select zone, mean, variance, sqrt(variance) stddev, case when mean > 0 then sqrt(variance) / mean else 0 end cv from m")
def a03_moments(spark, sf):
    p = zonal.merge_partials(zonal.tile_partials(R.pixels(spark, sf), [*TILE, "zone"]), ["zone"])
    return p.select("zone", *[c.alias(k) for k, c in zonal.moments(F.col("n"), F.col("s"), F.col("s2")).items()])


@query(f"with {R.BIOMASS} select count(*) n, sum(comp_c) / count(*) mean, (sum(comp_c * comp_c) * count(*) - sum(comp_c) * sum(comp_c)) / (count(*) * count(*)) variance from biomass where comp_c is not null")
def a04_exact_variance(spark, sf):
    c = R.biomass(spark, sf).where("comp_c is not null")
    n, s, s2 = F.count("*"), F.sum("comp_c"), F.sum(F.col("comp_c") * F.col("comp_c"))
    return c.agg(n.alias("n"), (s / n).alias("mean"), ((s2 * n - s * s) / (n * n)).alias("variance"))


@query(f"with {R.CELLS} select zone, {BIN} bin, count(*) n from pixels where valid group by 1, 2")
def a05_histogram(spark, sf):
    return zonal.histogram(R.pixels(spark, sf), ["zone"], 0.0, 120.0, 512)


@query(
    f"""with {R.BIOMASS}, v as (select cell % 4 as grp, comp_c v from biomass where comp_c is not null),
r as (select grp, least(1000.0::double, min(v)) range_lo, greatest(30000.0::double, max(v)) range_hi from v group by grp)
select grp, range_lo, range_hi, least(cast(floor((v - range_lo) * 64 / (range_hi - range_lo)) as int), 63) bin, count(*) n from v join r using (grp) group by all"""
)
def a06_adaptive_hist(spark, sf):
    own = R.biomass(spark, sf).where("comp_c is not null").select((F.col("cell") % 4).alias("grp"), F.col("comp_c").alias("v"), F.lit(True).alias("valid"))
    return zonal.adaptive_histogram(own, ["grp"], 1000.0, 30000.0, 64)


@query(f"with {R.CELLS}, h as (select zone, {BIN} bin, count(*) n from pixels where valid group by 1, 2), {quantile_sql('h', 'zone')} select * from q")
def a07_hist_quantiles(spark, sf):
    return zonal.histogram_quantiles(zonal.histogram(R.pixels(spark, sf), ["zone"], 0.0, 120.0, 512), ["zone"], 0.0, 120.0, 512)


@query(f"with {R.CELLS} select zone, {', '.join(f'quantile_cont(v, {q}) p{round(100 * q)}' for q in zonal.QUANTILES)}, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) iqr from pixels where valid group by zone")
def a08_exact_quantiles(spark, sf):
    return zonal.exact_quantiles(R.pixels(spark, sf), ["zone"]).withColumn("iqr", F.col("p75") - F.col("p25"))


@query(f"with {R.CELLS}, p as (select zone, {PARTS} from pixels group by zone), t as (select unnest([5.0::double, 10.0, 20.0]) threshold), x as (select zone, threshold, count_if(valid and v >= threshold) hits from pixels, t group by 1, 2) select zone, threshold, hits, hits / n ratio, 100 * (hits / n) percent, valid_area * (hits / n) area from x join p using (zone)")
def a10_threshold_cover(spark, sf):
    return zonal.threshold_cover(zonal.tile_partials(R.pixels(spark, sf), ["zone"], THRESHOLDS), ["zone"], THRESHOLDS)


@query(
    f"""with {R.CELLS}, r as (select * from (values (null::double, 5.0::double, '<5m'), (5.0, 10.0, '5-10m'), (10.0, 20.0, '10-20m'), (20.0, null, '>=20m')) t(lower, upper, label))
select zone, lower, upper, label, count_if(valid and (lower is null or v >= lower) and (upper is null or v < upper)) hits from pixels, r group by all"""
)
def a11_range_cover(spark, sf):
    parts = zonal.tile_partials(R.pixels(spark, sf), ["zone"], THRESHOLDS)
    return zonal.range_cover(zonal.threshold_cover(parts, ["zone"], THRESHOLDS), parts, ["zone"])


FOREST = "(3, 5, 76)"
CHANGE = f"f as (select *, b <> 27 and c <> 27 as ok, b in {FOREST} and b <> 27 and c <> 27 as fb, c in {FOREST} and b <> 27 and c <> 27 as fc from pairs)"
COUNTS = "count(*) total, count_if(ok) valid, count_if(fb and not fc) loss, count_if(not fb and fc) gain, count_if(fb) base_forest, count_if(fc) comp_forest"


def _change(spark, sf, keys, area=None):
    p = R.pairs(spark, sf)
    return change.forest_change(p, keys, F.col("b").isin(*change.FOREST), F.col("c").isin(*change.FOREST), (F.col("b") != 27) & (F.col("c") != 27), area)


@query(f"with {R.PAIRS}, {CHANGE} select tile_x, tile_y, {COUNTS} from f group by all")
def a12_forest_change(spark, sf):
    return _change(spark, sf, TILE)


@query(f"with {R.BIOMASS} select cell % 4 as grp, count(*) common, cast(sum(greatest(comp_c - base_c, 0)) as bigint) increase, cast(sum(greatest(base_c - comp_c, 0)) as bigint) decrease, count_if(comp_c > base_c) up_cells, count_if(comp_c < base_c) down_cells from biomass where base_c is not null and comp_c is not null group by 1")
def a13_signed_delta(spark, sf):
    return change.signed_delta(R.biomass(spark, sf).withColumn("grp", F.col("cell") % 4), ["grp"], F.col("base_c"), F.col("comp_c"))


FLAGS = """flags as (select tile_x, tile_y, bool_and(b2 = 0) blue_zero, bool_and(b1 = 0) green_zero, quantile_cont(case when b0 * 256 + b1 > 0 then b0 * 256 + b1 end, 0.95) p95,
  coalesce(bool_or(b0 > 0) and (bool_and(b0 <= 0 or (b1 = 127 and b2 = 0)) or bool_and(b0 <= 0 or (b1 = 0 and b2 = 0))), false) encoded from rgb group by 1, 2)"""


@query(f"with {R.RGB}, {FLAGS} select * from flags")
def a14_tile_flags(spark, sf):
    return tiles.tile_flags(R.rgb(spark, sf), TILE)


@query(f"with {R.CELLS} select tile_x, tile_y, count_if(valid) / count(*) of_aoi, count_if(valid) / 65536 of_window from pixels group by 1, 2")
def a15_coverage_both(spark, sf):
    return zonal.coverage(zonal.tile_partials(R.pixels(spark, sf), TILE), TILE, F.lit(65536))


@query(f"with {R.PAIRS}, {CHANGE} select {COUNTS}, {', '.join(f'cast(coalesce(sum(100 + tile_x) filter ({w}), 0) as bigint) {n}_area' for n, w in (('total', 'true'), ('valid', 'ok'), ('loss', 'fb and not fc'), ('gain', 'not fb and fc'), ('base_forest', 'fb'), ('comp_forest', 'fc')))} from f")
def a16_area_totals(spark, sf):
    return _change(spark, sf, [], (F.col("tile_x") + 100).cast("bigint"))


@query(f"with {R.PAIRS}, {CHANGE}, k as (select tile_x, {COUNTS} from f group by 1) select *, 100.0::double * loss / valid loss_pct, 100.0::double * gain / valid gain_pct, comp_forest - base_forest net, valid / total coverage, case when base_forest > 0 then 100.0::double * (comp_forest - base_forest) / base_forest else 0 end net_pct from k")
def a17_net_change(spark, sf):
    rates = change.change_rates(_change(spark, sf, ["tile_x"]))
    return rates.withColumn("net_pct", change.net_change(F.col("base_forest"), F.col("comp_forest"), F.col("valid"))["net_pct"])


@query(f"with {R.CELLS} select tile_x, min(v) filter (v <> 7) lo, max(v) filter (v <> 7) hi, count_if(v <> 7) n, count(*) total, count_if(v <> 7) / count(*) fraction from pixels group by 1")
def a18_band_stats(spark, sf):
    return tiles.band_stats(R.pixels(spark, sf), ["tile_x"], "v", decode.band_valid(F.col("v"), F.lit(7), False))


@query(f"with {R.CELLS} select tile_x, tile_y, px_row // 8 as \"row\", px_col // 8 as col, sum(v) / count(*) v from pixels where valid group by all")
def a19_overview(spark, sf):
    return tiles.overview(R.pixels(spark, sf).withColumnsRenamed({"px_row": "row", "px_col": "col"}), TILE, 8)


@query(f"with {R.CELLS} select px_row, px_col, min_by(v, tile_x * 4 + tile_y) v, min(tile_x * 4 + tile_y) ord from pixels where valid group by 1, 2")
def a20_mosaic_first(spark, sf):
    return tiles.mosaic_first(R.pixels(spark, sf).withColumn("ord", F.col("tile_x") * 4 + F.col("tile_y")), CELL, "ord", "v")


@query(f"with shapes as ({R.shapes_sql()}), {R.EDGES}, r as (select id, ring, sum(x1 * y2 - x2 * y1) / 2 a from edges group by 1, 2) select id, sum(case when ring = 0 then abs(a) else -abs(a) end) area from r group by id")
def a22_shoelace(spark, sf):
    return polygon.polygon_areas(polygon.edges(R.shapes(spark)))


@query(f"with {R.JOBS}, s as (select unnest(['deferred', 'queued', 'running', 'succeeded', 'partial_success', 'failed', 'cancelled']) status) select s.status, count(job_id) n from s left join jobs on s.status = jobs.status group by 1")
def a23_status_counts(spark, sf):
    return jobs.status_counts(R.jobs(spark, sf))


@query(f"with {R.JOBS} select count_if(status in ('deferred', 'queued', 'running')) pending, count_if(status in ('queued', 'running')) active from jobs")
def a24_pending(spark, sf):
    return jobs.pending(R.jobs(spark, sf))


@query(f"with {R.CELLS} select tile_x + 2000 as \"year\", sum(case when valid then v else 0 end) / count(*) mean from pixels group by 1")
def a25_yearly_mean(spark, sf):
    cube = R.pixels(spark, sf).select((F.col("tile_x") + 2000).alias("year"), decode.clean_density(F.when(F.col("valid"), F.col("v").cast("double"))).alias("value"))
    return zonal.yearly_mean(cube, "year", F.col("value"))


@query(f"with {R.CELLS} select quantile_cont(v, 0.02) q02, quantile_cont(v, 0.98) q98 from pixels where valid")
def a26_global_quantiles(spark, sf):
    counts = R.pixels(spark, sf).where("valid").groupBy("v").agg(F.count("*").alias("n"))
    return counts.agg(F.percentile("v", F.lit(0.02), F.col("n")).alias("q02"), F.percentile("v", F.lit(0.98), F.col("n")).alias("q98"))


@query(f"with {R.CELLS} select tile_x, cast(v as int) bin, cast(sum(area) as bigint) weight, sum(v * area) / 1e9::double volume_km3 from pixels where valid and v <= 49 group by 1, 2")
def a27_weighted_hist(spark, sf):
    return zonal.weighted_histogram(R.pixels(spark, sf), ["tile_x"], 50)


@query(
    f"""with shapes as ({R.shapes_sql()}), {R.EDGES}, c as (select *, x1 * y2 - x2 * y1 k from edges),
r as (select id, ring, sum(k) / 2 a, sum((x1 + x2) * k) sx, sum((y1 + y2) * k) sy, min(x1) x0, max(x1) x9, min(y1) y0, max(y1) y9 from c group by id, part, ring),
t as (select *, sign(a) * case when ring = 0 then 1 else -1 end s from r),
w as (select id, sum(s * a) a, sum(s * sx) sx, sum(s * sy) sy, (min(x0) + max(x9)) / 2 mid_x, (min(y0) + max(y9)) / 2 mid_y from t group by id)
select id, cast(case when a <> 0 then sx / (6 * a) end as float) x, cast(case when a <> 0 then sy / (6 * a) end as float) y, mid_x, mid_y from w"""
)
def a28_centroid(spark, sf):
    return polygon.centroids(polygon.edges(R.shapes(spark))).select("id", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), "mid_x", "mid_y")


@query(f"with {R.REQUESTS} select method as source, count(*) n, cast(sum(us % 1000) as bigint) bytes from requests group by 1")
def a29_range_counts(spark, sf):
    return R.requests(spark, sf).groupBy(F.col("method").alias("source")).agg(F.count("*").alias("n"), F.sum(F.col("us") % 1000).alias("bytes"))


BOXES = "(1, 95.2, -6.4, 106.8, 5.5), (2, 106.7, -6.4, 106.8, -6.3), (3, -180.0, -90.0, 180.0, 90.0), (4, 0.0, 0.0, 11.25, 11.0)"
COVER = """t as (select *, least(n - 1, greatest(0, floor((west + 180.0::double) / 360.0::double * n))) x0, least(n - 1, greatest(0, floor((east - 1e-11::double + 180.0::double) / 360.0::double * n))) x1,
  least(n - 1, greatest(0, floor((1 - ln(tan(radians(least(85.0511287798066::double, greatest(-85.0511287798066::double, north)))) + 1 / cos(radians(least(85.0511287798066::double, greatest(-85.0511287798066::double, north))))) / pi()) / 2 * n))) y0,
  least(n - 1, greatest(0, floor((1 - ln(tan(radians(least(85.0511287798066::double, greatest(-85.0511287798066::double, south + 1e-11::double)))) + 1 / cos(radians(least(85.0511287798066::double, greatest(-85.0511287798066::double, south + 1e-11::double))))) / pi()) / 2 * n))) y1 from z)"""


def _boxes_sql(zooms: str) -> str:
    return f"b as (select * from (values {BOXES}) t(id, west, south, east, north)), z as (select id, west::double west, south::double south, east::double east, north::double north, z, pow(2.0::double, z) n from b, (select unnest({zooms}) z)), {COVER}"


def _boxes(spark):
    return values(spark, "id, west, south, east, north", BOXES).select("id", *[F.col(c).cast("double").alias(c) for c in ("west", "south", "east", "north")])


@query(f"with {R.BOXES}, z as (select id, west, south, east, north, 5 z, pow(2.0::double, 5) n from b), {COVER} select id, z, unnest(generate_series(cast(x0 as int), cast(x1 as int))) x, y from (select *, unnest(generate_series(cast(y0 as int), cast(y1 as int))) y from t)")
def j01_tile_cover(spark, sf):
    return tiles.tile_cover(R.boxes(spark, sf), F.lit(5)).select("id", "z", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))


GRID_TILES = "select 'q' || gx || '_' || gy as tile, gx * 2.0::double as west, gy * 2.0::double as south, gx * 2.0::double + 2 as east, gy * 2.0::double + 2 as north from generate_series(0, 5) a(gx), generate_series(0, 5) b(gy)"


@query(
    f"""with {R.TRIANGLES}, {R.EDGES}, g as ({GRID_TILES}),
p as (select id, tile, west, south, east, north, x1, y1, x2, y2 from edges, g),
s as (select *, (x2 - x1) * (south - y1) - (y2 - y1) * (west - x1) k1, (x2 - x1) * (north - y1) - (y2 - y1) * (west - x1) k2, (x2 - x1) * (south - y1) - (y2 - y1) * (east - x1) k3, (x2 - x1) * (north - y1) - (y2 - y1) * (east - x1) k4 from p),
f as (select id, tile, bool_or(least(x1, x2) <= east and greatest(x1, x2) >= west and least(y1, y2) <= north and greatest(y1, y2) >= south and least(k1, k2, k3, k4) <= 0 and greatest(k1, k2, k3, k4) >= 0) touch,
  count_if(least(y1, y2) <= south and greatest(y1, y2) > south and x1 + (south - y1) * (x2 - x1) / nullif(y2 - y1, 0) > west) n from s group by 1, 2)
select id, tile from f where touch or n % 2 = 1"""
)
def j02_bbox_tile_join(spark, sf):
    g = spark.range(36).select(F.floor(F.col("id") / 6).alias("gx"), (F.col("id") % 6).alias("gy"))
    grid = g.select(F.concat(F.lit("q"), "gx", F.lit("_"), "gy").alias("tile"), (F.col("gx") * 2.0).alias("west"), (F.col("gy") * 2.0).alias("south"), (F.col("gx") * 2.0 + 2).alias("east"), (F.col("gy") * 2.0 + 2).alias("north"))
    return polygon.intersecting_tiles(polygon.edges(R.triangles(spark, sf)), grid)


@query(
    f"""with {R.CELLS}, b as (select * from pixels where tile_x <> 6 and v % 3 <> 0), c as (select * from pixels where tile_x <> 7 and v % 5 <> 0)
select coalesce(b.tile_x, c.tile_x) tile_x, count(*) total, count_if(b.v is not null and c.v is not null and b.valid and c.valid) joint,
  bool_or(coalesce(b.tile_x, c.tile_x) not in (6, 7)) both_tiles from b full join c using (tile_x, tile_y, px_row, px_col) group by 1"""
)
def j03_two_year_join(spark, sf):
    p = R.pixels(spark, sf).select(*TILE, *CELL, "v", "valid")
    both = change.two_years(p.where("tile_x <> 6 and v % 3 <> 0"), p.where("tile_x <> 7 and v % 5 <> 0"), ["tile_x"], ["tile_y", *CELL])
    return both.groupBy("tile_x").agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("base.valid") & F.col("comp.valid"), F.lit(False))).alias("joint"), F.bool_or("both_tiles").alias("both_tiles"))


TARGET, SOURCE = {"x0": 0.0, "y0": 300.0, "width": 0.75, "height": 0.75, "rows": 400, "cols": 400}, {"x0": 10.0, "y0": 290.0, "width": 1.0, "height": 1.0, "rows": 256, "cols": 256}


@query(
    f"""with {R.CELLS}, s as (select px_row, px_col, max(v) v from pixels group by 1, 2),
t as (select cast(r as int) as \"row\", cast(c as int) col from generate_series(0, 399) a(r), generate_series(0, 399) b(c))
select t.\"row\", t.col, s.v from t left join s on cast(floor((290.0::double - (300.0::double - (t.\"row\" + 0.5::double) * 0.75::double)) / 1.0::double) as int) = s.px_row and cast(floor(((t.col + 0.5::double) * 0.75::double - 10.0::double) / 1.0::double) as int) = s.px_col"""
)
def j04_nearest_align(spark, sf):
    source = R.pixels(spark, sf).groupBy(F.col("px_row").alias("row"), F.col("px_col").alias("col")).agg(F.max("v").alias("v"))
    target = spark.range(160_000).select(F.floor(F.col("id") / 400).cast("int").alias("row"), (F.col("id") % 400).cast("int").alias("col"))
    return tiles.align_nearest(target, source, TARGET, SOURCE)


@query(
    f"""with {R.CELLS}, shapes as ({R.shapes_sql(21.0)}), {R.EDGES},
g as (select cast(r as int) r, cast(c as int) c from generate_series(0, 255) a(r), generate_series(0, 255) b(c)),
k as (select g.r, g.c, id from g, edges where least(y1, y2) <= r + 0.5 and greatest(y1, y2) > r + 0.5 and x1 + (r + 0.5::double - y1) * (x2 - x1) / (y2 - y1) <= c + 0.5 group by 1, 2, 3 having count(*) % 2 = 1),
m as (select distinct r, c from k)
select tile_x, tile_y, count(*) total, count_if(valid) n, cast(sum(v) as bigint) s from pixels join m on px_row = r and px_col = c group by 1, 2"""
)
def j05_scanline_mask(spark, sf):
    spans = polygon.scanlines(polygon.edges(R.shapes(spark, 21.0)), 256, 256)
    inside = polygon.mask_pixels(R.pixels(spark, sf), spans, *CELL)
    return inside.groupBy(*TILE).agg(F.count("*").alias("total"), F.count_if("valid").alias("n"), F.sum("v").alias("s"))


@query(f"with {R.TRIANGLES}, {R.EDGES}, g as (select cast(r as int) r, cast(c as int) c from generate_series(0, 11) a(r), generate_series(0, 11) b(c)), k as (select id, r as \"row\", c as col from g, edges where least(y1, y2) <= r + 0.5 and greatest(y1, y2) > r + 0.5 and x1 + (r + 0.5::double - y1) * (x2 - x1) / (y2 - y1) <= c + 0.5 group by 1, 2, 3 having count(*) % 2 = 1) select id, \"row\", col from k")
def f01_mask_cells(spark, sf):
    spans = polygon.scanlines(polygon.edges(R.triangles(spark, sf)), 12, 12)
    return spans.select("id", "row", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("col"))


@query(f"with {R.CELLS}, t as (select unnest(generate_series(5, 50, 5)) threshold) select threshold, count(*) hits, cast(sum(v) as bigint) s from pixels, t where valid and v >= threshold group by 1")
def j06_threshold_crossjoin(spark, sf):
    """The pixels are counted by value first, so a threshold meets values and not pixels."""
    counts = R.pixels(spark, sf).where("valid").groupBy("v").agg(F.count("*").alias("n"))
    at = counts.where("v >= 5").withColumn("threshold", F.explode(F.sequence(F.lit(5).cast("bigint"), F.col("v") - F.col("v") % 5, F.lit(5).cast("bigint"))))
    return at.groupBy("threshold").agg(F.sum("n").alias("hits"), F.sum(F.col("n") * F.col("v")).alias("s"))


LEGEND_VALUES = ", ".join(f"({i}, '{c}', 'Class {c}')" for i, c in enumerate(R.CODES[:12]))


@query(f"with {R.PAIRS}, l as (select * from (values {LEGEND_VALUES}) t(ord, code, label)) select b as class_, label, count(*) n from pairs left join l on cast(b as varchar) = code group by 1, 2")
def j07_legend_lookup(spark, sf):
    entries = values(spark, "ord, code, label", LEGEND_VALUES)
    counts = R.pairs(spark, sf).groupBy(F.col("b").alias("class_")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(entries), F.col("class_").cast("string") == F.col("code"), "left").select("class_", "label", "n")


@query(f"with {_boxes_sql('[4]')}, y as (select unnest(generate_series(1990, 2024)) as \"year\") select \"year\", id, z, x, y from y, (select id, z, y, unnest(generate_series(cast(x0 as int), cast(x1 as int))) x from (select *, unnest(generate_series(cast(y0 as int), cast(y1 as int))) y from t)) u")
def j08_year_tile_grid(spark, sf):
    cover = tiles.tile_cover(_boxes(spark), F.lit(4)).select("id", "z", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))
    return cover.withColumn("year", F.explode(F.sequence(F.lit(1990).cast("bigint"), F.lit(2024).cast("bigint"))))


@query(f"with {R.CELLS}, d as (select distinct tile_x, tile_y from pixels) select x as tile_x, y as tile_y from generate_series(0, 9) a(x), generate_series(0, 4) b(y) where not exists (select 1 from d where tile_x = x and tile_y = y)")
def j09_missing_tiles_anti(spark, sf):
    wanted = spark.range(50).select(F.floor(F.col("id") / 5).alias("tile_x"), (F.col("id") % 5).alias("tile_y"))
    return tiles.missing_tiles(wanted, R.pixels(spark, sf).select(*TILE).distinct(), TILE)


@query(f"with {R.JOBS} select k as job_id, status, case when status is null then 404 when status in ('succeeded', 'partial_success') then 200 else 409 end code from (select unnest(generate_series(1, 200)) k) left join jobs on k = job_id")
def j10_job_lookup(spark, sf):
    wanted = spark.range(1, 201).withColumnRenamed("id", "job_id")
    return wanted.join(R.jobs(spark, sf), "job_id", "left").select("job_id", "status", jobs.download_code(F.col("status")).alias("code"))


PLACES = "select cast(c_custkey as bigint) id, c_custkey % 360 - 180 + 0.25::double lon, c_custkey % 160 - 80 + 0.5::double lat from customer"


def _places(spark, sf):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf}/customer.parquet").select(k.cast("bigint").alias("id"), (k % 360 - 180 + F.lit(0.25)).alias("lon"), (k % 160 - 80 + F.lit(0.5)).alias("lat"))


def _micro(c):
    return F.floor(c * 1000 + 0.5).cast("bigint")


@query(f"with p as ({PLACES}) select id, cast(floor(6378137.0::double * radians(lon) * 1000 + 0.5) as bigint) x, cast(floor(6378137.0::double * ln(tan(pi() / 4 + radians(lat) / 2)) * 1000 + 0.5) as bigint) y from p")
def p01_mercator(spark, sf):
    p = _places(spark, sf)
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    return p.select("id", _micro(x).alias("x"), _micro(y).alias("y"))


@query(f"with p as ({PLACES}) select id, cast(floor(lon * 1000 + 0.5) as bigint) x, cast(floor(lat * 1000 + 0.5) as bigint) y from p")
def p02_inverse_mercator(spark, sf):
    p = _places(spark, sf)
    lon, lat = geo.from_mercator(*geo.to_mercator(F.col("lon"), F.col("lat")))
    return p.select("id", _micro(lon).alias("x"), _micro(lat).alias("y"))


@query(f"with p as ({PLACES}) select id, cast(case when lat >= 0 then 32600 else 32700 end + floor((lon + 180) / 6) + 1 as int) epsg from p")
def p04_utm_zone(spark, sf):
    return _places(spark, sf).select("id", geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query(f"select cast(z as int) z, cast(floor(power({geo.CIRCUMFERENCE!r}::double / power(2, z) / 256, 2) + 0.5) as bigint) area_m2, {geo.CIRCUMFERENCE!r}::double / power(2.0::double, z) side from generate_series(0, 14) t(z)")
def p05_pixel_area(spark, sf):
    z = F.col("id").cast("int")
    return spark.range(15).select(z.alias("z"), F.floor(geo.pixel_area_ha(z, F.lit(256), F.lit(256)) * 10000 + 0.5).cast("bigint").alias("area_m2"), geo.tile_side(z).alias("side"))


@query(f"with {R.CELLS} select tile_x, tile_y, px_row, px_col, tile_x * 256.0::double + (px_col + 0.5::double) * 1.0::double x, 1024.0::double - tile_y * 256.0::double - (px_row + 0.5::double) * 1.0::double y from cells")
def p06_pixel_centre(spark, sf):
    x, y = geo.pixel_centre(F.col("tile_x") * 256.0, F.lit(1024.0) - F.col("tile_y") * 256.0, F.lit(1.0), F.lit(1.0), F.col("px_row"), F.col("px_col"))
    return R.cells(spark, sf).select(*TILE, *CELL, x.alias("x"), y.alias("y"))


LUMA = "cast(b0 * 0.2126::double + b1 * 0.7152::double + b2 * 0.0722::double as float)"


@query(f"with {R.RGB}, {FLAGS} select tile_x, tile_y, px_row, px_col, case when blue_zero and green_zero then cast(b0 as float) * cast(0.4 as float) when blue_zero and p95 > 255 then cast(b0 * 256 + b1 as float) / cast(10 as float) when blue_zero then cast(b0 as float) else {LUMA} end v from rgb join flags using (tile_x, tile_y)")
def p07_height_decode(spark, sf):
    return tiles.decode_tiles(R.rgb(spark, sf), TILE, "height").drop("b0", "b1", "b2")


@query(f"with {R.RGB}, {FLAGS} select tile_x, tile_y, px_row, px_col, case when blue_zero and green_zero then cast(b0 as float) when blue_zero and p95 > 255 then cast(b0 * 256 + b1 as float) when blue_zero then cast(b0 as float) else {LUMA} end v from rgb join flags using (tile_x, tile_y)")
def p08_agb_decode(spark, sf):
    return tiles.decode_tiles(R.rgb(spark, sf), TILE, "biomass").drop("b0", "b1", "b2")


@query(f"with {R.RGB}, {FLAGS} select tile_x, tile_y, px_row, px_col, case when encoded then b0 end class_ from rgb join flags using (tile_x, tile_y)")
def p10_class_extract(spark, sf):
    return tiles.decode_tiles(R.rgb(spark, sf), TILE, "class").select(*TILE, *CELL, F.col("class").alias("class_"))


@query("select cast(i as int) i, 0.0::double + i * (120.0::double - 0.0) / 64 edge from generate_series(0, 64) t(i)")
def p13_linspace(spark, sf):
    return spark.range(1).select(F.posexplode(hist.edges(0.0, 120.0, 64)).alias("i", "edge"))


@query("select x, regexp_replace(cast(x as varchar), '\\.0$', '') label from (values (5.0::double), (7.5::double), (150.0::double), (0.25::double)) t(x)")
def p15_general_format(spark, sf):
    return values(spark, "x", "(5D), (7.5D), (150D), (0.25D)").select("x", text.general(F.col("x")).alias("label"))


@query(f"with {R.JOBS} select job_id, case when progress > 0 and progress < 100 and created % 1000 > 0 then cast(round_even((created % 1000) * (100 - progress) / progress, 0) as bigint) end eta from jobs")
def p16_eta(spark, sf):
    return R.jobs(spark, sf).select("job_id", text.eta_seconds(F.col("progress"), F.col("created") % 1000).alias("eta"))


@query(f"with {R.JOBS} select job_id, cast(40 + floor(progress / 101 * 45) as int) landcover, cast(5 + floor(progress / 101 * 90) as int) frames, cast(least(99, greatest(0, progress)) as int) crop from jobs")
def p17_progress(spark, sf):
    p, n = F.col("progress"), F.lit(101)
    return R.jobs(spark, sf).select("job_id", text.step_progress(p, n, 40, 45).alias("landcover"), text.step_progress(p, n, 5, 90).alias("frames"), text.crop_progress(p).alias("crop"))


@query("select k, least(8.0::double, 0.5::double * power(2.0::double, k - 1)) delay from generate_series(1, 10) t(k)")
def p18_backoff(spark, sf):
    return spark.range(1, 11).select(F.col("id").alias("k"), text.backoff(F.col("id")).alias("delay"))


@query("select w, h, array_to_string(case when least(w, h) >= 2 then list_filter([2, 4, 8, 16, 32], lambda l: least(w, h) // l >= 1) else [2] end, ',') levels from (values (1, 5), (3, 9), (16, 16), (100, 20), (4096, 4096)) t(w, h)")
def p19_overview_levels(spark, sf):
    return values(spark, "w, h", "(1, 5), (3, 9), (16, 16), (100, 20), (4096, 4096)").select("w", "h", F.array_join(geo.overview_levels(F.col("w"), F.col("h")), ",").alias("levels"))


FRAME = "(1, 0, 0, 256), (1, 1, 0, 256), (1, 0, 1, 256), (1, 1, 1, 256)"
WORLD = geo.CIRCUMFERENCE


@query(
    f"""with f as (select z, x, y, size, -0.3::double * {WORLD!r}::double l, 0.2::double * {WORLD!r}::double r, 0.25::double * {WORLD!r}::double t, -0.25::double * {WORLD!r}::double b from (values {FRAME}) v(z, x, y, size)),
s as (select *, {WORLD!r}::double / power(2.0::double, z) side from f),
w as (select *, x * side - {WORLD / 2!r}::double tl, {WORLD / 2!r}::double - y * side tt from s),
c as (select *, greatest(tl, l) cl, least(tl + side, r) cr, least(tt, t) ct, greatest(tt - side, b) cb from w),
e as (select z, x, y, cast(round_even((cl - l) * (64.0::double / (r - l)), 0) as int) px0, cast(round_even((cr - l) * (64.0::double / (r - l)), 0) as int) px1, cast(round_even((t - ct) * (48.0::double / (t - b)), 0) as int) py0, cast(round_even((t - cb) * (48.0::double / (t - b)), 0) as int) py1,
  cast(floor((cl - tl) / side * size) as int) s0, cast(ceil((cr - tl) / side * size) as int) s1, cast(floor((tt - ct) / side * size) as int) t0, cast(ceil((tt - cb) / side * size) as int) t1 from c where cl < cr and cb < ct),
d as (select *, cast(py as int) py_, cast(px as int) px_ from e, generate_series(0, 47) a(py), generate_series(0, 63) g(px) where py >= py0 and py < py1 and px >= px0 and px < px1)
select z, x, y, py_ as py, px_ as px, cast(t0 + floor((py_ - py0 + 0.5::double) * (t1 - t0) / (py1 - py0)) as int) as \"row\", cast(s0 + floor((px_ - px0 + 0.5::double) * (s1 - s0) / (px1 - px0)) as int) col from d"""
)
def p20_frame_mapping(spark, sf):
    own = values(spark, "z, x, y, size", FRAME).select("z", "x", "y", "size", *[(F.lit(k) * F.lit(WORLD)).alias(n) for n, k in (("left", -0.3), ("right", 0.2), ("top", 0.25), ("bottom", -0.25))])
    return tiles.frame_pixels(own, 64, 48)


@query(f"with p as ({PLACES}) select id, cast(round_even((lon - -180.0::double) / 360.0::double * 511, 0) as int) px, cast(round_even((90.0::double - lat) / 180.0::double * 255, 0) as int) py from p")
def p22_overlay_pixel(spark, sf):
    box = {k: F.lit(v) for k, v in (("west", -180.0), ("east", 180.0), ("south", -90.0), ("north", 90.0))}
    x, y = tiles.overlay_pixel(F.col("lon"), F.col("lat"), box, 512, 256)
    return _places(spark, sf).select("id", x.alias("px"), y.alias("py"))


COLOURS = "('#1f8d49'), (' 04381D '), ('2f7360'), ('#12345'), ('#gg0000'), ('')"


@query(f"select c, case when regexp_matches(k, '^[0-9a-f]{{6}}$') then cast('0x' || substr(k, 1, 2) as int) end r, case when regexp_matches(k, '^[0-9a-f]{{6}}$') then cast('0x' || substr(k, 3, 2) as int) end g, case when regexp_matches(k, '^[0-9a-f]{{6}}$') then cast('0x' || substr(k, 5, 2) as int) end b from (select c, lower(ltrim(trim(c), '#')) k from (values {COLOURS}) t(c))")
def p23_hex_color(spark, sf):
    return values(spark, "c", COLOURS).withColumn("rgb", text.hex_colour(F.col("c"))).select("c", "rgb.r", "rgb.g", "rgb.b")


LABELS = "('3', 'Forest Formation'), ('5', 'Mangrove / Mangrove'), ('99', 'Other'), ('24', ''), ('33', 'River, Lake / Ocean / Sea')"


@query(f"select code, label, case when instr(full_, ' / ') > 0 then substr(full_, 1, instr(full_, ' / ') - 1) else full_ end main, case when instr(full_, ' / ') > 0 then substr(full_, instr(full_, ' / ') + 3) end translation from (select *, case when code = '3' then label || ' / Formasi Hutan' else label end full_ from (values {LABELS}) t(code, label))")
def p25_label_split(spark, sf):
    parts = text.label_parts(text.bilingual(F.col("label"), F.col("code")))
    return values(spark, "code, label", LABELS).withColumn("p", parts).select("code", "label", "p.main", "p.translation")


@query("select p_partkey as id, case when length(p_name) > 18 then substr(p_name, 1, 17) || '...' else p_name end s from part")
def p26_truncate(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), text.truncate(F.col("p_name"), 18).alias("s"))


@query("select n, cast(case when n >= 2 then 2 else 1 end as int) cols, cast(ceil(n / case when n >= 2 then 2 else 1 end) as int) as \"rows\", cast(case when n = 0 then 90 else greatest(100, 84 + 36 * ceil(n / case when n >= 2 then 2 else 1 end)) end as int) height from generate_series(0, 20) t(n)")
def p29_legend_layout(spark, sf):
    cols, rows, height = text.legend_rows(F.col("id"))
    return spark.range(21).select(F.col("id").alias("n"), cols.cast("int").alias("cols"), rows.alias("rows"), height.alias("height"))


@query("select r, cast(floor(250 * (1 - r / 99.0::double) + 200 * (r / 99.0::double)) as int) v from generate_series(0, 99) t(r)")
def p30_gradient(spark, sf):
    return spark.range(100).select(F.col("id").alias("r"), text.blend(F.lit(250), F.lit(200), F.col("id"), F.lit(100).cast("double")).alias("v"))


BANDS = "(1, 3, 0, 0, 0), (1, 0, 0, 0, 0), (2, 3, 0, 0, 0), (3, 3, 127, 0, 0), (3, 0, 5, 0, 0), (4, 3, 0, 0, 0), (4, 0, 0, 0, 9)"


@query(f"with {R.RGB}, {FLAGS}, c as (select *, case when encoded then b0 end k from rgb join flags using (tile_x, tile_y)) select tile_x, tile_y, count_if(case when k is not null then k > 0 else b0 <> 0 or b1 <> 0 or b2 <> 0 end) n from c group by 1, 2")
def f05_validity_cascade(spark, sf):
    p = tiles.decode_tiles(R.rgb(spark, sf), TILE, "class")
    b = [F.col("b0"), F.col("b1"), F.col("b2"), F.lit(0)]
    return p.groupBy(*TILE).agg(F.count_if(decode.class_valid(F.lit(3), *b, F.col("class"))).alias("n"))


@query(f"with {R.BIOMASS} select cell, comp_c is not null and not coalesce(abs(comp_c - 5000) <= 1e-8::double + 1e-5::double * 5000, false) and comp_c / 10.0::double >= 0 ok, comp_c is not null and not coalesce(abs(comp_c / 10.0::double - 5000) <= 1e-8::double + 1e-5::double * 5000, false) and comp_c / 10.0::double >= 0 compat from biomass")
def f07_agb_validity(spark, sf):
    args = (F.col("comp_c"), F.lit(10.0), F.lit(5000))
    return R.biomass(spark, sf).select("cell", decode.biomass_valid(*args).alias("ok"), decode.biomass_valid(*args, compat_nodata=True).alias("compat"))


LISTS = "(1, '[20, 5, 5, -1]'), (2, null), (3, '[]'), (4, '[-3, 0]'), (5, '[1,2,3,4,5,6,7,8,9,10,11]')"


@query(f"with t as (select id, cast(s as double[]) a from (values {LISTS}) t(id, s)), g as (select id, list_sort(list_distinct(list_filter(case when a is null or len(a) = 0 then [5.0, 10.0, 20.0] else a end, lambda x: x > 0))) v from t) select id, array_to_string([cast(x as int) for x in v], ',') vals, case when len(v) = 0 then 'empty' when len(v) > 10 then 'too many' end problem from g")
def f09_threshold_normalise(spark, sf):
    rows = values(spark, "id, s", LISTS).withColumn("t", legend.normalised_thresholds(F.from_json("s", "array<double>"), [5.0, 10.0, 20.0]))
    return rows.select("id", F.array_join(F.transform("t.values", lambda x: x.cast("int")), ",").alias("vals"), "t.problem")


CLASSES = "(1, '[3, 9]', '[5, 3]'), (2, null, null), (3, '[]', '[40]')"


@query(f"select id, array_to_string(case when len(u) > 0 then u else [3, 5, 76] end, ',') classes from (select id, list_sort(list_distinct(list_concat(coalesce(cast(a as int[]), []), coalesce(cast(b as int[]), [])))) u from (values {CLASSES}) t(id, a, b))")
def f10_forest_classes(spark, sf):
    return values(spark, "id, a, b", CLASSES).select("id", F.array_join(change.forest_classes(F.from_json("a", "array<int>"), F.from_json("b", "array<int>")), ",").alias("classes"))


AOIS = "(1, 'Polygon', true, 0.0, 0.0, 1.0, 1.0, 5, 10.0), (2, 'Point', true, 0.0, 0.0, 1.0, 1.0, 5, 10.0), (3, 'Polygon', false, 0.0, 0.0, 1.0, 1.0, 5, 10.0), (4, 'Polygon', true, 0.0, 0.0, 181.0, 1.0, 5, 10.0), (5, 'Polygon', true, 0.0, 0.0, 1.0, 1.0, 50001, 9999.0), (6, 'MultiPolygon', true, 0.0, 0.0, 1.0, 1.0, 50000, 1600.5)"


@query(f"select id, case when kind not in ('Polygon', 'MultiPolygon') then 'type' when not ok then 'invalid' when w < -180 or e > 180 or s < -90 or n > 90 then 'bounds' when k > 50000 then 'vertices' when a > 1600 then 'area' end problem from (values {AOIS}) t(id, kind, ok, w, s, e, n, k, a)")
def f11_aoi_checks(spark, sf):
    return values(spark, "id, kind, ok, w, s, e, n, k, a", AOIS).select("id", polygon.aoi_problem(*map(F.col, ("kind", "ok", "w", "s", "e", "n", "k", "a"))).alias("problem"))


SQUARES = "(1, 20000.0::double, 20000.0::double), (2, 72000.0, 72000.0), (3, 20000.0, 10000.0), (4, 30000.0, 27000.0), (5, 30000.0, 26900.0)"


@query(f"select id, case when w / 1000 > 30 or h / 1000 > 30 then 'too large' when abs(w / 1000 - h / 1000) > 3 then 'not square' end problem from (values {SQUARES}) t(id, w, h)")
def f13_square_rule(spark, sf):
    rows = values(spark, "id, w, h", SQUARES.replace("::double", "")).select("id", F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))
    return rows.select("id", geo.square_rule(F.col("w"), F.col("h")).alias("problem"))


FEATURES = "(1, 1, 'Polygon', null, null), (1, 2, 'MultiPolygon', 'threat-map-overlay', 'x'), (1, 3, 'Point', null, '  '), (1, 4, 'Point', 'threat-map-overlay', ' Post '), (1, 5, 'MultiPoint', null, 'Later'), (2, 1, 'LineString', null, 'l')"


@query(f"with r as (select *, case when type in ('Polygon', 'MultiPolygon') then case when source = 'threat-map-overlay' then 'overlay_polygon' else 'aoi' end when type in ('Point', 'MultiPoint') then 'overlay_point' else 'dropped' end route from (values {FEATURES}) t(req, ord, type, source, name)) select req, ord, route, first(case when route = 'overlay_point' and trim(name) <> '' then trim(name) end) over (partition by req order by case when route = 'overlay_point' and trim(name) <> '' then ord end nulls last rows between unbounded preceding and unbounded following) point_name from r")
def f17_feature_routing(spark, sf):
    routed = legend.route(values(spark, "req, ord, type, source, name", FEATURES))
    return routed.join(legend.point_name(routed, ["req"]).withColumnRenamed("name", "point_name"), "req", "left").select("req", "ord", "route", "point_name")


DIRTY = "(1, 0, 0, 0, 0.0, 0.0), (1, 0, 0, 1, 4.0, 0.0), (1, 0, 0, 2, 4.0, 0.0), (1, 0, 0, 3, null, 2.0), (1, 0, 0, 4, 4.0, 4.0), (2, 0, 0, 0, 1.0, 1.0), (2, 0, 0, 1, 2.0, 2.0), (2, 0, 0, 2, 1.0, 1.0)"


@query(f"with k as (select * from (values {DIRTY}) t(id, part, ring, seq, x, y) where x is not null and y is not null), d as (select * from k window w as (partition by id, part, ring order by seq) qualify not coalesce(x = lag(x) over w and y = lag(y) over w, false)), n as (select id, count(distinct (x, y)) u from d group by 1), s as (select id, part, ring, cast(row_number() over (partition by id order by seq) - 1 as int) seq, x::double x, y::double y from d join n using (id) where u >= 3) select * from s union all select id, part, ring, (select cast(count(*) as int) from s t where t.id = s.id), x, y from s where seq = 0")
def f18_ring_sanitise(spark, sf):
    rows = values(spark, "id, part, ring, seq, x, y", DIRTY).select("id", "part", "ring", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return polygon.sanitise(rows)


@query(f"with {R.CELLS}, b as (select tile_x, px_row, px_col from cells where h % 2 = 0), c as (select tile_x, px_row, px_col from cells where h % 3 = 0) select tile_x, count(*) n from (select * from (select distinct * from b) u where not exists (select 1 from c where c.tile_x = u.tile_x and c.px_row = u.px_row and c.px_col = u.px_col)) group by 1")
def f23_alignment_guard(spark, sf):
    k = R.cells(spark, sf).select("tile_x", *CELL, "h")
    only = k.where("h % 2 = 0").drop("h").distinct().join(k.where("h % 3 = 0").drop("h"), ["tile_x", *CELL], "left_anti")
    return only.groupBy("tile_x").agg(F.count("*").alias("n"))


@query("select * from (values ('3', 'Forest'), ('5', 'Mangrove')) t(class_code, label)")
def s16_source_priority(spark, sf):
    empty = values(spark, "class_code, label", "('', '')").where("false")
    return legend.first_source([empty, values(spark, "class_code, label", "('3', 'Forest'), ('5', 'Mangrove')"), values(spark, "class_code, label", "('9', 'Late')")])


@query("select y as \"year\", case when y = 1990 then 'file:///first.pmtiles' else 'https://tiles.example.org/lc/' || y || '_landcover.pmtiles' end url from generate_series(1990, 2024) t(y)")
def s17_year_url(spark, sf):
    url = text.year_url(F.col("id"), "https://tiles.example.org/lc/", {1990: "file:///first.pmtiles", 2000: "ignored", 2024: ""})
    return spark.range(1990, 2025).select(F.col("id").alias("year"), url.alias("url"))


@query("select c_custkey as id, 'ranges/' || substr(sha1('https://t.example.org/' || c_custkey), 1, 16) || '/' || c_custkey * 10 || '_127.bin' path from customer")
def s05_cache_key(spark, sf):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf}/customer.parquet").select(k.alias("id"), text.cache_key(F.concat(F.lit("https://t.example.org/"), k.cast("string")), k * 10, F.lit(127)).alias("path"))


@query(f"with {R.CELLS} select tile_x, px_row, px_col, v from (select (tile_x + 2000) yr, * from pixels) where yr between 2002 and 2004 and px_row between 10 and 20 and px_col between 30 and 90 and tile_y = 1")
def s21_cube_slice(spark, sf):
    cube = R.pixels(spark, sf).withColumn("yr", F.col("tile_x") + 2000)
    return cube.where(F.col("yr").between(2002, 2004) & F.col("px_row").between(10, 20) & F.col("px_col").between(30, 90) & (F.col("tile_y") == 1)).select("tile_x", *CELL, "v")


@query(f"with {R.CELLS} select px_row, px_col, max_by(v, tile_y * 100 + tile_x) v, max_by(tile_x, tile_y * 100 + tile_x) tile_x from pixels group by 1, 2")
def t02_paint_order(spark, sf):
    return tiles.paint(R.pixels(spark, sf), CELL, ["tile_y", "tile_x"], ["v", "tile_x"])


@query(f"with {_boxes_sql('generate_series(3, 9)')}, c as (select id, z, cast((greatest(x1 - x0 + 1, 1)) * (greatest(y1 - y0 + 1, 1)) as int) k from t), w as (select *, bool_and(k <= 64) over (partition by id order by z) ok from c) select id, max(z) filter (ok) zoom, max_by(k, z) filter (ok) tiles from w group by 1")
def t04_zoom_choice(spark, sf):
    return tiles.choose_zoom(_boxes(spark), "id", 3, 9, 64).select("id", F.col("zoom").cast("bigint").alias("zoom"), "tiles")


@query(f"with {R.PAIRS} select 'and' op, count(*) n from pairs where b in {FOREST} and c in {FOREST} union all select 'or', count(*) from pairs where b in {FOREST} or c in {FOREST} union all select 'not', count(*) from pairs where b in {FOREST} and c not in {FOREST}")
def u01_mask_algebra(spark, sf):
    b, c = F.col("b").isin(*change.FOREST), F.col("c").isin(*change.FOREST)
    one = R.pairs(spark, sf).agg(F.count_if(b & c).alias("a"), F.count_if(b | c).alias("o"), F.count_if(b & ~c).alias("x"))
    return one.select(F.expr("stack(3, 'and', a, 'or', o, 'not', x) as (op, n)"))


@query(f"with {R.REQUESTS} select ip, max(us) us, max_by(event_id, us) event_id, max_by(method, us) method from requests group by 1")
def k05_latest_wins(spark, sf):
    return jobs.latest(R.requests(spark, sf), "ip", "us", ["event_id", "method"])


@query(f"with {R.REQUESTS}, e as (select 'u' || ip url, us % 7 * 100 as \"offset\", us % 3 + 100 as length, case method when 'GET' then 'network' else 'cache' end source from requests) select url, \"offset\", length, count_if(source = 'network') network, count_if(source = 'cache') cached, cast(sum(length) as bigint) bytes from e group by all")
def k07_distinct_ranges(spark, sf):
    e = R.requests(spark, sf).select(F.concat(F.lit("u"), "ip").alias("url"), (F.col("us") % 7 * 100).alias("offset"), (F.col("us") % 3 + 100).alias("length"), F.when(F.col("method") == "GET", "network").otherwise("cache").alias("source"))
    return jobs.distinct_ranges(e)


@query(f"with {R.REQUESTS} select event_id as seq, method as message from requests order by event_id desc limit 200")
def k08_log_tail(spark, sf):
    return jobs.log_tail(R.requests(spark, sf).select(F.col("event_id").alias("seq"), F.col("method").alias("message")), 200)


@query(
    f"""with recursive {R.REQUESTS.strip()}, m as (select event_id, ip, us, row_number() over (partition by ip order by us, event_id) i from requests where method in ('POST', 'PUT', 'PATCH', 'DELETE')),
r(ip, i, event_id, kept, ok) as (select ip, i, event_id, [us], true from m where i = 1 union all
  select ip, i, event_id, case when len(kept) < 20 then list_append(kept, us) else kept end, len(kept) < 20 from
    (select m.ip, m.i, m.event_id, m.us, list_filter(r.kept, lambda k: m.us - k <= 86400000000) kept from r join m on m.ip = r.ip and m.i = r.i + 1))
select event_id, ok admitted from r"""
)
def r01_rate_limiter(spark, sf):
    return jobs.rate_limited(R.requests(spark, sf), "ip", 20, 86_400)


@query(f"with {R.REQUESTS}, m as (select * from requests where method in ('POST', 'PUT', 'PATCH', 'DELETE')) select event_id, ip, us, method, count(*) over (partition by ip order by us range between 86400000000 preceding and current row) hits from m")
def r01b_trailing_count(spark, sf):
    return jobs.trailing_hits(R.requests(spark, sf), "ip", "us", 86_400)


@query(f"with {R.JOBS} select worker, count_if(status in ('queued', 'running')) active, case when count_if(status in ('queued', 'running')) >= 6 then 429 else 202 end code from jobs group by 1")
def r02_admission(spark, sf):
    active = F.count_if(F.col("status").isin("queued", "running"))
    return R.jobs(spark, sf).groupBy("worker").agg(active.alias("active")).withColumn("code", jobs.admitted(F.col("active")))


@query(f"with {R.JOBS}, s as (select *, progress + 1 as d, cast(sum(progress + 1) over w as bigint) t from jobs window w as (partition by worker order by created, job_id)), f as (select *, t + max(created - (t - d)) over (partition by worker order by created, job_id) finish from s) select job_id, finish, finish - d as start from f")
def r03_slot_schedule(spark, sf):
    return jobs.schedule(R.jobs(spark, sf), ["worker"], ["created", "job_id"], F.col("created"), (F.col("progress") + 1).cast("bigint")).select("job_id", "finish", "start")


@query(f"with {R.JOBS}, q as (select *, cast(row_number() over (partition by worker order by created, job_id) as int) position from jobs where status = 'queued') select job_id, worker, position, case when position = 1 then 'queued' else 'deferred' end status from q")
def r04_fifo_status(spark, sf):
    return jobs.fifo(R.jobs(spark, sf).where("status = 'queued'"), ["worker"], ["created", "job_id"]).select("job_id", "worker", "position", "status")


@query(f"with {R.JOBS} select job_id, case when status in ('queued', 'deferred') then 'cancelled' else status end status, status = 'running' flagged from jobs")
def r05_cancel(spark, sf):
    status, flagged = jobs.cancel(F.col("status"))
    return R.jobs(spark, sf).select("job_id", status.alias("status"), flagged.alias("flagged"))


@query(f"with {R.JOBS} select job_id, case when status = 'running' or (not frames and status = 'queued') then 'failed' else status end status, case when status = 'running' or (not frames and status = 'queued') then 'worker_interrupted' end error from jobs")
def r06_reconcile(spark, sf):
    status, error = jobs.reconcile(F.col("status"), F.col("frames"))
    return R.jobs(spark, sf).select("job_id", status.alias("status"), error.alias("error"))


@query(f"with {R.REQUESTS} select ip, max_by(method, us) filter (method <> 'GET') method, max_by(event_id, us) event_id from (select ip, us, method, event_id from requests) group by 1")
def r07_progress_merge(spark, sf):
    u = R.requests(spark, sf).withColumn("method", F.when(F.col("method") != "GET", F.col("method")))
    return jobs.merged(u, "ip", "us", ["method", "event_id"])

