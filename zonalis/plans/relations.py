"""Pixel, job and request relations derived from the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Class codes in the legend's order.
CODES = (3, 5, 76, 13, 40, 35, 9, 21, 30, 24, 25, 31, 33, 27)

CELLS = """
cells as (select cast(l_partkey % 8 as int) tile_x, cast(l_suppkey % 4 as int) tile_y, cast(l_orderkey % 256 as int) px_row,
  cast((l_orderkey // 256 + 31 * l_linenumber) % 256 as int) px_col, cast(floor(max(l_quantity)) as int) h,
  min(l_partkey) % 14 bi, max(l_suppkey + l_linenumber) % 14 ci from lineitem group by 1, 2, 3, 4),
pixels as (select tile_x, tile_y, px_row, px_col, (tile_x + tile_y) % 5 as zone, cast(h as bigint) v, h % 11 <> 0 as valid, cast(100 + tile_x as bigint) area from cells)"""


def _code(i: str) -> str:
    return f"case {i} " + " ".join(f"when {k} then {c}" for k, c in enumerate(CODES)) + " end"


PAIRS = CELLS + f""",
pairs as (select tile_x, tile_y, px_row, px_col, {_code('bi')} b, {_code('ci')} c from cells)"""
RGB = CELLS + """,
rgb as (select tile_x, tile_y, px_row, px_col,
  case tile_x % 4 when 0 then h when 1 then 1 + h % 8 when 2 then 0 else h end b0,
  case tile_x % 4 when 0 then 0 when 1 then px_row when 2 then h else 2 * h end b1,
  case tile_x % 4 when 3 then 1 + h % 5 else 0 end b2 from cells)"""
BIOMASS = """
biomass as (select cast(user_id as int) cell,
  cast(max(case when extract(day from ts) <= 15 then floor(value * 100 + 0.5) end) as bigint) base_c,
  cast(max(case when extract(day from ts) > 15 then floor(value * 100 + 0.5) end) as bigint) comp_c from events group by 1)"""
REQUESTS = """
requests as (select cast(event_id as bigint) event_id, cast(user_id % 5 as int) ip, epoch_us(ts) us,
  case event_type when 'view' then 'GET' when 'click' then 'HEAD' else 'POST' end method from events)"""
JOBS = """
jobs as (select cast(o_orderkey as bigint) job_id, case o_orderstatus when 'F' then 'succeeded' when 'O' then 'queued' else 'running' end status,
  cast(o_custkey % 101 as int) progress, cast(o_custkey % 7 as int) worker, cast(epoch(cast(o_orderdate as timestamp)) as bigint) created, o_custkey % 3 = 0 as frames from orders)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.expr("cast(l_partkey % 8 as int)").alias("tile_x"), F.expr("cast(l_suppkey % 4 as int)").alias("tile_y"), F.expr("cast(l_orderkey % 256 as int)").alias("px_row"), F.expr("cast((l_orderkey div 256 + 31 * l_linenumber) % 256 as int)").alias("px_col")]
    return _table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.floor(F.max("l_quantity")).cast("int").alias("h"), (F.min("l_partkey") % 14).alias("bi"), (F.max(F.col("l_suppkey") + F.col("l_linenumber")) % 14).alias("ci"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_x, tile_y, px_row, px_col, zone, v, valid, area."""
    return cells(spark, sf_dir).select("tile_x", "tile_y", "px_row", "px_col", ((F.col("tile_x") + F.col("tile_y")) % 5).alias("zone"), F.col("h").cast("bigint").alias("v"), (F.col("h") % 11 != 0).alias("valid"), (F.col("tile_x") + 100).cast("bigint").alias("area"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of two years: b, c."""
    return cells(spark, sf_dir).select("tile_x", "tile_y", "px_row", "px_col", F.expr(_code("bi")).alias("b"), F.expr(_code("ci")).alias("c"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands b0, b1, b2 with one decoding a column of tiles."""
    return cells(spark, sf_dir).select(
        "tile_x", "tile_y", "px_row", "px_col",
        F.expr("case tile_x % 4 when 0 then h when 1 then 1 + h % 8 when 2 then 0 else h end").alias("b0"),
        F.expr("case tile_x % 4 when 0 then 0 when 1 then px_row when 2 then h else 2 * h end").alias("b1"),
        F.expr("case tile_x % 4 when 3 then 1 + h % 5 else 0 end").alias("b2"),
    )


def biomass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell with base_c and comp_c in hundredths, null where the year has no value."""
    cents = F.floor(F.col("value") * 100 + 0.5)
    early = F.dayofmonth("ts") <= 15
    return _table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("int").alias("cell")).agg(F.max(F.when(early, cents)).cast("bigint").alias("base_c"), F.max(F.when(~early, cents)).cast("bigint").alias("comp_c"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "click", "HEAD").otherwise("POST")
    return _table(spark, sf_dir, "events").select(F.col("event_id").cast("bigint").alias("event_id"), (F.col("user_id") % 5).cast("int").alias("ip"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), method.alias("method"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("job_id"), status.alias("status"), (F.col("o_custkey") % 101).cast("int").alias("progress"), (F.col("o_custkey") % 7).cast("int").alias("worker"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created"), (F.col("o_custkey") % 3 == 0).alias("frames"))


#: Literal features for geometry: a triangle, a square with a hole, a bow tie (unit grid 12 by 12).
SHAPES = (
    (1, 0, ((1, 1), (9, 2), (4, 8.5), (1, 1))),
    (2, 0, ((1, 1), (11, 1), (11, 11), (1, 11), (1, 1))),
    (2, 1, ((4, 4), (8, 4), (8, 8), (4, 8), (4, 4))),
    (3, 0, ((1, 1), (9, 9), (1, 9), (9, 1), (1, 1))),
)


def shapes_sql(scale: float = 1.0) -> str:
    rows = ", ".join(f"({i}, 0, {r}, {k}, cast({x * scale} as double), cast({y * scale} as double))" for i, r, ring in SHAPES for k, (x, y) in enumerate(ring))
    return f"select * from (values {rows}) t(id, part, ring, seq, x, y)"


def shapes(spark: SparkSession, scale: float = 1.0) -> DataFrame:
    return spark.sql(shapes_sql(scale))


#: A triangle for each customer on the unit grid of 12 by 12, some of them flat, and a box in lon/lat.
TRIANGLES = """
shapes as (select cast(c_custkey as bigint) id, 0 part, 0 ring, seq, cast(case seq when 1 then c_custkey * 5 % 9 when 2 then c_custkey * 7 % 13 else c_custkey % 12 end as double) x,
  cast(case seq when 1 then c_custkey * 11 % 13 when 2 then c_custkey * 2 % 12 else c_custkey * 3 % 11 end as double) y from customer, (values (0), (1), (2), (3)) s(seq))"""
BOXES = """
boxes as (select cast(c_custkey as bigint) id, c_custkey * 7 % 3500 / 10.0::double - 180 as west, c_custkey * 11 % 1500 / 10.0::double - 80 as south from customer),
b as (select id, west, south, west + 7.5::double as east, south + 4.25::double as north from boxes)"""


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(k, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq"))
    x = F.when(F.col("seq") == 1, k * 5 % 9).when(F.col("seq") == 2, k * 7 % 13).otherwise(k % 12)
    y = F.when(F.col("seq") == 1, k * 11 % 13).when(F.col("seq") == 2, k * 2 % 12).otherwise(k * 3 % 11)
    return rows.select(k.cast("bigint").alias("id"), F.lit(0).alias("part"), F.lit(0).alias("ring"), "seq", x.cast("double").alias("x"), y.cast("double").alias("y"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(k.cast("bigint").alias("id"), (k * 7 % 3500 / 10.0 - 180).alias("west"), (k * 11 % 1500 / 10.0 - 80).alias("south"))
    return rows.select("id", "west", "south", (F.col("west") + 7.5).alias("east"), (F.col("south") + 4.25).alias("north"))


EDGES = "edges as (select id, part, ring, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from shapes window w as (partition by id, part, ring order by seq) qualify x2 is not null)"
