"""Change between two years over aligned pixels."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes that count as forest unless others are configured.
FOREST = (3, 5, 76)


def forest_classes(configured: Column, planted: Column) -> Column:
    """Sorted union of both lists; the fixed classes where both are empty."""
    both = F.array_sort(F.array_union(F.coalesce(configured, F.array().cast("array<int>")), F.coalesce(planted, F.array().cast("array<int>"))))
    return F.when(F.size(both) > 0, both).otherwise(F.array(*map(F.lit, FOREST)))


def two_years(base: DataFrame, comp: DataFrame, tile: list[str], cell: list[str]) -> DataFrame:
    """Pixels of both years: tile, cell, base, comp (each a struct of the other columns; null where the
    year has no such pixel) and both_tiles, whether both years have the tile at all.

    The pairing is one shuffle by tile and cell, so its parallelism is that of the pixels; which tiles a
    year has comes from a partial aggregate, one row a tile and task.
    """
    keys = [*tile, *cell]
    packs = {name: F.struct(*[c for c in df.columns if c not in keys]) for name, df in (("base", base), ("comp", comp))}
    types = {name: df.select(packs[name].alias("s")).schema["s"].dataType for name, df in (("base", base), ("comp", comp))}
    one = base.select(*keys, packs["base"].alias("base"), F.lit(None).cast(types["comp"]).alias("comp"))
    other = comp.select(*keys, F.lit(None).cast(types["base"]).alias("base"), packs["comp"].alias("comp"))
    paired = one.unionByName(other).groupBy(*keys).agg(F.first("base", ignorenulls=True).alias("base"), F.first("comp", ignorenulls=True).alias("comp"))
    years = base.select(*tile, F.lit(1).alias("_y")).unionByName(comp.select(*tile, F.lit(2).alias("_y")))
    held = years.groupBy(*tile).agg((F.min("_y") != F.max("_y")).alias("both_tiles")).withColumnsRenamed({c: f"_{c}" for c in tile})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in tile]
    return paired.join(held, reduce(and_, same)).drop(*[f"_{c}" for c in tile])


def forest_change(pixels: DataFrame, keys: list[str], base: Column, comp: Column, valid: Column, area: Column | None = None) -> DataFrame:
    """Counts of total, valid, loss, gain and forest of both years; base and comp say whether a pixel is
    forest, and count only where valid. With area, its sums as well."""
    b, c = F.coalesce(base, F.lit(False)) & valid, F.coalesce(comp, F.lit(False)) & valid
    flags = {"total": F.lit(True), "valid": valid, "loss": b & ~c, "gain": ~b & c, "base_forest": b, "comp_forest": c}
    out = [F.count_if(x).alias(n) for n, x in flags.items()]
    if area is not None:
        out += [F.coalesce(F.sum(F.when(x, area)), F.lit(0)).alias(f"{n}_area") for n, x in flags.items()]
    return pixels.groupBy(*keys).agg(*out) if keys else pixels.agg(*out)


def change_rates(counts: DataFrame) -> DataFrame:
    """Loss and gain in per cent of the analysed (valid) pixels, net change and coverage."""
    share = lambda c: F.when(F.col("valid") > 0, 100.0 * F.col(c) / F.col("valid")).otherwise(0.0)
    return counts.withColumns({"loss_pct": share("loss"), "gain_pct": share("gain"), "net": F.col("comp_forest") - F.col("base_forest"), "coverage": F.col("valid") / F.col("total")})


def signed_delta(pixels: DataFrame, keys: list[str], base: Column, comp: Column) -> DataFrame:
    """Over pixels of both years: cells, increase and decrease of the value, and cells of either."""
    d = comp - base
    return pixels.where(base.isNotNull() & comp.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("common"),
        F.sum(F.greatest(d, F.lit(0))).alias("increase"),
        F.sum(F.greatest(-d, F.lit(0))).alias("decrease"),
        F.count_if(d > 0).alias("up_cells"),
        F.count_if(d < 0).alias("down_cells"),
    )


def net_change(base_total: Column, comp_total: Column, area: Column) -> dict[str, Column]:
    net = comp_total - base_total
    return {"net": net, "net_per_ha": F.when(area > 0, net / area).otherwise(0.0), "net_pct": F.when(base_total > 0, 100.0 * net / base_total).otherwise(0.0)}


def misaligned(base: DataFrame, comp: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that only one of two masks holds; no row means that they agree."""
    return base.select(*keys).join(comp.select(*keys), keys, "left_anti").unionByName(comp.select(*keys).join(base.select(*keys), keys, "left_anti"))
