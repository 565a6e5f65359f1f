"""Mixing sources to target weights by systematic sampling.

Each document expects target / size of its source copies. The documents of a source are laid out in
a total order, their expected copies are prefix-summed, one offset is added, and a document is
emitted once for each integer boundary that its interval crosses. As a source's documents all expect
the same number, the prefix sum is rank times rate, and ranks come from a range partition of tiny
rows: place in the partition plus what earlier partitions hold, one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, packed, partitions, unpacked, words_sql

#: Weights of the sources by code point, repeating, and the most copies of a source.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target: shares by weight of the total, stopped at ``most`` times the size.

    What is above goes to the others by weight. In order of the level size / weight at which a source
    stops, the k least are full: the first level that is not reached fixes k. One row a source.
    """
    ranked = sizes.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    at = F.col("_i") % len(weights)
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(at == i, F.lit(w)).otherwise(weight)
    full = ranked.select("source", "source_size", weight.cast("bigint").alias("_w"), (F.col("source_size") * most).alias("_cap"), "_i")
    level = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    everyone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    parts = full.withColumn("_left", F.sum("source_size").over(everyone) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).withColumn("_weights", F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    parts = parts.withColumn("_level", F.when(F.col("_cap") * F.col("_weights") >= F.col("_left") * F.col("_w"), F.col("_left") / F.col("_weights")))
    stop = parts.withColumn("_level", F.min(F.struct(F.col("_level").isNull().alias("n"), (F.col("_cap") / F.col("_w")).alias("c"), F.col("_i").alias("i"), F.col("_level").alias("l"))).over(everyone))
    return stop.select("source", "source_size", F.when(F.col("_cap") <= F.col("_w") * F.col("_level.l"), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_level.l")).alias("target"))


def systematic(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """doc_id, source, _t (hash of the text), size, source_size, target, copies for each row.

    size: words of the text (null: 0). The order within a source is size, doc_id, text hash, so that
    short and long documents are taken in proportion. A null source is a source, the last. Repeated
    rows stand side by side and any of them may get a copy; rows with a null doc_id come first. An
    empty table gives an empty table; a source without a word has target 0. The same rows give the
    same copies in any run, whatever their partitions.
    """
    order = ["source", "size", "doc_id", "_t"]
    own = checkpoint(docs.select("doc_id", "source", F.xxhash64("text").alias("_t"), F.expr(f"cast(size({words_sql('text')}) as bigint)").alias("size")))
    dealt = own.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    dealt = checkpoint(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    held = checkpoint(dealt.groupBy("source", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_id").alias("_start"), F.sum("size").alias("_words")))
    goals = targets(held.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("\0")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = held.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    runs = runs.select(F.col("source").alias("_source"), "_part", "_start", "_before")
    goals = goals.select(F.col("source").alias("_goal"), "source_size", "target", rate.alias("_rate"), offset.alias("_offset"))
    plan = checkpoint(runs.join(goals, F.col("_source").eqNullSafe(F.col("_goal"))).drop("_goal"))
    ranked = dealt.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (part == F.col("_part"))).withColumn("_rank", F.col("_id") - F.col("_start") + F.col("_before") + 1)
    line = lambda rank: F.floor(F.col("_rate") * rank + F.col("_offset"))
    return ranked.select("doc_id", "source", "_t", "size", "source_size", "target", F.least(F.lit(most), line(F.col("_rank")) - line(F.col("_rank") - 1)).cast("bigint").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixture itself: every row as often as it is taken, with ``copy`` (1, 2, ...). Rows that repeat
    doc_id, source and text are one document, whose copies add up."""
    plan = systematic(docs).groupBy("doc_id", "source", "_t").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0").toDF("_d", "_s", "_h", "_copies", "_rows")
    plan = checkpoint(plan)
    own = packed(docs, d=F.col("doc_id"), s=F.col("source"), h=F.xxhash64("text"))
    taken = own.join(plan, own.d.eqNullSafe(plan._d) & own.s.eqNullSafe(plan._s) & (own.h == plan._h))
    if not plan.where("_rows > 1").isEmpty():
        taken = taken.dropDuplicates(["d", "s", "h"])
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return unpacked(copies, docs.columns, copy=F.col("copy"))
