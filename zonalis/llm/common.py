"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(var: str, value: str, body: str) -> str:
    """SQL that binds ``value`` to ``var`` inside ``body`` and evaluates it once per row.

    Projections may be merged by the optimizer, which would put a costly value inside a lambda
    and evaluate it per element; a lambda variable is always computed before.
    """
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def words_sql(text: str) -> str:
    """SQL array of the words ``[^\\x20\\x09-\\x0D]+`` of ``text`` (null: empty)."""
    return f"filter(split(translate(coalesce({text}, ''), '\\u0009\\u000a\\u000b\\u000c\\u000d', '     '), ' '), w_ -> w_ <> '')"


#: Characters that Unicode's lower case changes lie outside; texts of these alone take the fast way.
_UNCASED = r"[^\x00-\x7F\xA0-\xBF\xDF-\xF6\xF8-\xFF\x{2010}-\x{2027}\x{3000}-\x{9FFF}]"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Where no other character has a lower case, ``lower`` does the same and is fast."""
    plain = (F.octet_length(c) == F.char_length(c)) | ~F.rlike(c, F.lit(_UNCASED))
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and stages that all executors share: ``spark.checkpoint.dir``.

    A session on one machine that names none (tests) gets a temporary one; a cluster must name it.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named or held.nonEmpty():
        return named or held.get()
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="zonalis-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the driver drop what finished rounds of a loop have left: only a collection of its heap tells Spark
    which checkpoints, shuffle files and broadcasts no plan refers to any more."""
    spark.sparkContext._jvm.java.lang.System.gc()


#: A key with more than this share of the rows is hot; so there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 1000


def join_spread(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with names, which has one row a key and in ``n`` the number of the key's rows
    (dropped). The hot keys, under a thousand, are broadcast; the others are joined by a shuffle.
    Both sides are read twice where a key is hot."""
    total, most = names.agg(F.sum("n"), F.max("n")).first()
    least = max(1000, (total or 0) * HOT_SHARE)
    if (most or 0) <= least:
        return rows.join(names.drop("n"), key)
    hot, cold = names.where(F.col("n") > least).drop("n"), names.where(F.col("n") <= least).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


#: Buckets of hashes that a pre-filter broadcasts at most.
BUCKETS = 1 << 18


def split_touched(rows: DataFrame, by: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hit, rest): rows whose hash ``by`` may be among the hashes ``key`` of keys, and rows whose is not.

    Only the buckets that the hashes fall into are broadcast, ``BUCKETS`` numbers at most: where few rows
    are touched, the others need no shuffle; where many are, all are hits. Rows are read twice.
    """
    bucket = lambda c: F.pmod(F.col(c), F.lit(BUCKETS))
    touched = F.broadcast(checkpoint(keys.select(bucket(key).alias("_bucket")).distinct()))
    same = bucket(by) == F.col("_bucket")
    return rows.join(touched, same, "left_semi"), rows.join(touched, same, "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """``row`` (all columns as a struct) beside columns of our own, so that no name of the table clashes."""
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The row's columns, replaced or followed by new ones."""
    old = [new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns]
    return df.select(*old, *[c.alias(n) for n, c in new.items() if n not in columns])
