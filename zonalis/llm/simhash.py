"""SimHash near-dedup by multi-index hashing.

A fingerprint has two segments of 32 bits, and each segment has a table from its values to the
fingerprints. Of two fingerprints at distance two or less, either a segment is equal or both differ in
one bit. So a fingerprint probes both tables with its own values, and the first table with the values
of the ball of radius one around its segment: of two neighbours the one that lacks the bit probes.
Probes of values that no fingerprint has are dropped first. What a probe fetches is verified by the
complete distance. A bucket above ``BUCKET`` is split by the remaining bits: its members are filed
under the ball of their other segment, which is exact, and no file has more than 65 members. Copies of
one fingerprint are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_spread, partitions, release

MAX_DISTANCE = 2
#: Members of a bucket that are compared with each probe; larger buckets are split by the other segment.
BUCKET = 32
#: Parts into which a node's edges are dealt.
SALTS = 8


def fingerprint(text: str | None) -> int:
    """64 bits, as a signed integer; zero where the text is null or has no word."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six white spaces only
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; checkpointed, because texts are read once."""
    return checkpoint(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id bigint, fp bigint"))


def tables(fps: DataFrame) -> DataFrame:
    """(seg, value, other, fp): each fingerprint under both of its segments."""
    high, low = "shiftrightunsigned(fp, 32)", "fp & 4294967295L"
    both = F.expr(f"inline(array(named_struct('seg', 0, 'value', {high}, 'other', {low}), named_struct('seg', 1, 'value', {low}, 'other', {high})))")
    return fps.select("fp", both)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that join the same components as all links of distance two or less do.

    fps: different values in column fp.
    """
    spark = fps.sparkSession
    table = checkpoint(tables(fps.repartition(partitions(spark), "fp")))
    sizes = table.groupBy("seg", "value").agg(F.count("*").alias("n"))
    balls = F.concat(F.array(F.col("value")), F.expr("transform(filter(sequence(0, 31), i -> seg = 0 and (value & shiftleft(1L, i)) = 0), i -> value | shiftleft(1L, i))"))
    probes = table.select("seg", "fp", "other", F.col("value").alias("own"), F.explode(balls).alias("value"))
    alone = (F.col("own") == F.col("value")) & (F.col("n") == 1)
    met = checkpoint(probes.join(sizes.hint("shuffle_hash"), ["seg", "value"]).where(~alone))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    fetched = met.where(F.col("n") <= BUCKET).select("seg", "value", F.col("fp").alias("a")).join(table.select("seg", "value", F.col("fp").alias("b")), ["seg", "value"])
    small = fetched.where((F.col("a") != F.col("b")) & (distance <= MAX_DISTANCE)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near = F.expr("if(own = value, concat(array(other), transform(sequence(0, 31), i -> other ^ shiftleft(1L, i))), array(other))")
    files = met.where(F.col("n") > BUCKET).select("seg", "value", "fp", F.explode(near).alias("rest")).groupBy("seg", "value", "rest").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    large = files.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where((F.col("a") < F.col("b")) & (distance <= MAX_DISTANCE))
    return small.union(large).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component of edges (a, b), by alternating large and small
    stars; a round is two shuffles of the edges, and rounds grow with the logarithm of the size. A node's
    edges are dealt by ``SALTS`` salts where they meet its least neighbour, so that no hub is one task's."""
    edges = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), salts)
        met = both.select("u", "v", salt).join(least.hint("merge"), ["u", "salt"])
        large = checkpoint(met.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct())
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        met = down.select("u", "v", salt).join(low.select("u", "m", salts).hint("merge"), ["u", "salt"])
        edges = checkpoint(met.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").union(low.select("m", "u")).distinct())
        ends = edges.select(F.col("b").alias("u"), F.lit(1).alias("n")).union(edges.select("a", F.lit(0)).distinct())
        found = ends.groupBy("u").agg(F.sum("n").alias("n"), F.count("*").alias("all")).where("n > 1 or n = 1 and all > 1").isEmpty()
        release(edges.sparkSession)
        if found:  # all are stars: a node has one root, and no root has one
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id within reach) for each row.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows are
    copies. A row whose doc_id is null links its neighbours but names no component; a component of
    such rows alone has a null component_id. An empty table gives an empty table; other columns
    are not read.
    """
    own = fingerprints(docs)
    kinds = checkpoint(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(links(kinds.select("fp")))
    rooted = checkpoint(kinds.join(roots, kinds.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    names = join_spread(rooted.withColumnRenamed("n", "rows"), checkpoint(firsts), "root").select("fp", "component_id", F.col("rows").alias("n"))
    return join_spread(own, checkpoint(names), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
