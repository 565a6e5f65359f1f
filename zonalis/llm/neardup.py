"""Near-dedup of the pipeline: documents whose sets of five-word shingles are alike, by SimHash and multi-index hashing.

The fingerprint of a whole document has ``TABLES`` segments of ``BITS`` bits, each with a table. A document probes
each table with its segment's ball of radius one (of two neighbours the one that lacks the bit), and what a probe
fetches is a candidate if the complete distance is ``DISTANCE`` or less. At a similarity of 0.8 a seventh of all
bits differ; a probe then meets its pair with a chance of 0.1, and one of all tables does with 0.9.

For the rest there are tables of samples: each of ``SEGMENTS`` segments is the 64-bit SimHash of ``SAMPLE``
shingles of the document, the least under the segment's own order, and documents that share an entry are
candidates. Two samples are equal with a chance of about 0.8 ** 5, so a pair at the least similarity shares
none with a chance of (1 - 0.8 ** 5) ** 24, some seven in 100 000, and more similar pairs with less.

Candidates only say which nodes (documents of equal shingles) are read together: a block is a component
of them. Whether two are linked is counted on the shingles themselves. A block above ``CHUNK`` shingles is
dealt into slots, and each pair of slots is a group of its own, so that no task reads a large block
whole. Of the links found in a group a spanning forest comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_spread, packed, release, split_touched, unpacked
from .simhash import BUCKET, components

WORDS = 5
SIMILARITY = 0.8
SEGMENTS, SAMPLE = 24, 5
#: Of the whole document's fingerprint: 504 bits. A distance of 120 is over five deviations above that of a similarity
#: of 0.8; texts that have nothing in common differ in about half of all bits.
TABLES, BITS, DISTANCE = 21, 24, 120
#: Shingles of a block that one group reads.
CHUNK = 1 << 18
#: Shingles that are put in a segment's order at a time.
STEP = 1 << 13
_ODD = np.random.default_rng(5).integers(0, 2**63, SEGMENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_MIX = np.uint64(0x9E3779B97F4A7C15)
_WIDE = np.random.default_rng(6).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the different shingles; of a shorter text the whole is one, without words there is
    none. A shingle's hash is made of its words' hashes."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six white spaces only
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ own[i : len(own) - size + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def segments(own: np.ndarray) -> np.ndarray:
    """The segments of the fingerprint of a set of shingles, as signed integers; none for no shingle."""
    if not len(own):
        return np.zeros(0, np.int64)
    least, order = own[None, :0].repeat(SEGMENTS, 0), _ODD[:, None] * own[None, :0]
    for i in range(0, len(own), STEP):
        part = own[i : i + STEP]
        least, order = np.concatenate([least, np.broadcast_to(part, (SEGMENTS, len(part)))], 1), np.concatenate([order, _ODD[:, None] * part], 1)
        if least.shape[1] > SAMPLE:
            at = np.argpartition(order, SAMPLE - 1, axis=1)[:, :SAMPLE]
            least, order = np.take_along_axis(least, at, 1), np.take_along_axis(order, at, 1)
    ones = np.unpackbits(least.astype(">u8").view(np.uint8).reshape(SEGMENTS, -1, 8), axis=2).sum(1, dtype=np.int64)
    return np.packbits(2 * ones > least.shape[1], axis=1).view(">i8").ravel().astype(np.int64)


def fingerprint(own: np.ndarray) -> np.ndarray | None:
    """The whole fingerprint of a set of shingles: a segment for each table, below the table's number. None for no
    shingle."""
    if not len(own):
        return None
    ones = np.zeros(512, np.int64)
    for i in range(0, len(own), 255):
        z = own[i : i + 255, None] * _WIDE
        z = (z ^ (z >> np.uint64(29))) * _MIX
        z ^= z >> np.uint64(32)
        ones += np.unpackbits(z.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    b = np.packbits(2 * ones > len(own))[: TABLES * BITS // 8].reshape(TABLES, BITS // 8).astype(np.int32)
    return np.arange(TABLES, dtype=np.int32) << BITS | b[:, 0] << 16 | b[:, 1] << 8 | b[:, 2]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t) for t in b.column(2).to_pylist()]
        nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets), np.uint64, len(sets)).view(np.int64)
        columns = [b.column(0), b.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array([segments(s) for s in sets], pa.list_(pa.int64())), pa.array([fingerprint(s) for s in sets], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "node", "n", "keys", "wide"])


def entries(docs: DataFrame) -> DataFrame:
    """(doc_id, t: hash of the text, node: hash of its shingles, n: their number, keys: segments of samples,
    wide: segments of the whole) of each row."""
    return checkpoint(docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(_entries, "doc_id bigint, t bigint, node bigint, n bigint, keys array<bigint>, wide array<int>"))


def verified(sets: list[np.ndarray], slots: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of places whose sets have the least similarity; with two slots,
    of the pairs across them."""
    sizes = np.array([len(s) for s in sets])
    slot, across = np.array(slots), len(set(slots)) > 1
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(inverse, kind="stable")]
    starts, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
    parent, out = list(range(len(sets))), []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for x in range(len(sets)):
        if across and slot[x] != slot.min():
            continue
        own = inverse[ends[x] - sizes[x] : ends[x]]
        length = counts[own]
        at = np.repeat(starts[own] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        common = np.bincount(holders[at], minlength=len(sets))
        alike = common >= SIMILARITY * (sizes[x] + sizes - common) - 1e-9
        alike &= (slot != slot[x]) if across else (np.arange(len(sets)) > x)
        for y in np.flatnonzero(alike).tolist():
            if (a := find(x)) != (b := find(y)):
                parent[a] = b
                out.append((x, y))
    return out


def _group(group: pa.Table) -> pa.Table:
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    nodes, slots = group.column("node").to_pylist(), group.column("slot").to_pylist()
    found = [] if i != j and len(set(slots)) < 2 else verified([shingles(t) for t in group.column("text").to_pylist()], slots)
    return pa.table({"a": pa.array([nodes[x] for x, _ in found], pa.int64()), "b": pa.array([nodes[y] for _, y in found], pa.int64())})


def neighbours(own: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes within ``DISTANCE`` that connect all that a probe of a ball brings together.

    A probe is compared with the least node of its bucket. Both of a pair that are within its distance are
    connected by it; only of the others a probe meets the whole bucket. In a bucket above ``BUCKET`` these are filed
    again under their other segments, where each meets the least; the tables of samples hold all of them too, and
    have no such limit.
    """
    whole = checkpoint(own.where("wide is not null").select("node", "wide").dropDuplicates(["node"]))
    table = whole.select("node", F.explode("wide").alias("value"))
    sizes = table.groupBy("value").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    ball = F.expr(f"concat(array(own), transform(filter(sequence(0, {BITS - 1}), i -> (own & shiftleft(1, i)) = 0), i -> own | shiftleft(1, i)))")
    probes = table.select("node", F.col("value").alias("own")).select("node", "own", F.explode(ball).alias("value"))
    met = checkpoint(probes.join(sizes.hint("shuffle_hash"), "value").where("n > 1 or own <> value").select("value", "node", F.expr("own = value").alias("member"), "n", "least"))
    of = lambda c: whole.select(F.col("node").alias(c), F.col("wide").alias(f"_{c}"))
    apart = sum((F.bit_count(F.col("_a")[i].bitwiseXOR(F.col("_b")[i])) for i in range(1, TABLES)), F.bit_count(F.col("_a")[0].bitwiseXOR(F.col("_b")[0])))
    within = lambda pairs: pairs.join(of("a"), "a").join(of("b"), "b").where(apart <= DISTANCE).select("a", "b")
    first = checkpoint(within(met.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()))
    near = first.select(F.col("a").alias("least"), F.col("b").alias("node"), F.lit(True).alias("near"))
    seen = checkpoint(met.where("n > 1").join(near, ["least", "node"], "left").withColumn("near", F.expr("near is not null or node = least")))
    members = seen.where("member").select("value", F.col("node").alias("b"), F.col("near").alias("_near"))
    fetched = seen.where(F.col("n") <= BUCKET).select("value", F.col("node").alias("a"), "near", "least").join(members, "value").where("not (near and _near) and a <> b and a <> least and b <> least")
    again = seen.where(F.col("member") & ~F.col("near") & (F.col("n") > BUCKET)).select("node", "value").join(whole, "node").select("node", "value", F.explode("wide").alias("other")).where("other <> value")
    files = again.groupBy("value", "other").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).where(F.size("all") > 1)
    pairs = fetched.select("a", "b").union(files.select("a", F.explode("all"))).where("a <> b")
    return first.union(within(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))


def candidates(own: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes: neighbours, and those that connect all nodes which share a segment of samples,
    each with the entry's least."""
    near = checkpoint(neighbours(own))
    release(own.sparkSession)
    filed = own.select("node", F.posexplode("keys").alias("segment", "value")).select("node", F.xxhash64("segment", "value").alias("key"))
    held = checkpoint(filed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).where("a < b"))
    more = held.where("n > 2").select("key", "a", "n")
    touched, _ = split_touched(filed, "key", more, "key")
    rest = join_spread(touched, more, "key").select("a", F.col("node").alias("b")).where("a < b")
    return near.union(held.select("a", "b")).union(rest)


def links(docs: DataFrame, own: DataFrame) -> DataFrame:
    """Links (a, b) of nodes that join the same components as all pairs of candidates with the least
    similarity do. own: entries of docs. Of the texts, those of candidates alone are moved."""
    roots = components(candidates(own))
    blocks = roots.union(roots.select("root", "root").distinct()).toDF("node", "block")
    nodes = own.groupBy("node").agg(F.min("t").alias("t"), F.max("n").alias("n"))
    members = checkpoint(blocks.join(nodes, "node"))
    parts = members.groupBy("block").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("parts"), F.count("*").alias("n"))
    slots = join_spread(members.drop("n"), checkpoint(parts), "block")
    slots = checkpoint(slots.withColumn("slot", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    near, _ = split_touched(docs.select(F.xxhash64("text").alias("t"), "text"), "t", slots, "t")
    texts = near.dropDuplicates(["t"]).join(slots, "t")
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("block", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot", "node", "text")
    return dealt.groupBy("block", "i", "j").applyInArrow(_group, "a bigint, b bigint")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of links: of the least doc_id, then of the least hash of the text; rows
    without a doc_id come last. Rows may share a doc_id: each text counts by itself, and of rows that share
    both one stays. Null texts and texts without words are one node. Columns as they came; an empty table
    gives an empty table. Rows that are like no other are not moved."""
    own = entries(docs)
    roots = components(links(docs, own))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.coalesce("doc_id", F.lit(0)).alias("id"), "t"))
    nodes = own.groupBy("node").agg(least.alias("least"), F.count("*").alias("rows"))
    rooted = checkpoint(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    groups = rooted.groupBy("root").agg(F.min("least").alias("first"), F.sum("rows").alias("rows"), F.count("*").alias("n"))
    members = checkpoint(join_spread(rooted.select("node", "root", F.col("rows").alias("own")), checkpoint(groups.where("rows > 1").drop("rows")), "root"))
    key = F.struct(F.col("doc_id").isNull().alias("no"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("t"))
    touched = join_spread(own.select("node", key.alias("key")), members.select("node", "first", F.col("own").alias("n")), "node")
    touched = checkpoint(touched.select("key.*", (F.col("key") == F.col("first")).alias("stays")).distinct())
    rows = packed(docs, no=F.col("doc_id").isNull(), id=F.coalesce("doc_id", F.lit(0)), t=F.xxhash64("text"))
    hit, rest = split_touched(rows, "t", touched, "t")
    names = ["no", "id", "t"]
    kept = hit.join(touched.where("not stays"), names, "left_anti").dropDuplicates(names)
    return unpacked(rest.unionByName(kept), docs.columns)
