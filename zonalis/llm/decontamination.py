"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

The items are a stated query set: they are read in blocks of bounded bytes and each block meets all
documents. A task turns a batch of documents into one sequence of token hashes, rolls a hash over every
window of ``MIN_TILE`` tokens and joins the values with the block's sorted seeds. Where an item and a
document share seeds enough, the longest unmarked common run is marked first and again and again, so
reordered passages still cover their item. Runs of a length are found by rolling that length over what
is unmarked, and the length by bisection: work and memory grow with the tokens, not with pairs of places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of the shortest tile, and the share of an item's tokens that tiles must cover. Sentences
#: shorter than a tile are lost when sentences change places, so less than the whole is asked for.
MIN_TILE = 5
THRESHOLD = 0.6
#: Bytes of a block, which the driver and every Python worker hold; an item of more is a block of its own.
BLOCK_BYTES = 64_000_000
#: At most what a character of an item takes: 24 bytes a token, and a token for two characters.
BYTES_PER_CHAR = 12
#: Characters of document text hashed at a time.
CHUNK_CHARS = 4_000_000
SCHEMA = "doc_id bigint, item_id bigint, coverage double, n_tiles bigint, n_tokens bigint"
BASE = np.uint64(0x9E3779B97F4A7C15)
TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def hashed(text: str | None) -> np.ndarray:
    own = tokens(text)
    return np.fromiter((xxhash.xxh64_intdigest(t) for t in own), np.uint64, len(own))


def windows(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin value of each window of k ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * BASE + ids[j : j + n]
    return out


class Rolled:
    """Values of windows of any length over a sequence, from the running values of its prefixes."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.free = ids, np.ones(len(ids), bool)
        # Two running values to a power of the base that divides out: prefix sums of id * BASE ** place.
        power = np.full(len(ids) + 1, BASE, np.uint64)
        power[0] = 1
        self.power = np.cumprod(power)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * self.power[:-1])])

    def values(self, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, values) of the windows of n free ids; most: a place that no sequence reaches."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[n:] == taken[: len(taken) - n]) if len(taken) > n else np.zeros(0, np.int64)
        # Shifting each window to the same power makes equal windows equal.
        return at, (self.sums[at + n] - self.sums[at]) * _powers(most)[most - at]


_POWERS = {0: np.ones(1, np.uint64)}


def _powers(n: int) -> np.ndarray:
    """BASE ** 0 to BASE ** n."""
    if len(_POWERS[0]) <= n:
        own = np.full(max(n + 1, 2 * len(_POWERS[0])), BASE, np.uint64)
        own[0] = 1
        _POWERS[0] = np.cumprod(own)
    return _POWERS[0]


def tiles(item: np.ndarray, text: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, length) of k ids or more: the longest common run of
    unmarked ids first; of equal ones that of the least place in the item, then in the text."""
    a, b, out = Rolled(item), Rolled(text), []
    most = max(len(item), len(text))

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        (p, u), (t, v) = a.values(n, most), b.values(n, most)
        mine, theirs = np.isin(u, v), np.isin(v, u)
        return p[mine], u[mine], t[theirs], v[theirs]

    high = min(len(item), len(text))
    while high >= k:
        low, found = k - 1, None
        while low < high:  # the greatest length with a common run
            n = (low + high + 1) // 2
            got = common(n)
            low, high, found = (n, high, got) if len(got[0]) else (low, n - 1, found)
        if found is None or low < k:
            break
        places: dict[int, list[int]] = {}
        for t, v in zip(found[2][::-1].tolist(), found[3][::-1].tolist(), strict=True):
            places.setdefault(v, []).append(t)
        for p, u in zip(found[0].tolist(), found[1].tolist(), strict=True):
            left = places.get(u, [])
            while left and a.free[p : p + low].all():
                t = left[-1]
                if not b.free[t : t + low].all():
                    left.pop()
                    continue
                if not np.array_equal(item[p : p + low], text[t : t + low]):
                    break
                a.free[p : p + low] = b.free[t : t + low] = False
                out.append((p, t, low))
        high = low - 1
    return out


class Block:
    """Seeds of a block of items: for each length, sorted values with the items and places that have them.
    Items of fewer than MIN_TILE tokens are one tile as a whole; items without a token match nothing."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        own = [(item_id, ids) for item_id, text in items if len(ids := hashed(text))]
        self.ids = [item_id for item_id, _ in own]
        self.items = [ids for _, ids in own]
        sizes = np.array([min(MIN_TILE, len(x)) for x in self.items], np.int64)
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        self.seeds = {}
        for k in np.unique(sizes).tolist():
            which = np.flatnonzero(sizes == k)
            rolled = [windows(self.items[i], k) for i in which]
            values = np.concatenate(rolled)
            order = np.argsort(values, kind="stable")
            item = np.repeat(which.astype(np.int32), [len(r) for r in rolled])
            place = np.concatenate([np.arange(len(r), dtype=np.int32) for r in rolled])
            self.seeds[k] = values[order], item[order], place[order]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.items) + sum(x.nbytes for seed in self.seeds.values() for x in seed)

    def _met(self, ids: np.ndarray, starts: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document, item, places in the item whose window the document has), each pair once."""
        values, items, places = self.seeds[k]
        rolled = windows(ids, k)
        first = np.searchsorted(values, rolled)
        hits = np.flatnonzero(values[np.minimum(first, len(values) - 1)] == rolled)
        docs = np.searchsorted(starts, hits, "right") - 1
        inside = hits + k <= starts[docs + 1]
        pairs = np.unique(np.stack([docs[inside], first[hits[inside]]], 1), axis=0)
        if not len(pairs):
            return
        count = np.searchsorted(values, values[pairs[:, 1]], "right") - pairs[:, 1]
        at = np.repeat(pairs[:, 1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        doc, item, place = np.repeat(pairs[:, 0], count), items[at], places[at]
        order = np.lexsort((place, item, doc))
        doc, item, place = doc[order], item[order], place[order]
        cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)], strict=True):
            yield int(doc[a]), int(item[a]), place[a:b]

    def matches(self, docs: list[tuple[int | None, str]]) -> Iterator[tuple]:
        """(doc_id, item_id, coverage, tiles, tokens covered) of each document and item above THRESHOLD."""
        parts = [hashed(text) for _, text in docs]
        if not parts:
            return
        ids, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        for k in self.seeds:
            for doc, i, places in self._met(ids, starts, k):
                own = self.items[i]
                gaps = np.diff(places, append=places[-1] + k)
                if np.minimum(gaps, k).sum() < THRESHOLD * len(own):  # no tiling can cover more than all seeds together
                    continue
                marked = tiles(own, parts[doc], k)
                covered = sum(n for _, _, n in marked)
                if covered >= THRESHOLD * len(own):
                    yield docs[doc][0], self.ids[i], covered / len(own), len(marked), covered


def _blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The items dealt by hash into blocks of about half of BLOCK_BYTES at most, one after the other."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size * BYTES_PER_CHAR * 2 // BLOCK_BYTES) or 1
    own = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    for i in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield Block([tuple(r) for r in part.toLocalIterator()])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document row and item whose tokens are covered by tiles to THRESHOLD or more.

    Null and empty texts match nothing, and neither do items without a token. Repeated rows of either
    table are matched each for itself. Null ids are returned as null. Empty tables give no rows; other
    columns are not read. Whole texts are compared; no limit is set on hits. A benchmark of several
    blocks reads the documents once a block.
    """
    context, out = docs.sparkSession.sparkContext, None
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    for part in _blocks(benchmark):
        block = context.broadcast(part)

        def match(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, some, size = [], [], 0
                for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    some.append(pair)
                    size += len(pair[1])
                    if size > CHUNK_CHARS:
                        rows += block.value.matches(some)
                        some, size = [], 0
                rows += block.value.matches(some)
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "coverage", "n_tiles", "n_tokens"])

        found = own.mapInArrow(match, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, as they came. A document is judged where it lies: nothing is
    shuffled, and rows without a doc_id are judged by their text like any other."""
    context, at = docs.sparkSession.sparkContext, docs.columns.index("text")
    for part in _blocks(benchmark):
        block = context.broadcast(part)

        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held, some, size = set(), [], 0
                for i, text in enumerate(b.column(at).to_pylist()):
                    some.append((i, text or ""))
                    size += len(text or "")
                    if size > CHUNK_CHARS:
                        held.update(x[0] for x in block.value.matches(some))
                        some, size = [], 0
                held.update(x[0] for x in block.value.matches(some))
                yield b.filter(pa.array([i not in held for i in range(b.num_rows)], pa.bool_())) if held else b

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
