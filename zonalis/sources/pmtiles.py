"""Tile archives (PMTiles version 3): reader, writer and Spark data source ``pmtiles``."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import png
from .ranges import Ranges

HEADER = 127
NONE, GZIP = 1, 2
TYPES = {0: "unknown", 1: "mvt", 2: "png", 3: "jpeg", 4: "webp", 5: "avif"}
_FIELDS = "<7sB" + "Q" * 11 + "BBBBBB" + "iiiiB" + "ii"
_NAMES = "root_offset root_length metadata_offset metadata_length leaf_offset leaf_length data_offset data_length addressed entries contents clustered internal tile_compression tile_type min_zoom max_zoom west south east north centre_zoom centre_lon centre_lat".split()


class TileError(ValueError):
    pass


def tile_id(z: int, x: int, y: int) -> int:
    """Place of the tile on the Hilbert curves of all zooms, one after the other."""
    d, rx, ry = 0, 0, 0
    side = 1 << z
    s = side >> 1
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = s - 1 - (x & (s - 1)), s - 1 - (y & (s - 1))
            x, y = y, x
        x, y = x & (s - 1), y & (s - 1)
        s >>= 1
    return (4**z - 1) // 3 + d


def _varints(data: bytes) -> Iterator[int]:
    value = shift = 0
    for byte in data:
        value |= (byte & 127) << shift
        if byte & 128:
            shift += 7
        else:
            yield value
            value = shift = 0


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_directory(data: bytes) -> list[tuple[int, int, int, int]]:
    """(tile id, run length, length, offset); a run length of 0 points to a leaf."""
    numbers = _varints(data)
    n = next(numbers)
    ids, last = [], 0
    for _ in range(n):
        last += next(numbers)
        ids.append(last)
    runs, lengths = [next(numbers) for _ in range(n)], [next(numbers) for _ in range(n)]
    offsets: list[int] = []
    for i in range(n):
        v = next(numbers)
        offsets.append(offsets[-1] + lengths[i - 1] if v == 0 and i else v - 1)
    return list(zip(ids, runs, lengths, offsets, strict=True))


def write_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    out, last = [_varint(len(entries))], 0
    for i, _, _, _ in entries:
        out.append(_varint(i - last))
        last = i
    out += [_varint(r) for _, r, _, _ in entries] + [_varint(n) for _, _, n, _ in entries]
    for k, (_, _, _, offset) in enumerate(entries):
        follows = k and offset == entries[k - 1][3] + entries[k - 1][2]
        out.append(_varint(0 if follows else offset + 1))
    return b"".join(out)


def inflate(data: bytes, compression: int) -> bytes:
    if compression == GZIP:
        return gzip.decompress(data)
    if compression != NONE:
        raise TileError(f"tile compression {compression} is not read")
    return data


class Archive:
    def __init__(self, ranges: Ranges):
        self.ranges = ranges
        head = ranges.read(0, HEADER)
        if head[:7] != b"PMTiles" or head[7] != 3:
            raise TileError("not a tile archive of version 3")
        self.header = dict(zip(_NAMES, struct.unpack(_FIELDS, head)[2:], strict=True))
        h = self.header
        self.root = read_directory(inflate(ranges.read(h["root_offset"], h["root_length"]), h["internal"]))

    def metadata(self) -> dict:
        h = self.header
        return json.loads(inflate(self.ranges.read(h["metadata_offset"], h["metadata_length"]), h["internal"])) if h["metadata_length"] else {}

    def get(self, z: int, x: int, y: int) -> bytes | None:
        """The tile as it is stored, or None."""
        wanted, entries, h = tile_id(z, x, y), self.root, self.header
        for _ in range(4):
            lo, hi = 0, len(entries)
            while lo < hi:
                middle = (lo + hi) // 2
                lo, hi = (middle + 1, hi) if entries[middle][0] <= wanted else (lo, middle)
            if not lo:
                return None
            first, run, length, offset = entries[lo - 1]
            if run:
                return self.ranges.read(h["data_offset"] + offset, length) if wanted < first + run else None
            entries = read_directory(inflate(self.ranges.read(h["leaf_offset"] + offset, length), h["internal"]))
        return None

    def image(self, z: int, x: int, y: int) -> np.ndarray | None:
        if TYPES.get(self.header["tile_type"]) != "png":
            raise TileError("only PNG tiles are read")
        data = self.get(z, x, y)
        return None if data is None else png.decode(inflate(data, self.header["tile_compression"]))

    def entries(self, offset: int, length: int) -> Iterator[tuple[int, int]]:
        """(tile id, run length) of all entries of a leaf, and of leaves below it."""
        stack = [(offset, length)]
        while stack:
            at, n = stack.pop()
            for first, run, size, place in read_directory(inflate(self.ranges.read(self.header["leaf_offset"] + at, n), self.header["internal"])):
                if run:
                    yield first, run
                else:
                    stack.append((place, size))

    def tiles(self) -> Iterator[tuple[int, int]]:
        """(tile id, run length) of all entries."""
        for first, run, length, offset in self.root:
            if run:
                yield first, run
            else:
                yield from self.entries(offset, length)


def write(path: str, tiles: dict[tuple[int, int, int], bytes], metadata: dict | None = None, compression: int = NONE, tile_type: int = 2, leaf: int = 0) -> None:
    """Tiles by (z, x, y). compression: of the tiles; leaf: entries of a leaf directory (0: no leaves)."""
    body, entries, offset = [], [], 0
    for (z, x, y), data in sorted(tiles.items(), key=lambda t: tile_id(*t[0])):
        data = gzip.compress(data) if compression == GZIP else data
        body.append(data)
        entries.append((tile_id(z, x, y), 1, len(data), offset))
        offset += len(data)
    leaves, root = b"", entries
    if leaf:
        root = []
        for i in range(0, len(entries), leaf):
            part = gzip.compress(write_directory(entries[i : i + leaf]))
            root.append((entries[i][0], 0, len(part), len(leaves)))
            leaves += part
    top, meta = gzip.compress(write_directory(root)), gzip.compress(json.dumps(metadata or {}).encode())
    zooms = [z for z, _, _ in tiles] or [0]
    at = [HEADER, len(top), HEADER + len(top), len(meta), HEADER + len(top) + len(meta), len(leaves), HEADER + len(top) + len(meta) + len(leaves), offset]
    head = struct.pack(_FIELDS, b"PMTiles", 3, *at, len(entries), len(entries), len(entries), 1, GZIP, compression, tile_type, min(zooms), max(zooms), -1800000000, -850000000, 1800000000, 850000000, min(zooms), 0, 0)
    with open(path, "wb") as f:
        f.write(head + top + meta + leaves + b"".join(body))


def decode_id(number: int) -> tuple[int, int, int]:
    """z, x, y of a place on the curves."""
    z = 0
    while number >= 4**z:
        number -= 4**z
        z += 1
    x = y = 0
    s = 1
    while s < 1 << z:
        rx = 1 & (number // 2)
        ry = 1 & (number ^ rx)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y = x + s * rx, y + s * ry
        number //= 4
        s *= 2
    return z, x, y


PIXELS = "source string, z int, x int, y int, row int, col int, bands int, b0 int, b1 int, b2 int, b3 int"
TILES = "source string, z int, x int, y int, data binary"
HEADERS = "source string, tile_type string, tile_compression int, min_zoom int, max_zoom int, metadata_keys array<string>"
_ARROW = {
    "pixels": pa.schema([("source", pa.string()), *((n, pa.int32()) for n in ("z", "x", "y", "row", "col", "bands", "b0", "b1", "b2", "b3"))]),
}


def box_ranges(z: int, west: int, east: int, north: int, south: int, most: int = 256) -> list[tuple[int, int]]:
    """Ranges [first, end) of tile ids that cover the tiles of a box of x and y, inclusive, at a zoom. A square
    of the curve is whole, empty or cut in four; beyond ``most`` squares the cut ones are taken whole."""
    if west > east or north > south:
        return []
    start, out, squares = (4**z - 1) // 3, [], [(0, 0, 1 << z)]
    while squares:
        cut = []
        for x, y, side in squares:
            if x > east or y > south or x + side <= west or y + side <= north:
                continue
            inside = x >= west and y >= north and x + side - 1 <= east and y + side - 1 <= south
            if inside or len(out) + len(squares) + len(cut) > most:
                first = tile_id(z, x, y) - start
                out.append((first - first % (side * side), side * side))  # a square is a run of the curve
            else:
                half = side // 2
                cut += [(x + i * half, y + j * half, half) for i in (0, 1) for j in (0, 1)]
        squares = cut
    merged: list[tuple[int, int]] = []
    for first, n in sorted(out):
        if merged and merged[-1][1] >= start + first:
            merged[-1] = merged[-1][0], max(merged[-1][1], start + first + n)
        else:
            merged.append((start + first, start + first + n))
    return merged


def _cut(first: int, end: int, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of [first, end) that lie in the ranges."""
    return [(max(a, first), min(b, end)) for a, b in ranges if a < end and b > first]


class TilesPartition(InputPartition):
    """Entries of a directory: runs of tile ids, and leaves (offset, length) that the task reads itself."""

    def __init__(self, runs: list[tuple[int, int]], leaves: list[tuple[int, int]]):
        self.runs, self.leaves = runs, leaves


class PMTilesSource(DataSource):
    """spark.read.format("pmtiles").option("path", ...): mode ``pixels`` (default), ``tiles`` or ``header``.

    Filters on z, x and y choose the tiles before anything is read (with
    spark.sql.python.filterPushdown.enabled). tiles_per_task: 64 unless set; cache: folder of a disk cache.
    """

    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        return {"pixels": PIXELS, "tiles": TILES, "header": HEADERS}[self.options.get("mode", "pixels")]

    def reader(self, schema) -> DataSourceReader:
        return PMTilesReader(dict(self.options))


class PMTilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.mode = options["path"], options.get("mode", "pixels")
        self.each, self.folder = int(options.get("tiles_per_task", 64)), options.get("cache")
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        names = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in names and f.attribute in (("z",), ("x",), ("y",)) and self.mode != "header":
                self.wanted.append((f.attribute[0], names[type(f)], f.value))
            else:
                yield f

    def _fits(self, tile: tuple[int, int, int]) -> bool:
        at = dict(zip("zxy", tile, strict=True))
        tests = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "in": lambda a, b: a in b}
        return all(tests[op](at[name], value) for name, op, value in self.wanted)

    def _bounds(self, name: str, most: int) -> tuple[int, int]:
        """The least and greatest value that the filters on a name leave."""
        low, high = 0, most
        for at, op, value in self.wanted:
            if at != name:
                continue
            values = list(value) if op == "in" else [value]
            if not values:
                return 1, 0
            if op in ("=", ">=", ">", "in"):
                low = max(low, min(values) + (op == ">"))
            if op in ("=", "<=", "<", "in"):
                high = min(high, max(values) - (op == "<"))
        return low, high

    def _ranges(self, header: dict) -> list[tuple[int, int]]:
        """Ranges of tile ids that the filters' bounds leave."""
        low, high = self._bounds("z", header["max_zoom"])
        out = []
        for z in range(max(low, header["min_zoom"]), high + 1):
            (west, east), (north, south) = self._bounds("x", (1 << z) - 1), self._bounds("y", (1 << z) - 1)
            out += box_ranges(z, west, east, north, south)
        return out

    def partitions(self) -> list[InputPartition]:
        """The driver reads the root directory alone: its runs are cut to the filters' ranges and dealt out by
        ``tiles_per_task``, and a leaf that the ranges meet is a task of its own."""
        if self.mode == "header":
            return [TilesPartition([], [])]
        archive = Archive(Ranges(self.path, self.folder))
        ranges = self._ranges(archive.header)
        ends = [e[0] for e in archive.root[1:]] + [(4 ** (archive.header["max_zoom"] + 1) - 1) // 3]
        out: list[InputPartition] = []
        runs: list[tuple[int, int]] = []
        for (first, run, length, offset), end in zip(archive.root, ends, strict=True):
            for a, b in _cut(first, first + run if run else end, ranges):
                if not run:
                    out.append(TilesPartition([], [(offset, length)]))
                    break
                runs += [(i, min(i + self.each, b)) for i in range(a, b, self.each)]
        held, n = [], 0
        for a, b in runs:
            if held and n + b - a > self.each:
                out.append(TilesPartition(held, []))
                held, n = [], 0
            held.append((a, b))
            n += b - a
        return [*out, TilesPartition(held, [])] if held or not out else out

    def _tiles(self, archive: Archive, partition: TilesPartition) -> Iterator[tuple[int, int, int]]:
        ranges = self._ranges(archive.header)
        runs = list(partition.runs)
        for offset, length in partition.leaves:
            for first, run in archive.entries(offset, length):
                runs += _cut(first, first + run, ranges)
        for a, b in runs:
            yield from (t for i in range(a, b) if self._fits(t := decode_id(i)))

    def read(self, partition: TilesPartition) -> Iterator:
        archive = Archive(Ranges(self.path, self.folder))
        if self.mode == "header":
            h = archive.header
            yield (self.path, TYPES.get(h["tile_type"], "unknown"), h["tile_compression"], h["min_zoom"], h["max_zoom"], sorted(archive.metadata()))
            return
        for z, x, y in self._tiles(archive, partition):
            if self.mode == "tiles":
                yield (self.path, z, x, y, archive.get(z, x, y))
                continue
            image = archive.image(z, x, y)
            if image is not None:
                yield pixel_batch(self.path, z, x, y, image)


def pixel_batch(source: str, z: int, x: int, y: int, image: np.ndarray) -> pa.RecordBatch:
    n, flat = png.bands(image)
    height, width = image.shape[:2]
    size = height * width
    full = lambda v: pa.array(np.full(size, v, np.int32))
    columns = [pa.array([source] * size), full(z), full(x), full(y), pa.array(np.repeat(np.arange(height, dtype=np.int32), width)), pa.array(np.tile(np.arange(width, dtype=np.int32), height)), full(n), *map(pa.array, flat)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW["pixels"])
