"""GeoTIFF: windowed reader, tiled writer with overviews, quality report and Spark data source ``geotiff``."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .ranges import Ranges

#: Tags of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
SUBFILE, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 254, 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, GEOKEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
_TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
BLOCK = 512
EPSG_KEYS = (3072, 2048)


class Raster:
    """Header of the first image, and blocks by need."""

    def __init__(self, ranges: Ranges, image: int = 0):
        self.ranges = ranges
        start = ranges.read(0, 8)
        self.order = {b"II": "<", b"MM": ">"}[start[:2]]
        magic, at = struct.unpack(self.order + "HI", start[2:])
        if magic != 42:
            raise ValueError("not a classic TIFF")
        self.directories: list[dict[int, tuple]] = []
        while at:
            tags, at = self._directory(at)
            self.directories.append(tags)
        t = self.tags = self.directories[image]
        self.width, self.height = t[WIDTH][0], t[HEIGHT][0]
        self.count = t.get(SAMPLES, (1,))[0]
        kind = {1: "u", 2: "i", 3: "f"}[t.get(SAMPLE_FORMAT, (1,))[0]]
        self.dtype = np.dtype(f"{self.order}{kind}{t[BITS][0] // 8}")
        self.tiled = TILE_WIDTH in t
        self.block = (t[TILE_HEIGHT][0], t[TILE_WIDTH][0]) if self.tiled else (t.get(ROWS_PER_STRIP, (self.height,))[0], self.width)
        self.offsets, self.counts = (t[TILE_OFFSETS], t[TILE_COUNTS]) if self.tiled else (t[STRIP_OFFSETS], t[STRIP_COUNTS])
        self.compression, self.predictor = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0]
        first = self.directories[0]
        sx, sy = first.get(SCALE, (1.0, 1.0))[:2]
        tie = first.get(TIEPOINT, (0, 0, 0, 0, 0, 0))
        factor = first[WIDTH][0] / self.width
        self.grid = {"x0": tie[3] - tie[0] * sx, "y0": tie[4] + tie[1] * sy, "width": sx * factor, "height": sy * factor, "rows": self.height, "cols": self.width}
        keys = first.get(GEOKEYS, ())
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4)}
        self.epsg = next((codes[k] for k in EPSG_KEYS if k in codes), None)
        text = b"".join(first.get(NODATA, ())).rstrip(b"\0 ").decode() if NODATA in first else ""
        self.nodata = float(text) if text else None
        self.metadata = b"".join(first.get(METADATA, ())).rstrip(b"\0").decode()

    def _directory(self, at: int) -> tuple[dict[int, tuple], int]:
        n = struct.unpack(self.order + "H", self.ranges.read(at, 2))[0]
        data = self.ranges.read(at + 2, 12 * n + 4)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack(self.order + "HHI", data[12 * i : 12 * i + 8])
            code, size = _TYPES.get(kind, ("B", 1))
            value = data[12 * i + 8 : 12 * i + 12]
            if size * count > 4:
                value = self.ranges.read(struct.unpack(self.order + "I", value)[0], size * count)
            tags[tag] = struct.unpack(f"{self.order}{count}{code}" if len(code) == 1 else f"{self.order}{2 * count}I", value[: size * count])
        return tags, struct.unpack(self.order + "I", data[-4:])[0]

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    def read_block(self, index: int) -> np.ndarray:
        """(rows, cols, samples) of one block; a block of no bytes is nodata."""
        rows, cols = self.block
        if not self.tiled:
            rows = min(rows, self.height - index * rows)
        if not self.counts[index]:
            return np.full((rows, cols, self.count), self.nodata or 0, self.dtype)
        data = self.ranges.read(self.offsets[index], self.counts[index])
        if self.compression in (8, 32946):
            data = zlib.decompress(data)
        elif self.compression != 1:
            raise ValueError(f"TIFF compression {self.compression} is not read")
        size = self.dtype.itemsize
        if self.predictor == 3:
            raw = np.frombuffer(data, np.uint8)[: rows * cols * self.count * size].reshape(rows, -1)
            raw = np.add.accumulate(raw.reshape(rows, -1, self.count), axis=1, dtype=np.uint8).reshape(rows, size, cols * self.count)
            whole = np.ascontiguousarray(raw.transpose(0, 2, 1)).view(self.dtype.newbyteorder(">"))
            return whole.reshape(rows, cols, self.count).astype(self.dtype)
        block = np.frombuffer(data, self.dtype)[: rows * cols * self.count].reshape(rows, cols, self.count)
        return np.add.accumulate(block, axis=1, dtype=self.dtype) if self.predictor == 2 else block

    def window(self, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
        """(rows, cols, samples) of rows [r0, r1) and columns [c0, c1); only their blocks are read."""
        h, w = self.block
        out = np.zeros((r1 - r0, c1 - c0, self.count), self.dtype.newbyteorder("="))
        for i in range(r0 // h, -(-r1 // h)):
            for j in range(c0 // w, -(-c1 // w)):
                block = self.read_block(i * self.across + j)
                a, b = max(r0, i * h), min(r1, i * h + block.shape[0])
                c, d = max(c0, j * w), min(c1, (j + 1) * w)
                out[a - r0 : b - r0, c - c0 : d - c0] = block[a - i * h : b - i * h, c - j * w : d - j * w]
        return out

    def valid(self, values: np.ndarray) -> np.ndarray:
        if values.dtype.kind == "f":
            return np.isfinite(values) & (~np.isclose(values, self.nodata) if self.nodata is not None else True)
        return values != self.nodata if self.nodata is not None else np.ones(values.shape, bool)


def compress_block(block: np.ndarray) -> bytes:
    """Deflate, with differences of integers or bytes of floats side by side."""
    block = np.ascontiguousarray(block)
    if block.dtype.kind == "f":
        size = block.dtype.itemsize
        planes = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(*block.shape, size).transpose(0, 2, 1).reshape(block.shape[0], -1)
        out = planes.copy()
        out[:, 1:] -= planes[:, :-1]
        return zlib.compress(out.tobytes(), 6)
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return zlib.compress(out.astype(block.dtype.newbyteorder("<")).tobytes(), 6)


def _tags(size: tuple[int, int], dtype: np.dtype, block: int, blocks: int, extra: dict[int, tuple[int, tuple | bytes]]) -> dict[int, tuple[int, tuple | bytes]]:
    rows, cols = size
    base = {WIDTH: (4, (cols,)), HEIGHT: (4, (rows,)), BITS: (3, (dtype.itemsize * 8,)), COMPRESSION: (3, (8,)), PHOTOMETRIC: (3, (1,)), SAMPLES: (3, (1,)), PLANAR: (3, (1,)), PREDICTOR: (3, (3 if dtype.kind == "f" else 2,))}
    return base | {TILE_WIDTH: (3, (block,)), TILE_HEIGHT: (3, (block,)), TILE_OFFSETS: (4, (0,) * blocks), TILE_COUNTS: (4, (0,) * blocks), SAMPLE_FORMAT: (3, ({"u": 1, "i": 2, "f": 3}[dtype.kind],))} | extra


def assemble(path: str, images: list[tuple[tuple[int, int], list[bytes]]], dtype: np.dtype, grid: dict, epsg: int, nodata: float, block: int = BLOCK, stats: tuple[float, float] | None = None) -> None:
    """One file of compressed blocks: the image, then its overviews. images: (rows, cols) and blocks."""
    note = ""
    if stats:
        note = f'<GDALMetadata><Item name="STATISTICS_MAXIMUM" sample="0">{stats[1]:.6f}</Item><Item name="STATISTICS_MINIMUM" sample="0">{stats[0]:.6f}</Item></GDALMetadata>'
    geo = {SCALE: (12, (grid["width"], grid["height"], 0.0)), TIEPOINT: (12, (0.0, 0.0, 0.0, grid["x0"], grid["y0"], 0.0)), NODATA: (2, f"{nodata:g}\0".encode())}
    key = 2048 if epsg == 4326 else 3072
    geo[GEOKEYS] = (3, (1, 1, 0, 3, 1024, 0, 1, 2 if epsg == 4326 else 1, 1025, 0, 1, 1, key, 0, 1, epsg))
    if note:
        geo[METADATA] = (2, (note + "\0").encode())
    heads = [_tags(size, dtype, block, len(blocks), geo if i == 0 else {SUBFILE: (4, (1,)), NODATA: geo[NODATA]}) for i, (size, blocks) in enumerate(images)]
    length = lambda kind, value: len(value) if isinstance(value, bytes) else _TYPES[kind][1] * len(value)
    starts, at = [], 8
    for tags in heads:
        starts.append(at)
        at += 6 + 12 * len(tags) + sum(n + n % 2 for kind, value in tags.values() if (n := length(kind, value)) > 4)
    for tags, (_, blocks) in zip(heads, images, strict=True):
        offsets = []
        for b in blocks:
            offsets.append(at)
            at += len(b)
        tags[TILE_OFFSETS], tags[TILE_COUNTS] = (4, tuple(offsets)), (4, tuple(map(len, blocks)))
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHI", b"II", 42, 8))
        for i, tags in enumerate(heads):
            rest, own, beyond = b"", [], starts[i] + 6 + 12 * len(tags)
            for tag, (kind, value) in sorted(tags.items()):
                raw = value if isinstance(value, bytes) else struct.pack(f"<{len(value)}{_TYPES[kind][0]}", *value)
                count = len(value)
                if len(raw) > 4:
                    own.append(struct.pack("<HHII", tag, kind, count, beyond + len(rest)))
                    rest += raw + b"\0" * (len(raw) % 2)
                else:
                    own.append(struct.pack("<HHI4s", tag, kind, count, raw.ljust(4, b"\0")))
            f.write(struct.pack("<H", len(tags)) + b"".join(own) + struct.pack("<I", starts[i + 1] if i + 1 < len(heads) else 0) + rest)
        for _, blocks in images:
            for b in blocks:
                f.write(b)


def _filler(across: int, block: int, kind: np.dtype, nodata: float) -> Callable[[pa.Table], pa.Table]:
    def fill(t: pa.Table) -> pa.Table:
        index = t.column("block")[0].as_py()
        out = np.full((block, block), nodata).astype(kind)
        v = t.column("v").to_numpy()
        out[t.column("row").to_numpy() - index // across * block, t.column("col").to_numpy() - index % across * block] = (np.rint(v) if kind.kind != "f" else v).astype(kind)
        return pa.table({"block": pa.array([index], pa.int32()), "data": pa.array([compress_block(out)], pa.binary())})

    return fill


def export(pixels: DataFrame, path: str, grid: dict, dtype: str, epsg: int = 3857, nodata: float = -9999.0, block: int = BLOCK, overviews: Iterable[int] = (2, 4, 8, 16, 32)) -> None:
    """Write pixels (row, col, v; absent or null: nodata) as one tiled file with averaged overviews.

    Blocks are filled and compressed by the executors; the driver strings compressed blocks together,
    so its memory is bounded by the compressed file. A level is added up from the greatest earlier level that
    divides it, as sums and counts, so the pixels themselves are read once.
    """
    kind = np.dtype(dtype)
    levels = [x for x in overviews if min(grid["rows"], grid["cols"]) // x >= 1] or [2]
    images = []
    base = pixels.where("v is not null").groupBy("row", "col").agg(F.sum(F.col("v").cast("double")).alias("s"), F.count("*").alias("n"))
    sums = {1: base.persist()}
    for level in (1, *levels):
        rows, cols = -(-grid["rows"] // level), -(-grid["cols"] // level)
        across, down = -(-cols // block), -(-rows // block)
        if level not in sums:
            last = max(x for x in sums if level % x == 0)
            step = lambda c: F.floor(F.col(c) / (level // last)).cast("int").alias(c)  # noqa: B023, E731
            sums[level] = sums[last].groupBy(step("row"), step("col")).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).persist()
        own = sums[level].select("row", "col", (F.col("s") / F.col("n")).alias("v"))
        keyed = own.withColumn("block", (F.floor(F.col("row") / block) * across + F.floor(F.col("col") / block)).cast("int"))

        empty = compress_block(np.full((block, block), nodata).astype(kind))
        blocks = [empty] * (across * down)
        for r in keyed.groupBy("block").applyInArrow(_filler(across, block, kind, nodata), "block int, data binary").toLocalIterator():
            blocks[r.block] = bytes(r.data)
        images.append(((rows, cols), blocks))
    extremes = pixels.agg(F.min("v"), F.max("v")).first()
    for held in sums.values():
        held.unpersist()
    stats = tuple(map(float, extremes)) if extremes[0] is not None else None
    assemble(path, images, kind, grid, epsg, nodata, block, stats)


def report(path: str) -> dict:
    """What a check of an output looks at."""
    r = Raster(Ranges(path))
    values = r.window(0, r.height, 0, r.width)[:, :, 0]
    valid = values[r.valid(values)]
    return {
        "width": r.width, "height": r.height, "dtype": r.dtype.name, "nodata": r.nodata, "compression": {1: None, 8: "deflate", 32946: "deflate"}.get(r.compression, str(r.compression)),
        "tiled": r.tiled, "block_shape": r.block, "overviews": [round(r.width / t[WIDTH][0]) for t in r.directories[1:]],
        "band_min": float(valid.min()) if valid.size else None, "band_max": float(valid.max()) if valid.size else None, "crs": r.epsg and f"EPSG:{r.epsg}", "pixel_size": (r.grid["width"], -r.grid["height"]),
    }


def differences(before: dict, after: dict) -> dict:
    return {k: (before.get(k), after.get(k)) for k in sorted({*before, *after}) if before.get(k) != after.get(k)}


PIXELS = "source string, row int, col int, x double, y double, value double, valid boolean"


class Window(InputPartition):
    def __init__(self, box: tuple[int, int, int, int]):
        self.box = box


class GeoTIFFSource(DataSource):
    """spark.read.format("geotiff").option("path", ...): pixels of a band (option ``band``, from 0).

    Filters on row and col narrow the window, of which only the blocks are read. A task reads a band of
    block rows. cache: folder of a disk cache for ranges.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> DataSourceReader:
        return GeoTIFFReader(dict(self.options))


class GeoTIFFReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.band, self.folder = options["path"], int(options.get("band", 0)), options.get("cache")
        self.low, self.high = {"row": 0, "col": 0}, {"row": None, "col": None}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in self.low and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
            if name in self.low and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                end = f.value + (not isinstance(f, LessThan))
                self.high[name] = end if self.high[name] is None else min(end, self.high[name])
            yield f

    def partitions(self) -> list[InputPartition]:
        r = Raster(Ranges(self.path, self.folder))
        end = lambda name, n: n if self.high[name] is None else min(n, self.high[name])
        r0, r1, c0, c1 = self.low["row"], end("row", r.height), self.low["col"], end("col", r.width)
        step = r.block[0] if r.tiled else max(r.block[0], 256)
        return [Window((max(r0, a), min(r1, a + step), c0, c1)) for a in range(r0 // step * step, r1, step)] if r0 < r1 and c0 < c1 else [Window((0, 0, 0, 0))]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        r0, r1, c0, c1 = partition.box
        if r0 >= r1:
            return
        r = Raster(Ranges(self.path, self.folder))
        for a in range(r0, r1, 64):
            b = min(r1, a + 64)
            values = r.window(a, b, c0, c1)[:, :, self.band]
            rows, cols = np.repeat(np.arange(a, b, dtype=np.int32), c1 - c0), np.tile(np.arange(c0, c1, dtype=np.int32), b - a)
            x, y = r.grid["x0"] + (cols + 0.5) * r.grid["width"], r.grid["y0"] - (rows + 0.5) * r.grid["height"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.path] * len(rows)), pa.array(rows), pa.array(cols), pa.array(x), pa.array(y), pa.array(values.reshape(-1).astype(np.float64)), pa.array(r.valid(values).reshape(-1))],
                schema=pa.schema([("source", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("value", pa.float64()), ("valid", pa.bool_())]),
            )
