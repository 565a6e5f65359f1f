"""Round trips of the file formats, the data sources and streams."""

import io
import json
import os
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.functions import decode
from zonalis.operators import tiles
from zonalis.plans import api
from zonalis.sources import frames, geotiff, jobfiles, legends, pmtiles, png, ranges, register
from zonalis.streaming import limits

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("shape", [(5, 7), (5, 7, 2), (4, 4, 3), (3, 9, 4)])
@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_png_round_trip(shape, dtype):
    image = RNG.integers(0, np.iinfo(dtype).max, shape).astype(dtype)
    assert (png.decode(png.encode(image)) == image).all()


def test_png_filters():
    import struct
    import zlib

    image = RNG.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    flat, lines = image.reshape(6, -1).astype(int), []
    for i, row in enumerate(flat):
        up = flat[i - 1] if i else np.zeros(15, int)
        left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, up[:-3]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [np.zeros(15, int), left, up, (left + up) // 2, paeth][i % 5]
        lines.append(bytes([i % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes())
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (png.decode(data) == image).all()
    palette = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 1, 2, 3, 0, 0, 0)) + chunk(b"PLTE", bytes(range(12))) + chunk(b"tRNS", b"\x07") + chunk(b"IDAT", zlib.compress(b"\x00" + bytes([0b00011011]))) + chunk(b"IEND", b"")
    assert png.decode(palette).tolist() == [[[0, 1, 2, 7], [3, 4, 5, 255], [6, 7, 8, 255], [9, 10, 11, 255]]]
    with pytest.raises(ValueError):
        png.decode(b"x")


def test_hilbert_ids():
    assert [pmtiles.tile_id(*t) for t in [(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0)]] == [0, 1, 2, 3, 4, 5]
    for z in range(7):
        side = 2**z
        ids = {pmtiles.tile_id(z, x, y): (z, x, y) for x in range(side) for y in range(side)}
        assert len(ids) == side * side and all(pmtiles.decode_id(i) == t for i, t in ids.items())


@pytest.fixture
def archive(tmp_path):
    images = {(3, x, y): RNG.integers(0, 256, (8, 8, 4)).astype(np.uint8) for x in range(4) for y in range(3)}
    path = str(tmp_path / "a.pmtiles")
    pmtiles.write(path, {t: png.encode(i) for t, i in images.items()}, {"name": "n", "format": "png"}, pmtiles.GZIP, leaf=5)
    return path, images


def test_archive(archive, tmp_path):
    path, images = archive
    a = pmtiles.Archive(ranges.Ranges(path, str(tmp_path)))
    assert all((a.image(*t) == i).all() for t, i in images.items()) and a.get(3, 7, 7) is None and a.get(0, 0, 0) is None
    assert a.metadata()["name"] == "n" and (a.header["min_zoom"], a.header["max_zoom"]) == (3, 3)
    assert {pmtiles.decode_id(i) for i, _ in a.tiles()} == set(images)
    first = a.ranges.events
    again = pmtiles.Archive(ranges.Ranges(path, str(tmp_path)))
    assert first[0][2] == "network" and again.ranges.events[0][2] == "cache"


def test_ranges(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"0123456789")
    with pytest.raises(ranges.RangeError):
        ranges.fetch(str(path), 5, 10)
    r = ranges.Ranges(str(path), str(tmp_path / "c"))
    assert r.read(2, 3) == b"234" and r.read(2, 3) == b"234" and len(r.events) == 1
    name = os.path.join(r.folder, "2_3.bin")
    with open(name, "wb") as f:
        f.write(b"x")
    again = ranges.Ranges(str(path), str(tmp_path / "c"))
    assert again.read(2, 3) == b"234" and again.events[0][2] == "network"
    report = ranges.prewarm([str(path), str(tmp_path / "none")], str(tmp_path / "d"), lambda x: (x.read(4, 2), x.read(0, 2)))
    assert report[0]["ranges"] == [(0, 2), (4, 2)] and report[0]["network"] == 4 and report[1]["error"]


def test_pmtiles_source(spark, archive):
    path, images = archive
    register(spark)
    rows = spark.read.format("pmtiles").option("path", path).option("tiles_per_task", 2).load()
    assert rows.count() == 12 * 64
    one = rows.where("z = 3 and x = 2 and y = 1 and row = 4").orderBy("col").collect()
    assert [[r.b0, r.b1, r.b2, r.b3] for r in one] == images[3, 2, 1][4].tolist() and one[0].bands == 4
    assert rows.where("x >= 1 and x < 3").select("x", "y").distinct().count() == 6
    head = spark.read.format("pmtiles").option("path", path).option("mode", "header").load().first()
    assert (head.tile_type, head.min_zoom, head.metadata_keys) == ("png", 3, ["format", "name"])
    raw = spark.read.format("pmtiles").option("path", path).option("mode", "tiles").load().where("x = 0").count()
    assert raw == 3


def test_wrong_tiles_are_errors(tmp_path):
    path = str(tmp_path / "w.pmtiles")
    pmtiles.write(path, {(0, 0, 0): b"x"}, tile_type=1)
    with pytest.raises(pmtiles.TileError):
        pmtiles.Archive(ranges.Ranges(path)).image(0, 0, 0)
    with pytest.raises(pmtiles.TileError):
        pmtiles.inflate(b"x", 3)


GRID = {"x0": 100.0, "y0": 900.0, "width": 2.0, "height": 2.0, "rows": 70, "cols": 90}


@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32", "float64"])
def test_geotiff_round_trip(spark, tmp_path, dtype):
    values = RNG.integers(0, 200, (70, 90)).astype(dtype) + (np.array(0.5, dtype) if dtype[0] == "f" else np.array(0, dtype))
    rows = [(r, c, float(values[r, c])) for r in range(70) for c in range(90) if (r + c) % 17]
    path = str(tmp_path / "o.tif")
    geotiff.export(spark.createDataFrame(rows, "row int, col int, v double"), path, GRID, dtype, nodata=250.0 if dtype == "uint8" else -999.0, block=32)
    raster = geotiff.Raster(ranges.Ranges(path))
    got = raster.window(0, 70, 0, 90)[:, :, 0]
    mask = raster.valid(got)
    assert (mask == (np.add.outer(np.arange(70), np.arange(90)) % 17 > 0)).all() and (got[mask] == values[mask]).all()
    assert (raster.window(30, 40, 20, 70)[:, :, 0] == got[30:40, 20:70]).all()
    report = geotiff.report(path)
    assert report["tiled"] and report["compression"] == "deflate" and report["overviews"] == [2, 4, 8, 15, 30] or report["overviews"][:3] == [2, 4, 8]
    assert report["crs"] == "EPSG:3857" and report["pixel_size"] == (2.0, -2.0) and report["band_max"] == values[mask].max()
    assert geotiff.differences(report, {**report, "nodata": 1}) == {"nodata": (report["nodata"], 1)}
    small = geotiff.Raster(ranges.Ranges(path), 1).window(0, 35, 0, 45)[:, :, 0]
    block, ok = got[0:2, 0:2], mask[0:2, 0:2]
    mean = block[ok].astype(float).mean()
    assert small[0, 0] == pytest.approx(mean, abs=0.5 if dtype[0] in "ui" else 1e-3)


def test_geotiff_source(spark, tmp_path):
    values = np.arange(70 * 90, dtype=np.int16).reshape(70, 90)
    path = str(tmp_path / "s.tif")
    geotiff.export(spark.createDataFrame([(r, c, float(values[r, c])) for r in range(70) for c in range(90)], "row int, col int, v double"), path, GRID, "int16", block=32)
    register(spark)
    rows = spark.read.format("geotiff").option("path", path).load()
    assert rows.count() == 6300 and rows.agg(F.sum("value")).first()[0] == values.sum()
    some = rows.where("row >= 60 and row < 64 and col = 5").orderBy("row").collect()
    assert [r.value for r in some] == values[60:64, 5].tolist() and (some[0].x, some[0].y) == (111.0, 779.0)


def test_legends(spark, tmp_path):
    colours = tmp_path / "c.txt"
    colours.write_text("# comment\n3 31 141 73 255 # Forest Formation\n\nshort 1\n5 x 0 0 # bad\n99 1 2 3\n")
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps({"entries": [{"class_code": "9", "label": "P", "color": "#7a5900"}]}))
    project = tmp_path / "p.qgz"
    with zipfile.ZipFile(project, "w") as z:
        z.writestr("x.qgs", '<q><rasterrenderer><colorPalette><paletteEntry value="3" label="A &amp; B" color="#111111"/><paletteEntry color="#222222" value="3" label="late"/><paletteEntry value="" color="#3"/></colorPalette></rasterrenderer></q>')
    (tmp_path / "broken.qgz").write_bytes(b"no zip")
    rows = legends.colour_file(spark, str(colours)).orderBy("ord").collect()
    assert [(r.class_code, r.label, r.color) for r in rows] == [("3", "Forest Formation / Formasi Hutan", "#1f8d49"), ("99", "", "#010203")]
    assert legends.manifest(spark, str(manifest)).first().label == "P / Kebun Kayu"
    assert [(r.class_code, r.label) for r in legends.project(spark, str(project)).collect()] == [("3", "A & B / Formasi Hutan")]
    assert legends.project(spark, str(tmp_path / "broken.qgz")).count() == 0
    empty = tmp_path / "e.txt"
    empty.write_text("# none\n")
    assert [r.class_code for r in legends.entries(spark, str(empty), str(manifest), (str(project),)).collect()] == ["9"]


def test_tile_index(spark, tmp_path):
    path = tmp_path / "t.geojson"
    ring = [[[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"tile": "q1"}, "geometry": {"type": "Polygon", "coordinates": ring}}]}))
    index = legends.TileIndex(spark, str(path), ttl=1000)
    assert tuple(index.frame().first()) == ("q1", 0.0, 0.0, 2.0, 1.0) and index.frame() is index.rows


def test_frames(spark, tmp_path):
    painted = spark.createDataFrame([(1990, 0, 0, 9, 8, 7), (1991, 1, 1, 1, 2, 3)], "year int, py int, px int, r int, g int, b int")
    layers = [{"kind": "polygon", "id": "a", "rings": [[(10, 10), (30, 10), (30, 30), (10, 30), (10, 10)], [(15, 15), (25, 15), (25, 25), (15, 25), (15, 15)]], "color": (255, 0, 0), "fill_opacity": 0.5}, {"kind": "point", "id": "b", "x": 50, "y": 20, "color": (0, 0, 255)}]
    out = frames.render(frames.all_years(painted, (1990, 1991, 1992)), 128, 64, [("3", (31, 141, 73)), ("5", (4, 56, 29))], layers)
    head = frames.manifest(128, 64, 2, 0.5, 1.5, (1990, 1991, 1992))
    result = frames.write_tar(out, str(tmp_path / "f.tar.gz"), head)
    assert result["yearsRendered"] == 3
    with tarfile.open(tmp_path / "f.tar.gz") as tar:
        assert tar.getnames() == ["manifest.json", *(f"frames/frame_{y}.png" for y in (1990, 1991, 1992))]
        frame = png.decode(tar.extractfile("frames/frame_1990.png").read())
    assert frame.shape == (64 + frames.legend_height(2), 128, 3) == (head["height"], head["width"], 3)
    assert frame[0, 0].tolist() == [9, 8, 7] and frame[0, 5].tolist() == [255] * 3
    assert frame[12, 20].tolist() == [255, 128, 128] and frame[20, 20].tolist() == [255] * 3 and frame[10, 20].tolist() == [255, 0, 0]
    assert frame[20, 50].tolist() == [0, 0, 255] and frame[64, 3].tolist() == list(frames.DIVIDER)
    assert [31, 141, 73] in frame[64:].reshape(-1, 3).tolist()
    assert frames.write_zip(out, str(tmp_path / "f.zip"), "x")["status"] == "partial_success"
    assert zipfile.ZipFile(io.BytesIO((tmp_path / "f.zip").read_bytes())).namelist()[0] == "frame_1990.png"


def test_frame_from_tiles(spark):
    world = spark.createDataFrame([(0, 0, 0, 2)], "z int, x int, y int, size int")
    h = 20037508.342789244
    box = world.select("*", *[F.lit(v).alias(n) for n, v in (("left", -h), ("right", h), ("top", h), ("bottom", -h))])
    got = {(r.py, r.px): (r.row, r.col) for r in tiles.frame_pixels(box, 4, 4).collect()}
    assert got == {(y, x): (y // 2, x // 2) for y in range(4) for x in range(4)}


def test_canopy_from_archive(spark, tmp_path):
    image = np.zeros((256, 256, 3), np.uint8)
    image[:, :, 0] = 25
    path = str(tmp_path / "h.pmtiles")
    pmtiles.write(path, {(10, x, y): png.encode(image) for x in (511, 512) for y in (511, 512)})
    register(spark)
    area = api.aoi(spark, {"type": "Polygon", "coordinates": [[[-0.05, -0.05], [0.05, -0.05], [0.05, 0.05], [-0.05, 0.05], [-0.05, -0.05]]]})
    raw = spark.read.format("pmtiles").option("path", path).load()
    decoded = tiles.decode_tiles(raw, ["z", "x", "y"], "height").withColumn("valid", decode.value_valid(F.col("bands"), F.col("b1"), F.col("b3"))).withColumn("area", F.lit((40075016.685578488 / 1024 / 256) ** 2 / 10_000))
    out = api.canopy_stats(api.tile_pixels(decoded, area, 10), aoi_area_ha=area.area_ha)
    assert out["meanHeightM"] == pytest.approx(10.0, abs=1e-4) and out["coverageFraction"] == 1.0
    assert out["analyzedAreaHa"] == pytest.approx(area.area_ha, rel=0.04)


def _stream(spark, path, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def test_streaming_limiter(spark, tmp_path):
    schema = "event_id bigint, ip int, us bigint, method string"
    batches = [[(0, 1, 0, "POST"), (1, 1, 10_000_000, "POST"), (9, 1, 0, "GET")], [(2, 1, 20_000_000, "POST"), (3, 1, 61_000_000, "POST"), (4, 2, 0, "POST")]]
    stream = _stream(spark, str(tmp_path / "in"), schema, batches)
    q = limits.rate_limited(stream, limit=2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.event_id: r.admitted for r in spark.table("limited").collect()} == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_streaming_queue_and_log(spark, tmp_path):
    events = [[(1, 1, 10, "submit"), (2, 1, 11, "submit"), (3, 1, 12, "submit"), (4, 1, 13, "submit"), (5, 1, 14, "submit"), (6, 1, 15, "submit"), (7, 1, 10, "finish"), (8, 1, 12, "cancel")]]
    stream = _stream(spark, str(tmp_path / "in"), "seq bigint, worker int, job_id bigint, action string", events)
    q = limits.queue(stream).writeStream.format("memory").queryName("queued").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    out = sorted((r.seq, r.job_id, r.status) for r in spark.table("queued").collect())
    assert out[:6] == [(1, 10, "running"), (2, 11, "queued"), (3, 12, "deferred"), (4, 13, "deferred"), (5, 14, "deferred"), (6, 15, "rejected")]
    assert (7, 11, "running") in out and (7, 12, "queued") in out and (8, 12, "cancelled") in out and (8, 13, "queued") in out
    log = _stream(spark, str(tmp_path / "log"), "seq bigint, message string", [[(1, "a")], [(2, "b")]])
    f = limits.follow(log, "tail")
    f.processAllAvailable()
    f.stop()
    assert spark.table("tail").count() == 2


def test_job_files(spark, tmp_path):
    store = jobfiles.JobFiles(tmp_path / "jobs")
    assert store.get("a") is None and jobfiles.scan(spark, str(tmp_path)).count() == 0
    for i, status in enumerate(["queued", "running", "failed"]):
        store.put({"jobId": f"frames_{i}" if i else "crop_0", "status": status, "progress": i, "error": {"code": "x", "message": "é"} if i == 2 else None})
    assert store.merge("frames_1", {"status": "succeeded", "progress": 100})["status"] == "succeeded"
    assert store.get("frames_1")["progress"] == 100
    with pytest.raises(FileNotFoundError):
        store.merge("none", {})
    with pytest.raises(ValueError):
        store.get("../x")
    assert sorted(p.name for p in (tmp_path / "jobs").iterdir()) == ["crop_0.json", "frames_1.json", "frames_2.json"]
    rows = {r.jobId: r for r in jobfiles.scan(spark, str(tmp_path / "jobs")).collect()}
    assert rows["frames_2"].error.message == "é" and {k: r.status for k, r in rows.items()} == {"crop_0": "queued", "frames_1": "succeeded", "frames_2": "failed"}
    assert jobfiles.scan(spark, str(tmp_path / "jobs"), "frames_").count() == 2
    files = {r.path.rsplit("/", 1)[1]: r.length for r in jobfiles.listing(spark, str(tmp_path / "jobs"), "*.json").collect()}
    assert files["crop_0.json"] == (tmp_path / "jobs" / "crop_0.json").stat().st_size
    (tmp_path / "big").write_bytes(bytes(range(256)) * 10)
    assert [len(c) for c in jobfiles.chunks(str(tmp_path / "big"), 1000)] == [1000, 1000, 560]


def test_failed_rename_leaves_no_part(tmp_path, monkeypatch):
    def fails(self, target):
        raise OSError("full")

    monkeypatch.setattr("pathlib.Path.rename", fails)
    r = ranges.Ranges("x", str(tmp_path), get=lambda path, offset, length: b"a" * length)
    assert r.read(0, 5) == b"aaaaa" and not [f for f in tmp_path.rglob("*") if f.is_file()]


def test_boundary_and_multipolygon_index(spark, tmp_path):
    one, two = [[[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 6], [5, 5]]]
    path = tmp_path / "b.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"tile": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [one, two]}}]}))
    assert tuple(legends.TileIndex(spark, str(path)).frame().first()) == ("m", 0.0, 0.0, 6.0, 6.0)
    own = legends.boundary(spark, str(path))
    assert own.select("id").distinct().count() == 2 and own.count() == 8
    area = lambda x, y: {"type": "Polygon", "coordinates": [[[x, y], [x + 0.1, y], [x + 0.1, y + 0.1], [x, y + 0.1], [x, y]]]}
    assert api.aoi(spark, area(5.5, 5.5), boundary=own).area_ha > 0
    with pytest.raises(api.RequestError, match="outside"):
        api.aoi(spark, area(3.5, 3.5), boundary=own)
    metres = [[[x * 111319.49079327358, y * 111325.1428663851] for x, y in ring] for ring in one]
    path.write_text(json.dumps({"type": "Polygon", "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}, "coordinates": metres}))
    assert legends.boundary(spark, str(path)).agg({"x1": "max"}).first()[0] == pytest.approx(2.0)
    path.write_text('{"type": "Point", "coordinates": [1, 2]}')
    with pytest.raises(ValueError):
        legends.boundary(spark, str(path))


def test_leaves_are_read_by_tasks(spark, tmp_path):
    path = str(tmp_path / "leaves.pmtiles")
    image = np.zeros((2, 2, 4), np.uint8)
    wanted = {(z, x, y) for z in (0, 3, 5) for x in range(1 << z) for y in range(1 << z)}
    pmtiles.write(path, {t: png.encode(image) for t in wanted}, leaf=16)
    register(spark)
    tiles_ = spark.read.format("pmtiles").option("path", path).option("mode", "tiles").load().select("z", "x", "y")
    assert {tuple(r) for r in tiles_.collect()} == wanted
    box = tiles_.where("z = 5 and x >= 3 and x < 9 and y in (2, 7, 30)")
    assert {tuple(r) for r in box.collect()} == {t for t in wanted if t[0] == 5 and 3 <= t[1] < 9 and t[2] in (2, 7, 30)}
    reader = pmtiles.PMTilesReader({"path": path, "mode": "tiles"})
    reader.wanted = [("z", "=", 5), ("x", ">=", 3), ("x", "<", 9), ("y", "in", (2, 3))]
    assert 0 < len(reader.partitions()) < 20 and all(p.leaves for p in reader.partitions())
    ids = {pmtiles.tile_id(5, x, y) for x in range(3, 9) for y in range(2, 8)}
    assert {i for a, b in pmtiles.box_ranges(5, 3, 8, 2, 7) for i in range(a, b)} == ids
    assert ids <= {i for a, b in pmtiles.box_ranges(5, 3, 8, 2, 7, 3) for i in range(a, b)} and pmtiles.box_ranges(5, 3, 2, 0, 1) == []
