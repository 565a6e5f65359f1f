"""Hand-computed cases of the zonal, change, decode, polygon and job operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.functions import decode, geo, text
from zonalis.operators import change, jobs, legend, parts, polygon, tiles, zonal
from zonalis.plans import api, relations

PIXELS = "v double, valid boolean, area double"


def heights(spark, values, area=1.0):
    return spark.createDataFrame([(float(v), True, area) for v in values], PIXELS)


def test_canopy_cover(spark):
    out = api.canopy_stats(heights(spark, [1, 5, 13, 30]))
    assert (out["meanHeightM"], out["minHeightM"], out["maxHeightM"]) == (12.25, 1.0, 30.0)
    assert [x["coverRatio"] for x in out["canopyCoverByThreshold"]] == [0.75, 0.5, 0.25]
    assert [x["label"] for x in out["canopyCoverByRange"]] == ["<5m", "5-10m", "10-20m", ">=20m"]
    assert [x["coverRatio"] for x in out["canopyCoverByRange"]] == [0.25] * 4
    assert out["totalCanopyVolumeProxyM3"] == 490000.0 and out["coverageFraction"] == 1.0
    assert [x["thresholdM"] for x in api.canopy_stats(heights(spark, [1, 5]), [20, 2])["canopyCoverByThreshold"]] == [2, 20]


def test_canopy_errors(spark):
    for rows, message in [([], "no coverage"), ([(500.0, True, 1.0)], "no valid")]:
        with pytest.raises(api.RequestError, match=message):
            api.canopy_stats(spark.createDataFrame(rows, PIXELS))
    with pytest.raises(api.RequestError):
        api.thresholds([-1.0], (5.0,), 10)
    with pytest.raises(api.RequestError):
        api.thresholds(list(range(1, 12)), (5.0,), 10)


def test_biomass(spark):
    cells = spark.createDataFrame(list(zip([5.0, 15.0, 25.0, 35.0], [10.0, 20.0, 30.0, 40.0], strict=True)), "base double, comp double")
    out = api.biomass_stats(cells, 4.0)
    assert (out["meanAgbMgHa"], out["totalAgbMg"], out["baselineTotalAgbMg"], out["netChangeAgbMg"], out["netChangePercent"]) == (25.0, 100.0, 80.0, 20.0, 25.0)
    assert (out["agbIncreaseMg"], out["agbDecreaseMg"], out["agbIncreaseAreaHa"]) == (20.0, 0.0, 4.0)
    assert out["varianceAgbMgHa2"] == 125.0 and out["p25AgbMgHa"] == 17.5
    custom = api.biomass_stats(spark.createDataFrame([(5.0, 5.0), (7.5, 10.0), (8.0, 10.0), (9.5, 15.0)], "base double, comp double"), 4.0, [150, 25])
    assert [x["thresholdMgHa"] for x in custom["agbCoverByThreshold"]] == [25, 150]
    partial = api.biomass_stats(spark.createDataFrame([(1.0, None), (None, 3.0), (4.0, 5.0)], "base double, comp double"), 3.0)
    assert (partial["validPixelCount"], partial["agbIncreaseMg"], partial["coverageFraction"]) == (2, 1.0, 0.666667)


def test_landcover(spark):
    rows = [(3, 0, True, 0.25), (3, 3, True, 0.25), (0, 9, True, 0.25), (9, 9, True, 0.25)]
    out = api.landcover_change(spark.createDataFrame(rows, "b int, c int, valid boolean, area double"))
    assert (out["forestLossHa"], out["forestGainHa"], out["baselineForestHa"], out["netForestChangeHa"], out["forestLossPct"]) == (0.25, 0.0, 0.5, -0.25, 25.0)
    raster = api.landcover_change(spark.createDataFrame(rows, "b int, c int, valid boolean, area double"), 8.0, raster_window=8)
    assert (raster["coverageFraction"], raster["analyzedAreaHa"], raster["forestLossHa"]) == (0.5, 4.0, 1.0)


def rgb_tile(spark, pixels):
    return spark.createDataFrame([(0, i, *p) for i, p in enumerate(pixels)], "t int, i int, b0 int, b1 int, b2 int")


@pytest.mark.parametrize(
    ("pixels", "want"),
    [([(0, 0, 0), (1, 0, 0), (4, 0, 0), (34, 0, 0)], [0, 0.4, 1.6, 13.6]), ([(1, 44, 0), (3, 232, 0)], [30.0, 100.0]), ([(0, 9, 0), (5, 0, 0)], [0.0, 5.0]), ([(10, 20, 30)], [0.2126 * 10 + 0.7152 * 20 + 0.0722 * 30])],
)
def test_height_decode(spark, pixels, want):
    if want == [0.0, 5.0]:
        pixels = [(0, 9, 0)] * 40 + [(0, 7, 0)]
        want = [0.0] * 41
    out = tiles.decode_tiles(rgb_tile(spark, pixels), ["t"], "height").orderBy("i").collect()
    assert [r.v for r in out] == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize(
    ("pixels", "want"),
    [([(3, 127, 0), (0, 0, 0), (76, 127, 0), (24, 127, 0)], [3, 0, 76, 24]), ([(3, 0, 0), (76, 0, 0)], [3, 76]), ([(3, 127, 0), (5, 0, 0)], [None, None]), ([(31, 141, 73), (0, 0, 0)], [None, None]), ([(0, 0, 0)], [None])],
)
def test_class_decode(spark, pixels, want):
    out = tiles.decode_tiles(rgb_tile(spark, pixels), ["t"], "class").orderBy("i").collect()
    assert [r["class"] for r in out] == want


def test_validity(spark):
    rows = [(4, 0, 0, 0, 0, None), (4, 0, 0, 0, 9, None), (3, 9, 0, 0, 0, 0), (3, 0, 0, 0, 0, 7), (2, 3, 0, 0, 0, 3), (1, 0, 0, 0, 0, None), (3, 0, 0, 1, 0, None)]
    out = spark.createDataFrame(rows, "n int, b0 int, b1 int, b2 int, b3 int, c int").select(decode.class_valid(*map(F.col, ("n", "b0", "b1", "b2", "b3", "c"))).alias("ok"), decode.value_valid(F.col("n"), F.col("b1"), F.col("b3")).alias("v")).collect()
    assert [r.ok for r in out] == [False, True, False, True, True, False, True]
    assert [r.v for r in out] == [False, True, True, True, False, True, True]


def test_scales_and_nodata(spark):
    row = spark.range(1).select(
        decode.scale_factor([F.lit("x"), F.lit("0"), F.lit("4")]).alias("a"), decode.scale_factor([F.lit(None)]).alias("b"), decode.default_nodata(F.lit(None).cast("double"), F.lit("uint16")).alias("c"), decode.default_nodata(F.lit(1.0), F.lit("uint8")).alias("d"),
        decode.biomass_valid(F.lit(65535.0), F.lit(10.0), F.lit(65535.0)).alias("e"), decode.biomass_valid(F.lit(65535.0), F.lit(10.0), F.lit(65535.0), True).alias("f"), decode.clean_density(F.lit(-1.0)).alias("g"), decode.clean_density(F.lit(float("nan"))).alias("h"),
    ).first()
    assert tuple(row) == (4.0, 10.0, 65535.0, 1.0, False, True, 0.0, 0.0)


def test_masks(spark):
    edges = polygon.edges(relations.shapes(spark))
    counts = {r.id: r.n for r in polygon.scanlines(edges, 12, 12).groupBy("id").agg(F.sum(F.col("c1") - F.col("c0")).alias("n")).collect()}
    assert counts[1] == 29 and counts[2] == 84 and counts[3] == 32
    assert polygon.mask_cells(polygon.scanlines(edges, 12, 12)).count() < 145
    touched = {tuple(r) for r in polygon.all_touched(edges.where("id = 1"), 12, 12).collect()}
    inside = {tuple(r) for r in polygon.mask_cells(polygon.scanlines(edges.where("id = 1"), 12, 12)).collect()}
    assert inside < touched and all(0 <= r < 12 and 0 <= c < 12 for r, c in touched)


def test_areas_of_crossing_rings(spark):
    edges = polygon.edges(relations.shapes(spark))
    exact = {r.id: r.area for r in polygon.slab_areas(edges).collect()}
    assert exact[1] == pytest.approx(26.0 + 3.5 - 1.5 + exact[1] - 28.0) and exact[2] == pytest.approx(84.0) and exact[3] == pytest.approx(32.0)
    assert {r.id: r.area for r in polygon.polygon_areas(edges).collect()}[1] == pytest.approx(exact[1])
    bow = [(1, 0, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 2), (0, 2), (2, 0), (0, 0)])]
    crossing = polygon.crossings(polygon.edges(spark.createDataFrame(bow, "id int, part int, ring int, seq int, x double, y double"))).collect()
    assert [(r.x, r.y) for r in crossing] == [(1.0, 1.0)]


def square(side_km):
    h = side_km * 500
    lon, lat = math.degrees(h / geo.RADIUS), math.degrees(2 * math.atan(math.exp(h / geo.RADIUS)) - math.pi / 2)
    return {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[-lon, -lat], [lon, -lat], [lon, lat], [-lon, lat], [-lon, -lat]]]}}]}


def test_aoi(spark):
    ok = api.aoi(spark, square(20), square=True)
    assert ok.area_ha == pytest.approx(40_000, rel=1e-6)
    for payload, message in [(square(72), "area"), ({"type": "Point", "coordinates": [0, 0]}, "type"), ({"type": "Polygon", "coordinates": [[[0, 0], [181, 0], [181, 1], [0, 0]]]}, "bounds")]:
        with pytest.raises(api.RequestError, match=message):
            api.aoi(spark, payload)
    wide = {"type": "Polygon", "coordinates": [[[0, 0], [0.18, 0], [0.18, 0.09], [0, 0.09], [0, 0]]]}
    with pytest.raises(api.RequestError, match="not square"):
        api.aoi(spark, wide, square=True)
    far = polygon.edges(spark.createDataFrame([(9, 0, 0, i, x, y) for i, (x, y) in enumerate([(50.0, 50.0), (60.0, 50.0), (60.0, 60.0), (50.0, 50.0)])], "id int, part int, ring int, seq int, x double, y double"))
    with pytest.raises(api.RequestError, match="boundary"):
        api.aoi(spark, square(20), boundary=far)


def test_tile_pixels_and_union(spark):
    area = api.aoi(spark, square(20))
    z, n = 10, 512
    grid = spark.range(4 * 256 * 256).select(F.lit(z).alias("z"), (F.floor(F.col("id") / 131072) + n - 1).cast("int").alias("x"), (F.floor(F.col("id") / 65536) % 2 + n - 1).cast("int").alias("y"), (F.floor(F.col("id") / 256) % 256).cast("int").alias("row"), (F.col("id") % 256).cast("int").alias("col"))
    inside = api.tile_pixels(grid, area, z).count()
    size = geo.CIRCUMFERENCE / 1024 / 256
    assert inside == round(20_000 / size / 2) ** 2 * 4 or abs(inside - (20_000 / size) ** 2) < 4 * 20_000 / size


def test_utm_and_quadkeys(spark):
    row = spark.range(1).select(*[c.alias(f"u{i}") for i, c in enumerate(geo.to_utm(F.lit(9.0), F.lit(0.0)))], *[c.alias(f"v{i}") for i, c in enumerate(geo.to_utm(F.lit(12.4924), F.lit(41.8902)))], geo.utm_epsg(F.lit(106.8), F.lit(-6.2)).alias("e"), geo.quadkey(F.lit(3), F.lit(3), F.lit(5)).alias("q")).first()
    assert (row.u0, row.u1) == pytest.approx((500000, 0), abs=1e-3)
    assert (row.v0, row.v1) == pytest.approx((291952, 4640623), abs=60) and row.e == 32748 and row.q == "213"


def test_text(spark):
    row = spark.range(1).select(text.payload_bytes(F.struct(F.lit("é").alias("a"))).alias("a"), text.utc(F.lit("2026-01-02T03:04:05Z")).cast("string").alias("b"), text.utc(F.lit("x")).cast("string").alias("c"), text.range_label(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("d"), text.plain_colour(F.lit(" #AB ")).alias("e")).first()
    assert tuple(row) == (10, "2026-01-02 03:04:05", "1970-01-01 00:00:00", "all", "ab")


def test_covers_extent(spark):
    box = lambda *v: {k: F.lit(float(x)) for k, x in zip(("left", "right", "bottom", "top"), v, strict=True)}
    row = spark.range(1).select(geo.covers_extent(box(0, 1000, 0, 1000), box(0, 1000, 0, 1000), F.lit(10.0), F.lit(10.0)).alias("a"), geo.covers_extent(box(0, 1000, 0, 1000), box(0, 100, 0, 1000), F.lit(10.0), F.lit(10.0)).alias("b")).first()
    assert tuple(row) == (True, False)


def test_legend(spark):
    rows = spark.createDataFrame([("3", "Forest", "#1f8d49"), ("", "", "#000000"), ("5", None, "nope"), (None, "Only", "ffffff")], "class_code string, label string, color string")
    assert [r.label for r in legend.valid_entries(rows).orderBy("label").collect()] == ["Forest", "Only"]
    placed = legend.layout(spark.range(5).withColumnRenamed("id", "o"), ["o"]).collect()
    assert [(r.row, r.col) for r in placed] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)] and placed[0].band_height == 192
    parts = spark.createDataFrame([("b", "B", 1, "polygon", 0), ("b", "B", 1, "point", 1), ("a", "a", 1, "point", 0)], "id string, label string, legend_order int, kind string, part int")
    out = legend.layers(parts).orderBy("ord").collect()
    assert [(r.id, r.kind, r.in_legend) for r in out] == [("a", "point", True), ("b", "polygon", True), ("b", "point", False)]
    styled = legend.styled(spark.sql("select 'polygon' kind, cast(null as string) stroke, '#00ff00' fill, 'x' marker, cast(null as string) marker_outline, cast(null as string) label_color, cast(null as string) label_background, cast(null as double) stroke_width, 3D fill_opacity, cast(null as double) marker_size")).first()
    assert (styled.stroke, styled.stroke_width, styled.fill_opacity, styled.marker_size, styled.problem) == ("#fff200", 2.0, 1.0, 8.0, "colour")


def test_rate_limit_leaves_no_trace_of_rejections(spark):
    hits = [(i, 1, t * 1_000_000, "POST") for i, t in enumerate([0, 10, 20, 30, 60, 61, 71])] + [(99, 1, 5, "GET")]
    out = {r.event_id: r.admitted for r in jobs.rate_limited(spark.createDataFrame(hits, "event_id bigint, ip int, us bigint, method string"), limit=3, window_s=60).collect()}
    assert out == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True}


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 60, 501)
    row = zonal.exact_quantiles(heights(spark, values).withColumn("k", F.lit(1)), ["k"]).first()
    assert [row[f"p{round(100 * q)}"] for q in zonal.QUANTILES] == pytest.approx(np.quantile(values, zonal.QUANTILES).tolist())


def test_histogram_edges_and_quantiles(spark):
    own = heights(spark, [0, 119.9, 120, 120.1, -1]).withColumn("k", F.lit(1))
    assert {r.bin: r.n for r in zonal.histogram(own, ["k"], 0, 120, 4).collect()} == {0: 1, 3: 2}
    rng = np.random.default_rng(2)
    values = rng.uniform(0, 120, 400)
    counts, edges = np.histogram(values, 512, (0, 120))
    row = zonal.histogram_quantiles(zonal.histogram(heights(spark, values).withColumn("k", F.lit(1)), ["k"], 0, 120, 512), ["k"], 0, 120, 512).first()
    for q in zonal.QUANTILES:
        i = int(np.searchsorted(np.cumsum(counts), q * 400))
        before = counts[:i].sum()
        assert row[f"p{round(100 * q)}"] == pytest.approx(edges[i] + (edges[i + 1] - edges[i]) * (q * 400 - before) / counts[i])


def test_alignment_guard(spark):
    a, b = spark.range(5).withColumnRenamed("id", "k"), spark.range(1, 6).withColumnRenamed("id", "k")
    assert sorted(r.k for r in change.misaligned(a, b, ["k"]).collect()) == [0, 5]


def test_retry_tolerance_and_fallback():
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("x")
        return "ok"

    assert api.with_retries(flaky, sleep=pauses.append) == "ok" and len(pauses) == 2 and 0.5 <= pauses[0] <= 0.625 and 1.0 <= pauses[1] <= 1.25
    with pytest.raises(api.RequestError, match="after 5"):
        api.with_retries(lambda: 1 / 0, sleep=pauses.append)
    assert api.tolerate([(1, None), (None, OSError("a"))], all_needed=False) == [1]
    with pytest.raises(api.RequestError):
        api.tolerate([(1, None), (None, OSError("a"))], all_needed=True)

    def exhausted():
        raise MemoryError

    assert api.with_fallback(exhausted, lambda reason: {"reason": reason}) == {"reason": "MemoryError"}


def test_deadline(spark):
    d = api.Deadline(spark, "g", 60)
    d.check()
    with pytest.raises(api.RequestError, match="cancelled"):
        d.check(cancelled=True)
    with pytest.raises(api.RequestError, match="timeout"):
        api.Deadline(spark, "h", -1).check()
    spark.sparkContext._jsc.sc().clearJobGroup()


def test_meetings_and_areas_match_plain_versions(spark):
    import random

    rng = random.Random(3)
    rings = {i: [(rng.randrange(9) + rng.random() * (i % 2), rng.randrange(9) + rng.random() * (i % 2)) for _ in range(rng.randrange(3, 12))] for i in range(40)}
    rings[100] = [(0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4)]  # touches itself in a point
    rows = [(i, 0, 0, k, float(x), float(y)) for i, p in rings.items() for k, (x, y) in enumerate([*p, p[0]])]
    edges = polygon.edges(spark.createDataFrame(rows, "id int, part int, ring int, seq int, x double, y double"))

    def plain(ring):
        """Even-odd area by many thin strips, exact between all vertices' and crossings' heights."""
        e = list(zip(ring, ring[1:] + ring[:1], strict=True))
        ys = {y for _, y in ring}
        for i, ((a, b), (c, d)) in enumerate(e):
            for (p, q), (r, s) in e[:i]:
                den = (c - a) * (s - q) - (d - b) * (r - p)
                if den:
                    t, u = ((p - a) * (s - q) - (q - b) * (r - p)) / den, ((p - a) * (d - b) - (q - b) * (c - a)) / den
                    if 0 < t < 1 and 0 < u < 1:
                        ys.add(b + t * (d - b))
        ys, area = sorted(ys), 0.0
        for lo, hi in zip(ys, ys[1:], strict=False):
            m = (lo + hi) / 2
            xs = sorted(a + (m - b) * (c - a) / (d - b) for (a, b), (c, d) in e if min(b, d) < m < max(b, d))
            area += sum(x2 - x1 for x1, x2 in zip(xs[::2], xs[1::2], strict=True)) * (hi - lo)
        return area

    got = {r.id: r.area for r in polygon.slab_areas(edges).collect()}
    for i, ring in rings.items():
        assert got.get(i, 0.0) == pytest.approx(plain(ring), abs=1e-6), i


def test_large_rings_are_quick(spark):
    import math
    import time

    n = 20_000
    ring = [(1, 0, 0, i, math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    edges = polygon.edges(spark.createDataFrame([*ring, (1, 0, 0, n, *ring[0][4:])], "id int, part int, ring int, seq int, x double, y double"))
    start = time.perf_counter()
    assert polygon.slab_areas(edges).first().area == pytest.approx(math.pi, rel=1e-6)
    assert time.perf_counter() - start < 60


def test_areas_broadcast_no_feature(spark):
    """Tables with rows for each feature grow with the features: the driver's memory held a few of them at 900 000."""
    rings = [(i, 0, 0, k, float(x), float(y)) for i in range(50) for k, (x, y) in enumerate([(0, 0), (i % 5 + 1, 2), (0, 2), (i % 3 + 1, 0), (0, 0)])]
    out = polygon.slab_areas(polygon.edges(spark.createDataFrame(rings, "id int, part int, ring int, seq int, x double, y double")))
    assert out.count() == 50
    out.collect()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_parts_of_any_geometry(spark):
    point, line = {"type": "Point", "coordinates": [7, 8]}, {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}
    square_ = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}
    flat = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [0, 0]]]}
    nested = {"type": "GeometryCollection", "geometries": [line, {"type": "GeometryCollection", "geometries": [{"type": "MultiPoint", "coordinates": [[3, 4], [5, 6]]}, square_]}, point]}
    feature = lambda g: {"type": "Feature", "properties": {"a": 1}, "geometry": g}
    texts = [nested, feature(nested), {"type": "FeatureCollection", "features": [feature(square_), feature(nested), feature(None)]}, point, line, {"type": "GeometryCollection", "geometries": []}, flat]
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(texts)] + [(9, None), (10, "no json")], "id int, json string")
    vertices, points = parts.split(rows, "json")
    assert {r.id: r.n for r in vertices.where("ring = 0 and seq = 0").groupBy("id").agg(F.count("*").alias("n")).collect()} == {0: 1, 1: 1, 2: 2, 6: 1}
    marks = {}
    for r in points.orderBy("id", "ord").collect():
        marks.setdefault(r.id, []).append((r.x, r.y))
    assert marks == {i: [(3, 4), (5, 6), (7, 8)] for i in (0, 1, 2)} | {3: [(7, 8)]}
    first = {r.id: (r.x, r.y, r.problem) for r in parts.overlay_point(points).collect()}
    assert first == {0: (3, 4, None), 1: (3, 4, None), 2: (3, 4, None), 3: (7, 8, None)}
    assert parts.repaired(vertices).count() == vertices.count()
    both = vertices.where("id in (0, 6)").withColumn("id", F.lit(1)).withColumn("part", F.when(F.col("seq").isNull(), 0).otherwise(F.when(F.col("y") >= 0, F.lit(0)))).where("seq < 5")
    assert parts.repaired(vertices.where("id = 6")).count() == 3 and both.count() > 0


def test_area_checks(spark):
    square_ = {"type": "Polygon", "coordinates": [[[0, 0], [0.1, 0], [0.1, 0.1], [0, 0.1], [0, 0]]]}
    with pytest.raises(api.RequestError, match="FeatureCollection"):
        api.aoi(spark, square_, collection=True)
    with pytest.raises(api.RequestError, match="type"):
        api.aoi(spark, {"type": "GeometryCollection", "geometries": [square_, {"type": "Point", "coordinates": [1, 1]}]})
    with pytest.raises(api.RequestError, match="type"):
        api.aoi(spark, {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": square_}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 1]}}]})
    area = api.aoi(spark, {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": square_}]}, collection=True)
    assert api.tile_count(area, 10) >= 1
    with pytest.raises(api.RequestError, match="more than"):
        api.tile_count(area, 16)
    api.same_archives({"tile_type": 2}, {"tile_type": 2})
    with pytest.raises(api.RequestError, match="png"):
        api.same_archives({"tile_type": 2}, {"tile_type": 1})


def test_resource_errors_fall_back(spark, tmp_path):
    from zonalis.sources import frames

    painted = spark.createDataFrame([(1990, 0, 0, 9, 8, 7)], "year int, py int, px int, r int, g int, b int")
    made = frames.render(painted, 4, 4, [])
    late = api.Deadline(spark, "late", -1)
    api.write_frames(made, str(tmp_path), {"fps": 1.0}, late)
    assert (tmp_path / "frames.zip").exists() and not (tmp_path / "frames.tar.gz").exists()
    with pytest.raises(api.ResourceError, match="memory"):
        api.Deadline(spark, "full", 60, most_mb=1.0).check()
    spark.sparkContext._jsc.sc().clearJobGroup()
