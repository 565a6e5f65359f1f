"""Yearly map frames: drawing, and archives of PNGs."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import png

YEARS = tuple(range(1990, 2025))
#: Colours of the legend band.
BAND_TOP, BAND_BOTTOM, DIVIDER, PANEL, PANEL_EDGE, SWATCH_EDGE = (245, 248, 252), (232, 238, 245), (120, 132, 146), (252, 253, 255), (174, 186, 201), (108, 119, 133)


def fill_polygon(rings: list[np.ndarray], height: int, width: int) -> np.ndarray:
    """Mask of pixels whose centre is inside, by the even-odd rule; rings in pixel coordinates (x, y)."""
    out = np.zeros((height, width), bool)
    centres = np.arange(width) + 0.5
    for row in range(height):
        y, inside = row + 0.5, np.zeros(width, bool)
        for ring in rings:
            x1, y1, x2, y2 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
            cut = (np.minimum(y1, y2) <= y) & (np.maximum(y1, y2) > y)
            for x in x1[cut] + (y - y1[cut]) * (x2[cut] - x1[cut]) / (y2[cut] - y1[cut]):
                inside ^= centres >= x
        out[row] = inside
    return out


def stroke(points: np.ndarray, stroke_width: float, height: int, width: int) -> np.ndarray:
    """Mask of pixels within half the stroke's width of a line."""
    ys, xs = np.mgrid[0:height, 0:width] + 0.5
    out = np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(points[:-1], points[1:], strict=True):
        dx, dy = bx - ax, by - ay
        t = np.clip(((xs - ax) * dx + (ys - ay) * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
        out |= (xs - ax - t * dx) ** 2 + (ys - ay - t * dy) ** 2 <= max(0.5, stroke_width / 2) ** 2
    return out


def disc(x: float, y: float, radius: float, height: int, width: int) -> np.ndarray:
    ys, xs = np.mgrid[0:height, 0:width]
    return (xs - x) ** 2 + (ys - y) ** 2 <= radius * radius


def blend(frame: np.ndarray, mask: np.ndarray, colour: tuple[int, int, int], alpha: float) -> None:
    """Composite a colour over the masked pixels, in place."""
    under = frame[mask].astype(np.float64)
    frame[mask] = np.rint(under + (np.array(colour) - under) * alpha).astype(np.uint8)


def draw_overlays(frame: np.ndarray, layers: list[dict], map_height: int) -> np.ndarray:
    """A copy with the layers (kind polygon or point, rings or x and y in pixels, style). Polygons are
    composed above points, layers in the order of legend_order and id; holes show what is below."""
    out = frame.copy()
    height, width = map_height, frame.shape[1]
    area = out[:height]
    ordered = sorted(layers, key=lambda x: (x.get("legend_order", 0), str(x.get("id", ""))))
    for layer in (x for x in ordered if x["kind"] == "point"):
        if 0 <= layer["x"] < width and 0 <= layer["y"] < height:
            radius = max(3.0, layer.get("marker_size", 8))
            blend(area, disc(layer["x"], layer["y"], radius, height, width), layer.get("outline", (255, 255, 255)), 1.0)
            blend(area, disc(layer["x"], layer["y"], radius - max(1, radius // 3), height, width), layer["color"], 1.0)
    for layer in (x for x in ordered if x["kind"] == "polygon"):
        rings = [np.asarray(r, float) for r in layer["rings"]]
        blend(area, fill_polygon(rings, height, width), layer.get("fill", layer["color"]), float(np.clip(layer.get("fill_opacity", 0.15), 0, 1)))
        blend(area, stroke(rings[0], layer.get("stroke_width", 2), height, width), layer["color"], 1.0)
    return out


def legend_height(entries: int) -> int:
    return max(100, 84 + 36 * -(-entries // (2 if entries >= 2 else 1))) if entries else 90


def draw_legend(width: int, entries: list[tuple[str, tuple[int, int, int]]]) -> np.ndarray:
    """The band under the map: a gradient, a divider, a panel and a swatch for each entry. Text needs a
    font and is not drawn."""
    height = legend_height(len(entries))
    part = (np.arange(height) / max(1, height - 1))[:, None]
    band = np.repeat((np.array(BAND_TOP) * (1 - part) + np.array(BAND_BOTTOM) * part).astype(np.uint8)[:, None, :], width, axis=1)
    band[:2] = DIVIDER
    pad = max(8, width // 96)
    if width - 2 * pad < 40 or height - 16 < 24:
        return band
    band[8 : height - 7, pad : width - pad + 1] = PANEL_EDGE
    band[9 : height - 8, pad + 1 : width - pad] = PANEL
    columns = 2 if len(entries) >= 2 else 1
    column = max(160, (width - 2 * pad - 20 - (columns - 1) * 8) // columns)
    for i, (_, colour) in enumerate(entries):
        y, x = 44 + 36 * (i // columns) + 11, pad + 10 + (i % columns) * (column + 8)
        if x + 15 <= width and y + 15 <= height:
            band[y : y + 15, x : x + 15] = SWATCH_EDGE
            band[y + 1 : y + 14, x + 1 : x + 14] = colour
    return band


def render(pixels: DataFrame, width: int, height: int, entries: list[tuple[str, tuple[int, int, int]]], layers: list[dict] = (), background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """(year, png) from painted pixels (year, py, px, r, g, b): one year is one task's frame."""
    band, layers = draw_legend(width, entries), list(layers)

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        frame = np.full((height, width, 3), background, np.uint8)
        on = rows["py"].notna()
        frame[rows["py"][on].astype(int), rows["px"][on].astype(int)] = rows.loc[on, ["r", "g", "b"]].to_numpy().astype(np.uint8)
        whole = np.concatenate([draw_overlays(frame, layers, height), band])
        return pd.DataFrame({"year": [int(rows["year"].iloc[0])], "png": [png.encode(whole)]})

    return pixels.select("year", "py", "px", "r", "g", "b").groupBy("year").applyInPandas(draw, "year int, png binary")


def manifest(width: int, map_height: int, entries: int, fps: float, seconds: float, years: tuple[int, ...] = YEARS) -> dict:
    return {
        "version": 1, "artifactType": "frames_tar_gz", "width": width, "height": map_height + legend_height(entries), "mapHeight": map_height, "legendHeight": legend_height(entries), "fps": fps,
        "frameDurationSeconds": seconds, "yearStart": years[0], "yearEnd": years[-1], "yearsExpected": len(years), "framesPattern": "frames/frame_{year}.png",
    }


def _ordered(frames: DataFrame) -> Iterator[tuple[int, bytes]]:
    for r in frames.orderBy("year").toLocalIterator():
        yield r.year, bytes(r.png)


def write_tar(frames: DataFrame, path: str, head: dict) -> dict:
    """tar.gz: the manifest, then the frames by year; one frame at a time is held."""
    n = 0
    with tarfile.open(path, "w:gz") as tar:

        def add(name: str, data: bytes) -> None:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))

        add("manifest.json", json.dumps(head, ensure_ascii=False, indent=2).encode())
        for year, data in _ordered(frames):
            add(f"frames/frame_{year}.png", data)
            n += 1
    return {"status": "succeeded", "artifactType": "frames_tar_gz", "contentType": "application/gzip", "yearsRendered": n, "yearsExpected": head["yearsExpected"]}


def write_zip(frames: DataFrame, path: str, reason: str | None = None) -> dict:
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for year, data in _ordered(frames):
            z.writestr(f"frame_{year}.png", data)
            n += 1
    return {"status": "partial_success", "artifactType": "frames_zip", "contentType": "application/zip", "yearsRendered": n, "yearsExpected": len(YEARS), "fallbackReasonCode": reason}


def all_years(painted: DataFrame, years: tuple[int, ...] = YEARS) -> DataFrame:
    """Painted pixels, with a row for each year that has none."""
    known = painted.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, years))).alias("year"))
    return known.join(painted, "year", "left")
