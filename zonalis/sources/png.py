"""PNG images and numpy arrays. Grey, grey with alpha, RGB, RGBA and palettes; 8 and 16 bits."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(image: np.ndarray) -> bytes:
    """An array of (height, width) or (height, width, 1 to 4), uint8 or uint16."""
    image = image[:, :, None] if image.ndim == 2 else image
    height, width, n = image.shape
    depth = 16 if image.dtype == np.uint16 else 8
    rows = image.astype(">u2" if depth == 16 else np.uint8).reshape(height, -1)
    raw = np.frombuffer(rows.tobytes(), np.uint8).reshape(height, -1)
    data = np.concatenate([np.zeros((height, 1), np.uint8), raw], axis=1).tobytes()
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(data, 6)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """raw: (height, 1 + bytes a row); step: bytes a pixel."""
    out = np.zeros((raw.shape[0], raw.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for i, line in enumerate(raw):
        kind, row = line[0], line[1:].copy()
        if kind == 1:
            row = np.add.accumulate(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            left, corner = np.zeros(step, np.int32), np.zeros(step, np.int32)
            for j in range(0, len(row), step):
                up = above[j : j + step].astype(np.int32)
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left = (row[j : j + step].astype(np.int32) + guess) & 255
                row[j : j + step] = left
                corner = up
        elif kind:
            raise ValueError(f"unknown PNG filter {kind}")
        out[i] = above = row
    return out


def decode(data: bytes) -> np.ndarray:
    """(height, width) of grey, else (height, width, channels); palettes become RGBA."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, palette, alpha, head = 8, [], b"", b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"tRNS":
            alpha = body
    if head is None:
        raise ValueError("a PNG without a header")
    width, height, depth, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced PNGs are not read")
    n = CHANNELS[colour]
    line = (width * n * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)[: height * (line + 1)].reshape(height, line + 1)
    rows = _unfilter(raw, max(1, n * depth // 8))
    if depth == 16:
        image = np.frombuffer(rows.tobytes(), ">u2").astype(np.uint16).reshape(height, width, n)
    elif depth == 8:
        image = rows.reshape(height, width, n)
    else:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
        image = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :, None]
        if colour == 0:
            image = (image * (255 // (2**depth - 1))).astype(np.uint8)
    if colour == 3:
        table = np.full((256, 4), 255, np.uint8)
        entries = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        table[: len(entries), :3] = entries
        table[: len(alpha), 3] = np.frombuffer(alpha, np.uint8)
        image = table[image[:, :, 0]]
    return image[:, :, 0] if image.shape[2] == 1 else image


def bands(image: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """The number of bands, and four flat bands (those beyond are 0)."""
    image = image[:, :, None] if image.ndim == 2 else image
    flat = image.reshape(-1, image.shape[2]).astype(np.int32)
    return image.shape[2], [flat[:, i] if i < flat.shape[1] else np.zeros(len(flat), np.int32) for i in range(4)]
