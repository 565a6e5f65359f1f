"""Byte ranges of files and URLs, with caches in memory and on disk."""

from __future__ import annotations

import hashlib
import os
import urllib.request
import uuid
from collections import OrderedDict
from contextlib import suppress
from pathlib import Path


class RangeError(ValueError):
    pass


def fetch(path: str, offset: int, length: int, timeout: float = 60.0) -> bytes:
    """Exactly ``length`` bytes, from a local file or by an HTTP range request; else an error."""
    if path.startswith(("http://", "https://")):
        request = urllib.request.Request(path, headers={"Range": f"bytes={offset}-{offset + length - 1}"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            data = answer.read()
    else:
        with open(path.removeprefix("file://"), "rb") as f:
            f.seek(offset)
            data = f.read(length)
    if len(data) != length:
        raise RangeError(f"{path}: {length} bytes asked for, {len(data)} read")
    return data


class Ranges:
    """Ranges of one source. kept: ranges in memory; folder: of the disk cache (none: no disk cache).

    A file of wrong length is a miss; a failing write is skipped; files appear whole, by renaming.
    events holds (offset, length, source) of every range that was not in memory.
    """

    def __init__(self, path: str, folder: str | None = None, kept: int = 256, get=fetch):
        self.path, self.get, self.most = path, get, kept
        self.kept: OrderedDict[tuple[int, int], bytes] = OrderedDict()
        self.folder = folder and os.path.join(folder, "ranges", hashlib.sha1(path.encode()).hexdigest()[:16])
        self.events: list[tuple[int, int, str]] = []

    def read(self, offset: int, length: int) -> bytes:
        key = offset, length
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        data = self._cached(key)
        self.events.append((offset, length, "network" if data is None else "cache"))
        if data is None:
            data = self.get(self.path, offset, length)
            self._store(key, data)
        self.kept[key] = data
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return data

    def _file(self, key: tuple[int, int]) -> Path | None:
        return self.folder and Path(self.folder, f"{key[0]}_{key[1]}.bin")

    def _cached(self, key: tuple[int, int]) -> bytes | None:
        """A stored range of the right length."""
        file = self._file(key)
        if file is None or not file.is_file() or file.stat().st_size != key[1]:
            return None
        with suppress(OSError):
            return file.read_bytes()

    def _store(self, key: tuple[int, int], data: bytes) -> None:
        """Store a range whole or not at all; a part that could not be renamed is removed."""
        file = self._file(key)
        if file is None:
            return
        part = file.with_suffix(f".{os.getpid()}.{uuid.uuid4().hex}")
        with suppress(OSError):
            try:
                file.parent.mkdir(parents=True, exist_ok=True)
                part.write_bytes(data)
                part.rename(file)
            finally:
                part.unlink(missing_ok=True)


def prewarm(paths: list[str], folder: str, read) -> list[dict]:
    """Runs ``read(ranges)`` for each path and reports its ranges (distinct, sorted) and bytes by source."""
    out = []
    for path in paths:
        ranges, error = Ranges(path, folder), None
        try:
            read(ranges)
        except Exception as e:  # noqa: BLE001  a failing target does not stop the others
            error = str(e)
        by = {s: sum(n for _, n, x in ranges.events if x == s) for s in ("network", "cache")}
        out.append({"path": path, "error": error, "ranges": sorted({(o, n) for o, n, _ in ranges.events}), **by})
    return out
