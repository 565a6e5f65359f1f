"""Job records as JSON files: one file a job, written whole, and a folder of them as a relation."""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: fields of a job record.
SCHEMA = "jobId string, kind string, status string, createdAt string, startedAt string, finishedAt string, progress int, etaSeconds int, message string, cancelRequested boolean, error struct<code:string,message:string>"
#: Bytes that a download hands out at a time.
CHUNK = 1 << 20


class JobFiles:
    """Records of one folder. A reader sees a record as it was or as it is, never a part of it; of writers in
    one process one writes at a time."""

    def __init__(self, folder: str | os.PathLike):
        self.folder, self.lock = Path(folder), threading.Lock()

    def _path(self, job: str) -> Path:
        if not job or any(c in job for c in "/\\\0") or job.startswith("."):
            raise ValueError(f"not a job id: {job!r}")
        return self.folder / f"{job}.json"

    def get(self, job: str) -> dict | None:
        try:
            return json.loads(self._path(job).read_text("utf-8"))
        except FileNotFoundError:
            return None

    def put(self, record: dict) -> None:
        with self.lock:
            self._replace(record)

    def merge(self, job: str, changes: dict) -> dict:
        """The record with the changed fields, which replace whole values; an error if there is none."""
        with self.lock:
            record = self.get(job)
            if record is None:
                raise FileNotFoundError(job)
            record |= changes
            self._replace(record)
        return record

    def _replace(self, record: dict) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        whole = self._path(record["jobId"])
        part = whole.with_name(f".{whole.name}.{os.getpid()}.{threading.get_ident()}")
        try:
            part.write_text(json.dumps(record, ensure_ascii=False), "utf-8")
            part.replace(whole)
        finally:
            part.unlink(missing_ok=True)


def scan(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """The records of all files ``<prefix>*.json`` of a folder, each with its path. A file that is no record has
    nulls; a folder without files gives no rows."""
    rows = spark.read.schema(SCHEMA).option("pathGlobFilter", f"{prefix}*.json").json(folder, multiLine=True)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and modified of the files below a folder of any store that Spark reads; contents are not."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def chunks(path: str, size: int = CHUNK) -> Iterator[bytes]:
    """A file's bytes in order, ``size`` at a time."""
    with open(path, "rb") as f:
        while data := f.read(size):
            yield data
