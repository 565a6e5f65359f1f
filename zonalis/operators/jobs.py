"""Job records, queues, admission and request limits as relations of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a job, in the order of reports.
STATUSES = ("deferred", "queued", "running", "succeeded", "partial_success", "failed", "cancelled")
PENDING = ("deferred", "queued", "running")
DONE = ("succeeded", "partial_success", "failed", "cancelled")
MUTATING = ("POST", "PUT", "PATCH", "DELETE")
LIMIT, WINDOW_S, MAX_PENDING, MAX_QUEUE = 30, 60, 6, 4


def status_counts(jobs: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """status, n; states without jobs have 0."""
    known = jobs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, statuses))).alias("status"))
    return known.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def pending(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status").isin(*PENDING)).alias("pending"), F.count_if(F.col("status").isin("queued", "running")).alias("active"))


def admitted(active: Column, most: int = MAX_PENDING) -> Column:
    """HTTP status of a new job: 429 where as many are queued or running."""
    return F.when(active >= most, 429).otherwise(202)


def fifo(jobs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """position in the queue, and queued for the first, deferred for the others."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return jobs.withColumn("position", place).withColumn("status", F.when(F.col("position") == 1, "queued").otherwise("deferred"))


def schedule(jobs: DataFrame, by: list[str], order: list[str], arrive: Column, duration: Column) -> DataFrame:
    """start and finish on one server: finish = max(arrive, finish before) + duration, in closed form."""
    rows = Window.partitionBy(*by).orderBy(*order)
    timed = jobs.withColumn("_a", arrive).withColumn("_d", duration).withColumn("_s", F.sum("_d").over(rows))
    free = F.max(F.col("_a") - (F.col("_s") - F.col("_d"))).over(rows)
    return timed.withColumn("finish", F.col("_s") + free).withColumn("start", F.col("finish") - F.col("_d")).drop("_a", "_d", "_s")


def cancel(status: Column) -> tuple[Column, Column]:
    """State after a cancel request, and whether a running job is flagged."""
    return F.when(status.isin("queued", "deferred"), "cancelled").otherwise(status), status == "running"


def reconcile(status: Column, frames: Column) -> tuple[Column, Column]:
    """State and error after a restart: what ran has failed; waiting frame jobs wait again, others fail."""
    lost = (status == "running") | (~frames & (status == "queued"))
    return F.when(lost, "failed").when(frames & status.isin("queued", "deferred"), "queued").otherwise(status), F.when(lost, "worker_interrupted")


def latest(updates: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """The last update of each key; partial aggregation keeps one row a key and task."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("u"), F.max(seq).alias(seq)).select(key, seq, "u.*")


def merged(updates: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """Shallow merge: the last value of each column that is not null."""
    return updates.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns])


def download_code(status: Column) -> Column:
    return F.when(status.isNull(), 404).when(status.isin("succeeded", "partial_success"), 200).otherwise(409)


def log_tail(log: DataFrame, n: int, capacity: int = 500) -> DataFrame:
    """The last n events of a buffer of ``capacity``, in order; none for n <= 0."""
    return log.orderBy(F.desc("seq")).limit(max(0, min(n, capacity))).orderBy("seq")


def trailing_hits(requests: DataFrame, by: str, us: str, window_s: int) -> DataFrame:
    """Hits of mutating requests in the trailing window, itself included."""
    near = Window.partitionBy(by).orderBy(us).rangeBetween(-window_s * 1_000_000, 0)
    return requests.where(F.col("method").isin(*MUTATING)).withColumn("hits", F.count("*").over(near))


def limit_keys(hits: Iterator[int], kept: list[int], limit: int, window_us: int) -> Iterator[tuple[bool, list[int]]]:
    """For each hit in order: whether it is admitted, and the admitted hits still in the window. A hit is
    evicted when it is older than the window; rejected hits leave no trace."""
    for at in hits:
        while kept and at - kept[0] > window_us:
            kept.pop(0)
        ok = len(kept) < limit
        if ok:
            kept.append(at)
        yield ok, kept


def rate_limited(requests: DataFrame, by: str = "ip", limit: int = LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """event_id, admitted of mutating requests (event_id, by, us, method). The state of a key depends on
    all its earlier decisions, so a key is one sorted group; its state is the admitted hits in the window."""

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["us", "event_id"])
        out = [ok for ok, _ in limit_keys(rows["us"].tolist(), [], limit, window_s * 1_000_000)]
        return pd.DataFrame({"event_id": rows["event_id"], "admitted": out})

    own = requests.where(F.col("method").isin(*MUTATING)).select("event_id", by, "us")
    return own.groupBy(by).applyInPandas(decide, "event_id bigint, admitted boolean")


def distinct_ranges(events: DataFrame) -> DataFrame:
    """url, offset, length, sorted, each once, with its count by source and bytes."""
    return events.groupBy("url", "offset", "length").agg(F.count_if(F.col("source") == "network").alias("network"), F.count_if(F.col("source") == "cache").alias("cached"), F.sum("length").alias("bytes")).orderBy("url", "offset", "length")
