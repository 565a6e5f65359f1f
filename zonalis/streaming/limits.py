"""Streams of requests and log events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import LIMIT, MAX_QUEUE, MUTATING, WINDOW_S, limit_keys


def rate_limited(requests: DataFrame, limit: int = LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """event_id, ip, us, admitted of a stream of requests (event_id, ip, us, method). The state of an ip
    is its admitted hits within the window, ``limit`` at most."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        out = []
        for ok, left in limit_keys(rows["us"].tolist(), kept, limit, window_s * 1_000_000):
            out.append(ok)
            kept = left
        state.update((kept,))
        yield pd.DataFrame({"event_id": rows["event_id"], "ip": key[0], "us": rows["us"], "admitted": out})

    own = requests.where(F.col("method").isin(*MUTATING))
    return own.groupBy("ip").applyInPandasWithState(decide, "event_id bigint, ip int, us bigint, admitted boolean", "kept array<bigint>", "append", GroupStateTimeout.NoTimeout)


def queue(events: DataFrame, capacity: int = MAX_QUEUE) -> DataFrame:
    """seq, worker, job_id, status of a stream of (seq, worker, job_id, action submit, finish or cancel).

    A worker runs one job; the first of the others is queued, later ones are deferred, and beyond
    ``capacity`` waiting jobs a submission is rejected. A finish runs the next job.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, job, action in zip(rows["seq"], rows["job_id"], rows["action"], strict=True):
            if action == "submit":
                if len(jobs) > capacity:
                    out.append((seq, job, "rejected"))
                    continue
                jobs.append(job)
                out.append((seq, job, ("running", "queued")[len(jobs) - 1] if len(jobs) < 3 else "deferred"))
            elif job in jobs:
                first = jobs[0] == job
                jobs.remove(job)
                out.append((seq, job, "succeeded" if action == "finish" else "cancelled"))
                if first and jobs:
                    out.append((seq, jobs[0], "running"))
                if len(jobs) > 1:
                    out.append((seq, jobs[1], "queued"))
        state.update((jobs,))
        yield pd.DataFrame([(s, key[0], j, x) for s, j, x in out], columns=["seq", "worker", "job_id", "status"])

    return events.groupBy("worker").applyInPandasWithState(step, "seq bigint, worker int, job_id bigint, status string", "jobs array<bigint>", "append", GroupStateTimeout.NoTimeout)


def follow(log: DataFrame, name: str, seconds: float = 0.2):
    """A query that keeps the stream's events in the in-memory table ``name``, every 0.2 s."""
    return log.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime=f"{seconds} seconds").start()


def latest_status(updates: DataFrame) -> DataFrame:
    """The last status of each job of a stream of (job_id, seq, status, progress)."""
    return updates.groupBy("job_id").agg(F.max_by(F.struct("status", "progress"), "seq").alias("u")).select("job_id", "u.status", "u.progress")
