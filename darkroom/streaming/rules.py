"""Rate limits, lockouts, retries and liveness as windowed or keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def late_by(events: DataFrame, time: str, delay: str) -> DataFrame:
    """A watermark, where events are a stream."""
    return events.withWatermark(time, delay) if events.isStreaming else events


def rate_limited(events: DataFrame, key: str, time: str, most: int, window: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """(key, start, requests, refused): fixed windows in which a key asked more than `most` times."""
    by = late_by(events, time, delay).groupBy(F.window(time, window).alias("w"), F.col(key)).agg(F.count("*").alias("requests"))
    return by.where(F.col("requests") > most).select(key, F.col("w.start").alias("start"), "requests", (F.col("requests") - most).alias("refused"))


def lockouts(failures: DataFrame, key: str, time: str, least: int = 5, window: str = "15 minutes", delay: str = "30 minutes") -> DataFrame:
    """(key, start, end, failures): sessions of failures, each within the window of the one before, that reach `least`; end: when the window expires."""
    by = late_by(failures, time, delay).groupBy(F.session_window(time, window).alias("w"), F.col(key)).agg(F.count("*").alias("failures"))
    return by.where(F.col("failures") >= least).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "failures")


def first_of_each(events: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Events whose key was not seen within the delay: idempotent requests."""
    return late_by(events, time, delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def stale_tasks(heartbeats: DataFrame, seconds: int = 600, delay: str = "10 minutes") -> DataFrame:
    """(task_id, status, beat): from a stream of (task_id, status, beat), running tasks without a heartbeat for so many seconds of event time."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            beat, status = state.get
            state.remove()
            if status == "running":
                yield pd.DataFrame({"task_id": [key[0]], "status": ["stale"], "beat": [pd.Timestamp(beat, unit="us")]})
            return
        beat, status = state.get if state.exists else (-1, "")
        for f in frames:
            top = f.loc[f["beat"].idxmax()]
            at = int(top["beat"].value // 1000)
            if at >= beat:
                beat, status = at, top["status"]
        state.update((beat, status))
        if status == "running":
            state.setTimeoutTimestamp(max(beat // 1000 + 1000 * seconds, state.getCurrentWatermarkMs() + 1))

    return heartbeats.withWatermark("beat", delay).groupBy("task_id").applyInPandasWithState(follow, "task_id string, status string, beat timestamp", "beat long, status string", "append", GroupStateTimeout.EventTimeTimeout)


class Tasks:
    """The active tasks of one key: what a request meets, and what ends free. A task without an end is active for `expiry` microseconds."""

    def __init__(self, expiry: int, active: list | None = None) -> None:
        self.expiry, self.active = expiry, active or []  # [task, idempotency key, holds the key, since]

    def take(self, at: int, kind: str, task: str, idempotency: str | None, holds: bool) -> tuple[str, str] | None:
        """(decision, task that is meant) of a request: existing, conflict or created; None for an end."""
        self.active = [a for a in self.active if at - a[3] < self.expiry]
        if kind == "end":
            self.active = [a for a in self.active if a[0] != task]
            return None
        same = next((a for a in self.active if idempotency is not None and a[1] == idempotency), None)
        if same:
            return "existing", same[0]
        held = next((a for a in self.active if a[2]), None)
        if held:
            return "conflict", held[0]
        self.active.append([task, idempotency, holds, at])
        return "created", task


DECIDED = "task_id string, at timestamp, decision string, active string"


def task_requests(events: DataFrame, key: str, expiry_seconds: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """(key, task_id, at, decision, active): what each request meets: the active task of its idempotency key (existing), else one that holds the key (conflict), else it becomes
    active itself (created) until its end or expiry.

    events(key, at, kind, task_id, idempotency, holds): kind is request or end; holds: whether the task keeps others from starting. Events of a key count in order of
    time, ends first, then task_id. A table is sorted by key and time and read through, one key's active tasks in memory. A stream keeps events until the watermark has passed
    them and then decides in the same order, so both decide alike; its state is the key's active tasks and what waits."""
    expiry = expiry_seconds * 1_000_000
    schema = f"{key} {dict(events.dtypes)[key]}, {DECIDED}"
    named = [key, "task_id", "at", "decision", "active"]
    rows = events.select(F.col(key), "at", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), (F.col("kind") != "end").alias("asks"), "task_id", "idempotency", F.coalesce("holds", F.lit(True)).alias("holds"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tasks = None, None
        for b in batches:
            out = []
            for name, k, us, asks, task, idempotency, holds in zip(b["_name"], b[key], b["us"], b["asks"], b["task_id"], b["idempotency"], b["holds"], strict=True):
                if tasks is None or name != now:
                    now, tasks = name, Tasks(expiry)
                if (met := tasks.take(us, "request" if asks else "end", task, idempotency, holds)) is not None:
                    out.append((k, task, pd.Timestamp(us, unit="us"), *met))
            yield pd.DataFrame(out, columns=named)

    def follow(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, active = map(json.loads, state.get) if state.exists else ([], [])
        for f in frames:
            waiting += [[int(us), bool(asks), task, idempotency, bool(holds)] for us, asks, task, idempotency, holds in zip(f["us"], f["asks"], f["task_id"], f["idempotency"], f["holds"], strict=True)]
        passed, tasks, out = state.getCurrentWatermarkMs() * 1000, Tasks(expiry, active), []
        for us, asks, task, idempotency, holds in sorted((w for w in waiting if w[0] <= passed), key=lambda w: w[:3]):
            if (met := tasks.take(us, "request" if asks else "end", task, idempotency, holds)) is not None:
                out.append((*own, task, pd.Timestamp(us, unit="us"), *met))
        waiting = [w for w in waiting if w[0] > passed]
        tasks.active = [a for a in tasks.active if waiting or passed - a[3] < expiry]
        if waiting or tasks.active:
            state.update((json.dumps(waiting), json.dumps(tasks.active)))
            due = min([w[0] for w in waiting] + [a[3] + expiry for a in tasks.active])
            state.setTimeoutTimestamp(max(due // 1000 + 1, passed // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=named)

    if not events.isStreaming:
        each = rows.withColumn("_name", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
        ordered = each.repartition("_name").sortWithinPartitions("_name", "us", "asks", "task_id")
        return ordered.mapInPandas(run, schema)
    return rows.withWatermark("at", delay).groupBy(key).applyInPandasWithState(follow, schema, "waiting string, active string", "append", GroupStateTimeout.EventTimeTimeout)


def dispatched(batch: DataFrame, send, most_attempts: int = 3, backoff_seconds: int = 30) -> DataFrame:
    """For foreachBatch: due rows (id, payload, attempts) with status, attempts and delay after send(payload) -> bool was tried in each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = []
            for payload in b["payload"]:
                try:
                    done.append(bool(send(payload)))
                except Exception:  # whatever a transport raises is a failed attempt
                    done.append(False)
            tries = b["attempts"] + 1
            status = ["sent" if ok else "failed" if n >= most_attempts else "pending" for ok, n in zip(done, tries, strict=True)]
            yield pd.DataFrame({"id": b["id"], "status": status, "attempts": tries, "delay_seconds": [backoff_seconds if s == "pending" else 0 for s in status]})

    return batch.select("id", "payload", "attempts").mapInPandas(run, "id string, status string, attempts int, delay_seconds int")
