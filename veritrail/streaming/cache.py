"""The answer cache and the request limiter as keyed state of a stream.

An answer is kept for its key (a digest of kind, request and policy) with the time it was made and the version of the corpus it was made from.
A request is a hit if its key has an answer that is younger than the time to live and of the request's version; otherwise it is a
miss, and its answer takes the old one's place. Requests of one key are taken in order of time and id, in each micro-batch. When the
watermark passes an answer's end, a timer drops the answer itself; what stays is when and for which version it was made. Keys share rows of
state by a hash, so that messages between Python and the state store don't grow with keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Entry:
    """An answer in the cache: made (ms since the epoch), for which version, by which request."""

    made: int
    version: str
    request: int


def looked_up(entry: Entry | None, at: int, version: str, request: int, ttl: int) -> tuple[Entry, str]:
    """The entry after a request, and why it was answered as it was: "hit", or the reason of a miss: "first", "expired", "version"."""
    if entry is None:
        reason = "first"
    elif at >= entry.made + ttl:
        reason = "expired"
    elif version != entry.version:
        reason = "version"
    else:
        return entry, "hit"
    return Entry(at, version, request), reason


class AnswerCache(StatefulProcessor):
    """The entries of one bucket of keys. Each call on state is a message to the JVM, so a bucket's entries are read once and written once in a
    micro-batch, and one timer stands for the earliest end of its answers."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("entries", "due bigint, entries array<struct<cache_key: string, made: bigint, version: string, request: bigint, held: boolean, answer: string>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        due, entries, answers = self._read()
        asked = sorted(((r["at"], r["request"], r["cache_key"], r["version"], r["answer"]) for r in rows), key=lambda r: r[:2])
        changed = False
        for at, request, cache_key, version, answer in asked:
            entry = entries.get(cache_key)
            now, reason = looked_up(entry, at, version, request, self.ttl)
            if now is not entry:
                entries[cache_key], answers[cache_key], changed = now, answer, True
            yield Row(cache_key=cache_key, request=request, outcome=reason, answered_by=now.request)
        if changed:
            self._write(due, entries, answers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, entries, answers = self._read()
        passed = timerValues.getCurrentWatermarkInMs()
        self._write(None, entries, {k: answer for k, answer in answers.items() if entries[k].made + self.ttl > passed})
        return iter(())

    def close(self) -> None:
        pass

    def _read(self) -> tuple[int | None, dict[str, Entry], dict[str, str]]:
        """When the bucket's timer is due, its entries, and the answers that haven't been dropped."""
        due, kept = self.state.get() or (None, ())
        return due, {k: Entry(*entry) for k, *entry, _, _ in kept}, {k: answer for k, _, _, _, held, answer in kept if held}

    def _write(self, due: int | None, entries: dict[str, Entry], answers: dict[str, str]) -> None:
        first = min((entries[k].made for k in answers), default=None)
        now = None if first is None else first + self.ttl
        self.state.update((now, [(k, e.made, e.version, e.request, k in answers, answers.get(k)) for k, e in entries.items()]))
        if due is not None and due != now:
            self.handle.deleteTimer(due)
        if now is not None and due != now:
            self.handle.registerTimer(now)


#: Buckets of keys that share a row of state: with fewer keys nearly each has its own.
BUCKETS = 16384
RESULT = "cache_key string, request bigint, outcome string, answered_by bigint"


def answered(requests: DataFrame, ttl: str = "24 hours", late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """cache_key, request, outcome (hit, first, expired, version), answered_by (the request whose answer it is) for a stream of
    requests (cache_key, request, ts, version, answer). State is kept by bucket of keys; a checkpoint goes on only with the number of buckets it began with."""
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    bucket = F.pmod(F.xxhash64("cache_key"), F.lit(buckets)).alias("bucket")
    stream = requests.withWatermark("ts", late).select(bucket, "cache_key", F.col("request").cast("long").alias("request"), "ts", F.unix_millis("ts").alias("at"), "version", "answer")
    return stream.groupBy("bucket").transformWithState(AnswerCache(ttl_ms), RESULT, "Append", "EventTime")


def answered_batch(requests: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """The batch twin: the same rows from a table of requests. Requests are dealt and sorted by key, and a task folds its own one after the other."""
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entry = None, None
        for batch in batches:
            told = []
            for k, request, at, version in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    key, entry = k, None
                entry, reason = looked_up(entry, at, version, request, ttl_ms)
                told.append((reason, entry.request))
            reasons, by = map(list, zip(*told)) if told else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(reasons, pa.string()), pa.array(by, pa.int64())], names=["cache_key", "request", "outcome", "answered_by"])

    slim = requests.select("cache_key", F.col("request").cast("long").alias("request"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "version")
    return slim.repartition("cache_key").sortWithinPartitions("cache_key", "at", "request").mapInArrow(fold, RESULT)


class Spacing(StatefulProcessor):
    """The interval between a worker's requests: half as long again after a rejection, 2 % shorter after a success, within bounds."""

    def __init__(self, start: float, least: float, most: float):
        self.start, self.least, self.most = start, least, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("interval", "seconds double, requests bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        from veritrail.streaming.live import RateLimiter

        seconds, n = self.state.get() if self.state.exists() else (self.start, 0)
        limiter, out = RateLimiter(seconds, self.least, self.most), []
        for request, rejected in pd.concat(list(rows)).sort_values("request")[["request", "rejected"]].itertuples(index=False):
            seconds, n = limiter.rejected() if rejected else limiter.accepted(), n + 1
            out.append((key[0], int(request), seconds, n))
        self.state.update((seconds, n))
        yield pd.DataFrame(out, columns=["worker", "request", "seconds", "requests"])

    def close(self) -> None:
        pass


def spaced(requests: DataFrame, start: float = 1.0, least: float = 0.05, most: float = 60.0) -> DataFrame:
    """worker, request, seconds (the interval after it), requests (so far) for a stream of requests (worker, request, rejected)."""
    rows = requests.select("worker", "request", "rejected")
    return rows.groupBy("worker").transformWithStateInPandas(Spacing(start, least, most), "worker bigint, request bigint, seconds double, requests bigint", "Append", "None")


class RunWatch(StatefulProcessor):
    """Changes of a run's status as they come, and "stalled" once nothing has come for `patience` of event time.

    State: the last status, its event, its time and the changes so far. A timer at last time + patience ends a run; a later event opens
    it again, and shows the same gap if both came in one micro-batch. So rows don't depend on how a stream is cut."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event bigint, status string, at bigint, changes bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        event, status, at, changes = self.last.get() if self.last.exists() else (-1, None, 0, 0)
        out = []
        for e, now, t in pd.concat(list(rows)).sort_values("event")[["event", "status", "at"]].itertuples(index=False):
            if e <= event:
                continue
            if status not in (None, "stalled") and t >= at + self.patience:
                changes += 1
                out.append((key[0], event, "stalled", changes))
                status = "stalled"
            if now != status:
                changes += 1
                out.append((key[0], int(e), now, changes))
            event, status, at = int(e), now, max(at, int(t))
        self.last.update((event, status, at, changes))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at + self.patience)
        yield pd.DataFrame(out, columns=["run", "event", "status", "changes"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        event, _, at, changes = self.last.get()
        self.last.update((event, "stalled", at, changes + 1))
        yield pd.DataFrame([(key[0], event, "stalled", changes + 1)], columns=["run", "event", "status", "changes"])

    def close(self) -> None:
        pass


def watched(events: DataFrame, patience: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """run, event, status, changes: a row for each change of a run's status in a stream (run, event, status, ts), and for each run that stalls."""
    stream = events.withWatermark("ts", late).select("run", "event", "status", "ts", F.unix_millis("ts").alias("at"))
    patience_ms = int(pd.Timedelta(patience).total_seconds() * 1000)
    return stream.groupBy("run").transformWithStateInPandas(RunWatch(patience_ms), "run bigint, event bigint, status string, changes bigint", "Append", "EventTime")
