"""Structured Streaming forms of the event log's operators. Each has a batch twin with the same result."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veritrail.streaming.ledger import used_tokens

#: The states of a run in order.
RUN_STATES = ("queued", "analyzing", "retrieving", "judging", "retrying", "finalizing", "complete")


def event_stream(spark: SparkSession, folder: str, pattern: str, files_per_trigger: int = 4) -> DataFrame:
    """Events from files as they arrive; the checkpoint holds the cursor. ts is cast so that it can be watermarked."""
    like = spark.read.option("pathGlobFilter", pattern).parquet(folder)
    stream = spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tail(events: DataFrame, after: int, limit: int = 500) -> DataFrame:
    """One poll of a resumable tail: the next events after a cursor."""
    return events.where(F.col("event_id") > after).orderBy("event_id").limit(limit)


def daily_usage(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tokens used by user and day, emitted when the day is closed by the watermark."""
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.sum(used_tokens()).alias("used"))
    return days.select("user_id", F.col("window.start").cast("date").alias("day"), "used")


def first_uploads(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each content once within the watermark: a cache of a time to live, without a table to expire."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: sessions of a user by inactivity."""
    made = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return made.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


class RunState(StatefulProcessor):
    """The latest status of each run and how many changes led to it, by event id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "event_id bigint, status string, changes bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, status, changes = self.state.get() if self.state.exists() else (-1, None, 0)
        for frame in rows:
            for event, now in sorted(zip(frame["event_id"], frame["event_type"])):
                if event > last:
                    changes += status is not None and now != status
                    last, status = int(event), now
        self.state.update((last, status, changes))
        yield pd.DataFrame({"user_id": [key[0]], "event_id": [last], "status": [status], "changes": [changes]})

    def close(self) -> None:
        pass


def run_states(stream: DataFrame) -> DataFrame:
    """user_id, event_id, status, changes after each batch, by transformWithState; state is kept by run, in RocksDB."""
    return stream.select("user_id", "event_id", "event_type").groupBy("user_id").transformWithStateInPandas(
        RunState(), "user_id bigint, event_id bigint, status string, changes bigint", "Update", "None"
    )


def latest_status(events: DataFrame) -> DataFrame:
    """The batch twin of run_states' last rows."""
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("event_id"))


def compacted_chats(turns: DataFrame, keep: int = 200) -> DataFrame:
    """conv_id, summary, last: each history replaced by a summary pair (its first `keep` characters; a model may stand in)."""
    made = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    said = F.array_join(F.transform("t", lambda t: F.concat_ws(": ", t["role"], t["text"])), "\n")
    return made.select("conv_id", F.substring(said, 1, keep).alias("summary"), F.element_at("t", -1)["text"].alias("last"), F.size("t").alias("n"))


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which keyed state with timers needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there and stops; the result is in path."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()


def each_batch(stream: DataFrame, use, checkpoint: str, key: str, order: str) -> None:
    """Calls use(latest row of each key) for each micro-batch: a status feed. Runs over what is there and stops."""
    from veritrail.operators.relational import latest

    def run(batch: DataFrame, _: int) -> None:
        use(latest(batch, [key], [F.desc(order)]))

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def cancelled(spark: SparkSession, names) -> list[str]:
    """Stops the running streams of these names; returns those stopped. A stream ends between micro-batches."""
    stopped = []
    for query in spark.streams.active:
        if query.name in set(names):
            query.stop()
            stopped.append(query.name)
    return stopped


class RateLimiter:
    """Spacing of requests that grows by half after a rejection and shrinks by 2 % after a success."""

    def __init__(self, interval: float, least: float = 0.05, most: float = 60.0):
        self.interval, self.least, self.most = interval, least, most

    def rejected(self) -> float:
        self.interval = min(self.most, self.interval * 1.5)
        return self.interval

    def accepted(self) -> float:
        self.interval = max(self.least, self.interval * 0.98)
        return self.interval
