"""Streams over the event feed. Each one has a batch query that a bounded run must equal."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vitrine.operators.breaker import record
from vitrine.operators.sequence import sketch_bucket

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, late: str = "1 hour", files: int = 100) -> DataFrame:
    """Events of a folder as its files arrive, each id once within the watermark."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)
    own = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.dropDuplicatesWithinWatermark(["event_id"])


def click_rates(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Views, clicks and their rate in each window of event time."""
    count = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    own = events.groupBy(F.window("ts", width).alias("w")).agg(count("view").alias("views"), count("click").alias("clicks"))
    return own.select(F.col("w.start").alias("start"), "views", "clicks", F.round(F.try_divide(F.col("clicks"), F.col("views")), 6).alias("rate"))


def expiring_sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Sessions that end after a gap."""
    own = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return own.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def too_many_requests(events: DataFrame, limit: int, width: str = "60 seconds") -> DataFrame:
    """Windows in which a user made more requests than the limit."""
    own = events.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return own.select("user_id", F.col("w.start").alias("start"), "n")


def request_breakers(events: DataFrame, failures: int = 3, idle_ms: int = 14 * 86_400_000) -> DataFrame:
    """user_id and event of each opening: ``failures`` errors in a row. The run's length is the state of a user.

    Rows of a micro-batch are ordered by time before they are folded; state is a number a user, and goes
    when the watermark is ``idle_ms`` past the user's last event.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        run = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        opened = []
        for event_id, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            run = run + 1 if kind == "error" else 0
            if run == failures:
                opened.append(event_id)
        state.update((run,))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        if opened:
            yield pd.DataFrame({"user_id": [key[0]] * len(opened), "event_id": opened})

    return events.select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandasWithState(
        fold, "user_id long, event_id long", "run long", "append", GroupStateTimeout.EventTimeTimeout
    )


class _TimedBreaker(StatefulProcessor):
    """A key's breaker: its state is a number, which a timer takes away when the key has been idle."""

    def __init__(self, threshold: int, reset: float, idle: float) -> None:
        self.threshold, self.reset, self.idle_ms = threshold, round(reset * 1e6), round(max(idle, reset) * 1e3)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get()[0] if self.state.exists() else 0
        own = pd.concat(list(rows)).sort_values(["at", "event_id"])
        found = []
        for at, event_id, failed in zip(own["at"].tolist(), own["event_id"].tolist(), own["failed"].tolist(), strict=True):
            state, refused, opens = record(state, at, True, failed, self.threshold, self.reset)
            found.append((key[0], event_id, refused, opens))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state:
            self.state.update((state,))
            self.handle.registerTimer(max(int(own["at"].max()) // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        else:
            self.state.clear()
        yield pd.DataFrame(found, columns=["user_id", "event_id", "refused", "opens"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"user_id": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "refused": pd.Series(dtype=bool), "opens": pd.Series(dtype=bool)})

    def close(self) -> None:
        pass


def timed_breakers(events: DataFrame, threshold: int = 3, reset: float = 30.0, idle: float = 86_400.0) -> DataFrame:
    """user_id, event_id, refused, opens of each call, as ``breaker.outcomes`` gives them where all calls ask.

    Errors are failures. Seconds: ``reset`` until a breaker may be asked again, ``idle`` (``reset`` at least) of event time
    after which a key without calls has no state any more. A key without failures has none either.
    It needs the RocksDB state store, as all operators of this kind do.
    """
    own = events.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"), (F.col("event_type") == "error").alias("failed"))
    return own.groupBy("user_id").transformWithStateInPandas(
        _TimedBreaker(threshold, reset, idle), "user_id long, event_id long, refused boolean, opens boolean", "append", "EventTime"
    )


def upsert_stream(events: DataFrame, folder: str, checkpoint: str, key: str = "event_id") -> StreamingQuery:
    """Write each micro-batch once, a folder for each batch id, with the last row of each key.

    A batch that is run again replaces its own folder, so the sink is idempotent.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), "ts").alias("row"))
        last.select(key, "row.*").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserts(spark: SparkSession, folder: str, key: str = "event_id") -> DataFrame:
    """What ``upsert_stream`` has written: of each key the row of the last batch that has it."""
    rows = spark.read.parquet(folder)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "batch").alias("row"))
    return last.select(key, "row.*").drop("batch")


def latency_sketches(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts of values by window, kind and bucket: the state is a number a bucket, and counts of any windows add up to a sketch of both.

    ``sequence.sketch_percentiles`` reads percentiles from them, to within one per cent of their value.
    """
    own = events.groupBy(F.window("ts", width).alias("w"), "event_type", sketch_bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.col("w.start").alias("start"), "event_type", "bucket", "n")
