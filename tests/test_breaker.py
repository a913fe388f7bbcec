"""Breakers with a timed reset: chunks against one fold, the stream against the batch, and state that goes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import breaker
from vitrine.streaming import read_events, timed_breakers

CALLS = "k long, id long, at timestamp, failed boolean, asks boolean, extra string"


class Breaker:
    """One breaker, call by call, with the times as they are."""

    def __init__(self, threshold, reset):
        self.threshold, self.reset, self.failures, self.opened = threshold, reset, 0, None

    def call(self, at, asks, failed):
        if asks and self.opened is not None:
            if at - self.opened < self.reset:
                return True, False
            self.failures, self.opened = 0, None
        if not failed:
            self.failures, self.opened = 0, None
            return False, False
        self.failures += 1
        if self.failures >= self.threshold:
            self.opened = at
            return False, True
        return False, False


@pytest.mark.parametrize("seed", range(60))
def test_tables_of_chunks_equal_a_fold(seed):
    """Folding the chunks' tables gives the state that folding the calls gives, at every chunk's start."""
    pick = random.Random(seed)
    threshold, reset = pick.choice([(1, 5), (2, 9), (3, 30), (3, 4)])
    calls = sorted((pick.randrange(200), pick.random() < 0.75, pick.random() < 0.6) for _ in range(pick.randrange(1, 90)))
    width = pick.choice([3, 10, 40])
    folded = chained = 0
    for c in sorted({t // width for t, _, _ in calls}):
        assert folded == chained
        own = [x for x in calls if x[0] // width == c]
        at, asks, failed = (np.array(v) for v in zip(*own, strict=True))
        chained = breaker.passed(chained, *breaker.passages(at.astype(np.int64), asks, failed, threshold, reset), reset)
        for t, a, f in own:
            folded, _, _ = breaker.record(folded, t, a, f, threshold, reset)
    assert folded == chained


def test_outcomes_equal_brute_force(spark):
    """One hot key, small ones, null keys and flags, ties in time, calls without a time."""
    pick = random.Random(7)
    rows = [(pick.choice([1, 1, 1, 2, 3, None]), i, pick.randrange(4000), pick.choice([True, True, False, None]), pick.choice([True, True, False, None]), "x") for i in range(3000)]
    frame = spark.createDataFrame(rows + [(1, -1, None, True, True, "x")], CALLS.replace("at timestamp", "at long")).withColumn("at", F.timestamp_seconds("at"))
    want = {}
    for key in (1, 2, 3, None):
        own = Breaker(3, 30)
        for _, i, t, failed, asks, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            want[i] = own.call(t, asks is not False, bool(failed))
    for chunk in (20, 600, 10_000):
        found = breaker.outcomes(frame, "k", "id", F.col("at"), F.col("failed"), F.col("asks"), 3, 30, chunk).collect()
        assert len(found) == 3000 and {r.id: (r.refused, r.opens) for r in found} == want
    assert any(r for r, _ in want.values()) and any(o for _, o in want.values())
    assert breaker.outcomes(frame.limit(0), "k", "id", F.col("at"), F.col("failed")).count() == 0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_stream_equals_batch_and_state_goes(spark, rocks, tmp_path):
    """Files of one day each: every call is answered as in the batch; idle keys lose their state."""
    pick = random.Random(3)
    folder = str(tmp_path / "feed")
    schema = "event_id long, ts long, user_id long, event_type string, value double, props string"
    for day in range(3):
        rows = [(day * 1000 + i, (day + 1) * 86_400 + 5 * i, pick.randrange(4) if day < 2 else 9, "error" if pick.random() < 0.7 else "view", 1.0, "{}") for i in range(150)]
        frame = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))
        frame.coalesce(1).write.mode("append").parquet(folder)
    stream = timed_breakers(read_events(spark, folder, late="1 minute", files=1), reset=30, idle=3600)
    query = stream.writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(150)
    batch = breaker.outcomes(spark.read.parquet(folder), "user_id", "event_id", F.col("ts"), F.col("event_type") == "error")
    got = {r.event_id: (r.refused, r.opens) for r in spark.table("timed").collect()}
    assert len(got) == 450 and got == {r.event_id: (r.refused, r.opens) for r in batch.collect()}
    assert sum(refused for refused, _ in got.values()) > 20
    left = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "state").load(str(tmp_path / "check"))
    assert {r.key[0] for r in left.select("key").collect()} <= {9}
