"""A bounded run of each stream equals its batch query."""

from pyspark.sql import functions as F

from vitrine.plans import QUERIES
from vitrine.session import table
from vitrine.streaming import click_rates, expiring_sessions, latency_sketches, read_events, read_upserts, request_breakers, too_many_requests, upsert_stream


def finished(spark, stream, mode, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def feed(spark, sf, tmp_path):
    folder = str(tmp_path / "feed")
    # Rows twice: ids are taken once.
    rows = table(spark, sf, "events")
    rows.unionByName(rows).repartition(1).write.parquet(folder)
    return read_events(spark, folder, late="60 days")


def test_rates(spark, sf, tmp_path):
    own = finished(spark, click_rates(feed(spark, sf, tmp_path)), "complete", tmp_path, "rates")
    batch = click_rates(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(own.collect()) == sorted(batch.collect()) and own.count() > 20


def test_limits(spark, sf, tmp_path):
    own = finished(spark, too_many_requests(feed(spark, sf, tmp_path), 1), "complete", tmp_path, "limits")
    batch = too_many_requests(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), 1)
    assert sorted(own.collect()) == sorted(batch.collect())


def test_sessions(spark, sf, tmp_path):
    own = finished(spark, expiring_sessions(feed(spark, sf, tmp_path)), "complete", tmp_path, "sessions")
    batch = QUERIES["session_windows"](spark, sf)
    assert own.groupBy("user_id").agg(F.count("n"), F.sum("n")).exceptAll(batch.groupBy("user_id").agg(F.count("n"), F.sum("n"))).isEmpty()


def test_breakers(spark, sf, tmp_path):
    own = finished(spark, request_breakers(feed(spark, sf, tmp_path)), "append", tmp_path, "breakers")
    got = {r.user_id: r.n for r in own.groupBy("user_id").agg(F.count("event_id").alias("n")).collect()}
    assert got == {r.user_id: r.opened for r in QUERIES["breaker_openings"](spark, sf).where("opened > 0").collect()}


def test_upsert(spark, sf, tmp_path):
    query = upsert_stream(feed(spark, sf, tmp_path), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("event_id").distinct().count() == table(spark, sf, "events").count()


def test_upsert_keeps_the_last_of_a_key(spark, tmp_path):
    """A key that comes again in a later batch has that batch's row."""
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    for day, value in ((1, 5.0), (2, 6.0)):
        rows = [(k, f"2024-01-0{day} 00:00:00", 1, "view", value + k, "{}") for k in (1, 1 + day)]
        frame = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
        frame.write.mode("append").parquet(folder)
        upsert_stream(spark.readStream.schema(schema).parquet(folder), out, check).awaitTermination(120)
    got = {r.event_id: r.value for r in read_upserts(spark, out).collect()}
    assert got == {1: 7.0, 2: 7.0, 3: 9.0}


def test_sketches(spark, sf, tmp_path):
    """Sketches of a stream's windows merge to percentiles within one per cent of the exact ones."""
    from vitrine.operators.sequence import SKETCH_ERROR, sketch_percentiles

    own = finished(spark, latency_sketches(feed(spark, sf, tmp_path)), "complete", tmp_path, "sketches")
    events = table(spark, sf, "events")
    assert own.agg(F.sum("n")).first()[0] == events.count()
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r.event_type: r for r in sketch_percentiles(own, ["event_type"], points).collect()}
    values = {}
    for r in events.select("event_type", "value").collect():
        values.setdefault(r.event_type, []).append(r.value)
    assert set(got) == set(values)
    for kind, own in values.items():
        own.sort()
        assert got[kind].n == len(own)
        for name, p in points.items():
            exact = own[int(p * (len(own) - 1))]
            assert abs(got[kind][name] - exact) <= SKETCH_ERROR * exact + 1e-9, (kind, name)
