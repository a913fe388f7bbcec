"""Shopper behaviour queries over the event log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.operators import evaluation
from vitrine.session import table

from .registry import query

_E = "e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


@query(f"""WITH {_E}, q AS (SELECT DISTINCT user_id, k FROM e WHERE event_type = 'view'), c AS (SELECT DISTINCT user_id, k FROM e WHERE event_type = 'click')
    SELECT q.k, count(*) AS queries, count(c.user_id) AS clicked, round(count(c.user_id) / count(*), 6) AS ctr FROM q LEFT JOIN c ON q.user_id = c.user_id AND q.k = c.k GROUP BY 1""")
def query_ctr(spark, sf_dir):
    """Distinct queries with a click over distinct queries: flags of one pass, not a join."""
    own = events(spark, sf_dir).where("event_type IN ('view', 'click')").groupBy("user_id", "k").agg(
        F.max((F.col("event_type") == "view").cast("int")).alias("asked"), F.max((F.col("event_type") == "click").cast("int")).alias("hit")
    )
    return own.where("asked = 1").groupBy("k").agg(F.count(F.lit(1)).alias("queries"), F.sum("hit").alias("clicked"), F.round(F.avg("hit"), 6).alias("ctr"))


@query(f"""WITH {_E} SELECT k, count(*) AS asked, round(avg(value), 6) AS latency, count(DISTINCT user_id) AS sessions FROM e WHERE event_type = 'view' GROUP BY 1 ORDER BY asked DESC, k LIMIT 20""")
def popular_queries(spark, sf_dir):
    own = events(spark, sf_dir).where("event_type = 'view'").groupBy("k").agg(F.count(F.lit(1)).alias("asked"), F.round(F.avg("value"), 6).alias("latency"), F.countDistinct("user_id").alias("sessions"))
    return own.orderBy(F.desc("asked"), "k").limit(20)


@query(f"""WITH {_E} SELECT k % 10 + 1 AS position, count(*) AS clicks, round(avg(value), 6) AS dwell FROM e WHERE event_type = 'click' GROUP BY 1""")
def clicks_by_position(spark, sf_dir):
    return events(spark, sf_dir).where("event_type = 'click'").groupBy((F.col("k") % 10 + 1).alias("position")).agg(F.count(F.lit(1)).alias("clicks"), F.round(F.avg("value"), 6).alias("dwell"))


@query(f"""WITH {_E}, c AS (SELECT event_id, user_id, k, value AS dwell FROM e WHERE event_type = 'click'), b AS (SELECT user_id, k, event_type, count(*) AS n FROM e WHERE event_type IN ('purchase', 'signup') GROUP BY 1, 2, 3)
    SELECT c.event_id, c.user_id, c.k, coalesce(b.event_type, 'none') AS conversion, CASE WHEN b.event_type = 'purchase' THEN 3 WHEN b.event_type = 'signup' THEN 2 WHEN dwell >= 30 THEN 1 ELSE 0 END AS label
    FROM c LEFT JOIN b ON c.user_id = b.user_id AND c.k = b.k""")
def ltr_pairs(spark, sf_dir):
    """A row for each click and kind of conversion, labelled 0 to 3."""
    own = events(spark, sf_dir)
    clicks = own.where("event_type = 'click'").select("event_id", "user_id", "k", F.col("value").alias("dwell"))
    turned = own.where("event_type IN ('purchase', 'signup')").select("user_id", "k", "event_type").distinct()
    label = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).when(F.col("dwell") >= 30, 1).otherwise(0)
    return clicks.join(turned, ["user_id", "k"], "left").select("event_id", "user_id", "k", F.coalesce("event_type", F.lit("none")).alias("conversion"), label.alias("label"))


@query(f"""WITH {_E} SELECT user_id, count(DISTINCT k) AS products, string_agg(DISTINCT CAST(k AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)) AS list FROM e WHERE event_type = 'click' GROUP BY 1""")
def session_products(spark, sf_dir):
    own = events(spark, sf_dir).where("event_type = 'click'").select("user_id", F.col("k").cast("string").alias("k")).distinct()
    return own.groupBy("user_id").agg(F.count(F.lit(1)).alias("products"), F.array_join(F.array_sort(F.collect_list("k")), ",").alias("list"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    """Exact percentiles with linear interpolation, by counts of values."""
    return evaluation.percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


@query("""WITH r AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)
    SELECT count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate, round(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(quantile_cont(value, 0.95), 4) AS p95,
        round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1000000, 6) AS qps FROM r""")
def last_n_metrics(spark, sf_dir):
    """Rates of the last thousand requests."""
    last = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)
    rate = lambda kind: F.round(F.avg(F.when(F.col("event_type") == kind, 1.0).otherwise(0.0)), 6)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return last.agg(
        F.count(F.lit(1)).alias("n"), rate("error").alias("error_rate"), rate("view").alias("hit_rate"), F.round(F.percentile("value", 0.95), 4).alias("p95"),
        F.round(F.count(F.lit(1)) / (micros(F.max("ts")) - micros(F.min("ts"))) * 1000000, 6).alias("qps"),
    )


@query(f"""WITH {_E}, r AS (SELECT event_id, unnest(list_filter([CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN value > 60 THEN 'slow' END, CASE WHEN k < 5 THEN 'rare_product' END, CASE WHEN value < 1 THEN 'empty' END], lambda x: x IS NOT NULL)) AS reason FROM e)
    SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM r GROUP BY 1""")
def reason_histogram(spark, sf_dir):
    """Failure reasons, several of one request, counted in one pass."""
    why = F.array_compact(
        F.array(F.when(F.col("event_type") == "error", "error"), F.when(F.col("value") > 60, "slow"), F.when(F.col("k") < 5, "rare_product"), F.when(F.col("value") < 1, "empty"))
    )
    own = events(spark, sf_dir)
    total = F.broadcast(own.agg(F.count(F.lit(1)).alias("total")))  # one row
    return own.select(F.explode(why).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).crossJoin(total).select("reason", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM conversations QUALIFY from_end <= 4""")
def history_last_n(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").withColumn("from_end", F.row_number().over(order).cast("long")).where("from_end <= 4")


@query("""WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS part, CAST(floor(length(text) * 0.6) AS BIGINT) AS tokens FROM conversations)
    SELECT conv_id, CAST(part AS BIGINT) AS part, count(*) AS turns, CAST(sum(tokens) AS BIGINT) AS tokens, max(part) OVER (PARTITION BY conv_id) - part >= 4 AS compacted FROM t GROUP BY conv_id, part""")
def turn_boundaries(spark, sf_dir):
    """A user message starts a part; all parts but the last four may be compacted."""
    part = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn"))
    own = table(spark, sf_dir, "conversations").select("conv_id", part.alias("part"), F.floor(F.length("text") * 0.6).alias("tokens"))
    parts = own.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("tokens"))
    return parts.withColumn("compacted", F.max("part").over(Window.partitionBy("conv_id")) - F.col("part") >= 4)


@query("""SELECT user_id, time_bucket(INTERVAL '60 seconds', ts) AS window_start, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY 1, 2""")
def rate_limit_windows(spark, sf_dir):
    """Fixed windows of a minute, more than two requests are too many."""
    own = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "60 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return own.select("user_id", F.col("w.start").alias("window_start"), "n", (F.col("n") > 2).alias("limited"))


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nr FROM m)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '2 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, nr""")
def session_windows(spark, sf_dir):
    """Sessions that end after two hours without an event."""
    own = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return own.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


@query(f"""WITH {_E}, b AS (SELECT user_id, k, max(ts) AS seen FROM e WHERE event_type = 'view' GROUP BY 1, 2), l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, k) <= 12)
    SELECT u.user_id, purchases, spent, browsed FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS purchases, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS spent FROM e GROUP BY 1) u
    LEFT JOIN (SELECT user_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY seen DESC, k) AS browsed FROM l GROUP BY 1) USING (user_id)""")
def user_profile(spark, sf_dir):
    """Purchases, and the twelve products seen last."""
    own = events(spark, sf_dir)
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    totals = own.groupBy("user_id").agg(F.count(bought).alias("purchases"), F.round(F.coalesce(F.sum(bought), F.lit(0.0)), 4).alias("spent"))
    seen = own.where("event_type = 'view'").groupBy("user_id", "k").agg(F.max("ts").alias("seen"))
    last = seen.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("seen"), "k"))).where("place <= 12")
    browsed = last.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "k"))), lambda s: s["k"].cast("string")), ",").alias("browsed"))
    return totals.join(browsed, "user_id", "left")


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1""")
def event_type_counts(spark, sf_dir):
    kinds = ["view", "click", "purchase", "error"]
    counts = [F.count(F.when(F.col("event_type") == k, 1)).alias(f"{k}s") for k in kinds]
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*counts)


@query("""SELECT event_id, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS BIGINT) AS latency_cents,
    count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS errors FROM events""")
def running_quality(spark, sf_dir):
    """Running figures over each user's last hundred requests."""
    last = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.sum(F.round(F.col("value") * 100).cast("long")).over(last).alias("latency_cents"), F.count(F.when(F.col("event_type") == "error", 1)).over(last).alias("errors"))


@query(f"""WITH {_E}, t AS (SELECT user_id, ts, event_id, k % 7 AS scope, lag(k % 7) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e WHERE event_type = 'view')
    SELECT CASE WHEN before IS NULL THEN 'start' WHEN before = scope THEN 'keep' ELSE 'switch' END AS transition, count(*) AS n FROM t GROUP BY 1""")
def scope_transitions(spark, sf_dir):
    own = events(spark, sf_dir).where("event_type = 'view'").select("user_id", "ts", "event_id", (F.col("k") % 7).alias("scope"))
    before = F.lag("scope").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.when(F.col("before").isNull(), "start").when(F.col("before") == F.col("scope"), "keep").otherwise("switch")
    return own.withColumn("before", before).groupBy(kind.alias("transition")).agg(F.count(F.lit(1)).alias("n"))
