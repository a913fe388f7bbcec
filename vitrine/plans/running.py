"""Running state along all events: a store of recent sessions, and percentiles of the last thousand."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import breaker, sequence
from vitrine.session import table

from .behaviour import events
from .registry import query

#: Sessions that the store holds, and seconds after which one expires.
SESSIONS, EXPIRES = 8, 6 * 3600
#: Failures in a row that open a product's breaker, and seconds until it may be asked again. The events are some hours apart.
FAILURES, RESET = 2, 12 * 3600


@query(f"""WITH p AS (SELECT event_id, user_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events WHERE user_id IS NOT NULL),
    b AS (SELECT *, lag(place) OVER (PARTITION BY user_id ORDER BY place) AS last_place, lag(ts) OVER (PARTITION BY user_id ORDER BY place) AS last_ts FROM p),
    n AS (SELECT *, lead(place) OVER (PARTITION BY user_id ORDER BY place) AS next_place FROM p),
    d AS (SELECT b.event_id, count(n.place) AS distance FROM b LEFT JOIN n ON n.place > b.last_place AND n.place < b.place AND (n.next_place IS NULL OR n.next_place > b.place) WHERE b.last_place IS NOT NULL GROUP BY 1)
    SELECT event_id, place, CASE WHEN distance < {SESSIONS} THEN distance END AS distance, coalesce(distance < {SESSIONS}, false) AS held,
        CASE WHEN last_place IS NULL THEN 'new' WHEN distance >= {SESSIONS} THEN 'evicted' WHEN epoch_us(ts) - epoch_us(last_ts) > {EXPIRES}::BIGINT * 1000000 THEN 'expired' ELSE 'found' END AS state
    FROM b LEFT JOIN d USING (event_id)""")
def session_store(spark, sf_dir):
    """What a store of the most recently used sessions answers to each event: found, expired, evicted since, or new.

    A session is evicted when as many others as the store holds were used since; it is expired if it is
    still held but too old.
    """
    log = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    own = sequence.least_recently_used(log, "user_id", ["ts", "event_id"], SESSIONS)
    # What the store forgot is told from what never came by the first place of each session.
    first = own.groupBy("user_id").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    before = own.select(F.col("place").alias("last_place"), F.col("ts").alias("last_ts"))
    joined = own.join(first, "place", "left").join(before, "last_place", "left")
    old = F.unix_micros("ts") - F.unix_micros("last_ts") > EXPIRES * 1_000_000
    state = F.when(F.col("first"), "new").when(~F.col("held"), "evicted").when(old, "expired").otherwise("found")
    return joined.select("event_id", "place", "distance", "held", state.alias("state"))


@query("""SELECT event_id, least(row_number() OVER (ORDER BY ts, event_id), 1000) AS n,
        round(quantile_cont(value, 0.5) OVER w, 6) AS p50, round(quantile_cont(value, 0.95) OVER w, 6) AS p95, round(quantile_cont(value, 0.99) OVER w, 6) AS p99
    FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""")
def running_percentiles(spark, sf_dir):
    """Percentiles of the last thousand requests, at each request."""
    log = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    own = sequence.sliding_percentiles(log, "value", ["ts", "event_id"], 1000, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return own.select("event_id", "n", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@query(f"""WITH RECURSIVE e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS t, event_type IN ('error', 'signup') AS failed, user_id % 5 <> 0 AS asks FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS n FROM e),
    r AS (SELECT k, 0::BIGINT AS n, 0::BIGINT AS event_id, false AS refused, false AS opens, 0::BIGINT AS failures, NULL::BIGINT AS opened FROM e GROUP BY 1
        UNION ALL
        SELECT k, n, event_id, refused, NOT refused AND failed AND count + 1 >= {FAILURES}, CASE WHEN refused THEN failures WHEN failed THEN least(count + 1, {FAILURES}) ELSE 0 END,
            CASE WHEN refused THEN opened WHEN failed AND count + 1 >= {FAILURES} THEN t END
        FROM (SELECT n.k, n.n, n.event_id, n.t, n.failed, r.failures, r.opened, coalesce(r.opened IS NOT NULL AND n.asks AND n.t - r.opened < {RESET}::BIGINT * 1000000, false) AS refused,
            CASE WHEN r.opened IS NOT NULL AND n.asks THEN 0 ELSE r.failures END AS count FROM r JOIN n ON n.k = r.k AND n.n = r.n + 1))
    SELECT event_id, k, refused, opens, failures FROM r WHERE n > 0""")
def timed_breaker(spark, sf_dir):
    """What each product's breaker does with each event: refused while it is open, or recorded, and whether that opened it.

    Errors and signups are failures; events of every fifth user were under way already and do not ask.
    """
    failed = F.col("event_type").isin("error", "signup")
    return breaker.outcomes(events(spark, sf_dir), "k", "event_id", F.col("ts"), failed, F.col("user_id") % 5 != 0, FAILURES, RESET, chunk=2 * 86_400)
