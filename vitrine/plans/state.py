"""Queries over ordered state: inventories, carts, session filters, breakers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.operators import state
from vitrine.session import table
from vitrine.sources import upserted

from .behaviour import events
from .registry import query

_E = "e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


@query(f"""WITH {_E}, c AS (SELECT *, CASE event_type WHEN 'signup' THEN 3 WHEN 'purchase' THEN -2 ELSE 0 END AS change FROM e),
    s AS (SELECT *, sum(change) OVER w AS total FROM c WINDOW w AS (PARTITION BY k ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, k, CAST(total - least(0, min(total) OVER (PARTITION BY k ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS level FROM s""")
def clamped_inventory(spark, sf_dir):
    """Stock of each product after each event; it never goes below 0."""
    change = F.when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "purchase", -2).otherwise(0)
    rows = events(spark, sf_dir).withColumn("change", change)
    return state.clamped(rows, ["k"], [F.col("ts"), F.col("event_id")], "change").select("event_id", "k", F.col("level").cast("long").alias("level"))


@query(f"""WITH {_E}, w AS (SELECT user_id, k, ts, event_id, CASE WHEN event_type = 'click' THEN CAST(floor(value) AS BIGINT) % 4 END AS set_to, CASE WHEN event_type = 'view' THEN 1 END AS add FROM e WHERE event_type IN ('click', 'view')),
    l AS (SELECT *, max(CASE WHEN set_to IS NOT NULL THEN ts END) OVER (PARTITION BY user_id, k) AS last_set FROM w)
    SELECT user_id, k, CAST(sum(coalesce(set_to, add)) AS BIGINT) AS quantity FROM l WHERE last_set IS NULL OR ts >= last_set GROUP BY 1, 2 HAVING sum(coalesce(set_to, add)) > 0""")
def cart_state(spark, sf_dir):
    """Carts after a log of updates (clicks) and additions (views)."""
    rows = events(spark, sf_dir).where("event_type IN ('click', 'view')").withColumn("set_to", F.when(F.col("event_type") == "click", F.floor("value") % 4)).withColumn("add", F.when(F.col("event_type") == "view", 1).cast("long"))
    return state.last_writes(rows, ["user_id", "k"], [F.col("ts"), F.col("event_id")], "set_to", "add").select("user_id", "k", F.col("quantity").cast("long").alias("quantity"))


@query(f"""WITH {_E}, f AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'min_price' WHEN 'click' THEN 'max_price' WHEN 'purchase' THEN 'brand' WHEN 'signup' THEN 'exclude' END AS kind, CAST(k AS VARCHAR) AS value FROM e WHERE event_type <> 'error'),
    l AS (SELECT user_id, kind, value, min(event_id) AS first FROM f WHERE kind IN ('brand', 'exclude') GROUP BY 1, 2, 3)
    SELECT u.*, b.list AS brand, x.list AS exclude FROM (SELECT user_id, arg_max(value, event_id) FILTER (kind = 'min_price') AS min_price, arg_max(value, event_id) FILTER (kind = 'max_price') AS max_price FROM f GROUP BY 1) u
    LEFT JOIN (SELECT user_id, string_agg(value, ',' ORDER BY first) AS list FROM l WHERE kind = 'brand' GROUP BY 1) b USING (user_id)
    LEFT JOIN (SELECT user_id, string_agg(value, ',' ORDER BY first) AS list FROM l WHERE kind = 'exclude' GROUP BY 1) x USING (user_id)""")
def session_filters(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "min_price").when(F.col("event_type") == "click", "max_price").when(F.col("event_type") == "purchase", "brand").otherwise("exclude")
    rows = events(spark, sf_dir).where("event_type <> 'error'").select("user_id", "event_id", kind.alias("kind"), F.col("k").cast("string").alias("value"))
    return state.merged_filters(rows, "user_id", "kind", "value", "event_id")


@query("""WITH m AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
    s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS streak FROM m WHERE event_type = 'error')
    SELECT user_id, count(*) FILTER (streak = 3) AS opened, CAST(max(streak) AS BIGINT) AS longest FROM s GROUP BY 1""")
def breaker_openings(spark, sf_dir):
    """How often three failures in a row opened each user's breaker."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    failed = F.col("event_type") == "error"
    runs = table(spark, sf_dir, "events").withColumn("run", F.sum(F.when(failed, 0).otherwise(1)).over(order)).where(failed)
    streak = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id"))
    return runs.withColumn("streak", streak).groupBy("user_id").agg(F.count(F.when(F.col("streak") == 3, 1)).alias("opened"), F.max("streak").cast("long").alias("longest"))


@query(f"""WITH {_E} SELECT user_id, k, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, count(*) AS writes FROM e GROUP BY 1, 2""")
def upsert_latest(spark, sf_dir):
    """The last event of each key; counts and the last value come from one aggregate, without a window."""
    return events(spark, sf_dir).groupBy("user_id", "k").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("writes"))


@query("""WITH b AS (SELECT p_partkey, p_name, p_retailprice AS price, 0 AS new FROM part UNION ALL SELECT p_partkey, p_name || ' v2', p_retailprice + 1, 1 FROM part WHERE p_partkey % 3 = 0)
    SELECT p_partkey, arg_max(p_name, new) AS p_name, arg_max(price, new) AS price FROM b GROUP BY 1""")
def store_upsert(spark, sf_dir):
    current = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("price"))
    changes = current.where("p_partkey % 3 = 0").select("p_partkey", F.concat("p_name", F.lit(" v2")).alias("p_name"), (F.col("price") + 1).alias("price"))
    return upserted(current, changes, ["p_partkey"], "price")


@query("""SELECT count(*) AS left_rows, CAST(sum(p_partkey) AS BIGINT) AS checksum FROM part WHERE p_partkey % 7 <> 0""")
def store_delete_count(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    gone = rows.where("p_partkey % 7 = 0").select("p_partkey")
    return rows.join(gone, "p_partkey", "left_anti").agg(F.count(F.lit(1)).alias("left_rows"), F.sum("p_partkey").alias("checksum"))


@query("""WITH r AS (SELECT user_id, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1), x AS (SELECT max(ts) AS now FROM events)
    SELECT user_id, last_seen, n, last_seen > now - INTERVAL '12 hours' AS alive FROM r CROSS JOIN x""")
def session_expiry(spark, sf_dir):
    """Sessions seen within twelve hours of the newest event."""
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    now = F.broadcast(own.agg(F.max("last_seen").alias("now")))  # one row
    return own.crossJoin(now).select("user_id", "last_seen", "n", (F.col("last_seen") > F.col("now") - F.expr("INTERVAL 12 HOURS")).alias("alive"))
