"""Supporting queries: catalogue upkeep, plans and constraints, carts, sessions, health, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.session import table

from .behaviour import events
from .registry import query

_E = "e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


@query("""SELECT p_partkey, to_json({'price': p_retailprice > 950, 'size': p_size}) IS NOT NULL AS stored, p_type = 'PROMO' AS cat_promo, p_type = 'ECONOMY' AS cat_economy, list_contains(string_split(p_name, ' '), 'ring') AS pt_ring FROM part""")
def facet_columns(spark, sf_dir):
    """Facets as boolean columns, and the row as JSON beside them."""
    row = F.to_json(F.struct(F.col("p_retailprice").alias("price"), F.col("p_size").alias("size")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", row.isNotNull().alias("stored"), (F.col("p_type") == "PROMO").alias("cat_promo"), (F.col("p_type") == "ECONOMY").alias("cat_economy"), F.array_contains(F.split("p_name", " "), "ring").alias("pt_ring")
    )


@query("""WITH manual AS (SELECT * FROM (VALUES ('acme', 'Brand#2'), ('globex', 'Brand#17'), ('umbrella', 'Brand#99')) t(alias, canonical))
    SELECT canonical, string_agg(alias, ',' ORDER BY alias) AS aliases, bool_or(catalog) AS in_catalog FROM (SELECT DISTINCT lower(p_brand) AS alias, p_brand AS canonical, true AS catalog FROM part UNION ALL SELECT alias, canonical, false FROM manual) GROUP BY 1""")
def brand_catalog(spark, sf_dir):
    """Manual aliases, a literal, merged with the catalogue's brands."""
    manual = spark.createDataFrame([("acme", "Brand#2"), ("globex", "Brand#17"), ("umbrella", "Brand#99")], "alias string, canonical string").withColumn("catalog", F.lit(False))
    own = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("alias"), F.col("p_brand").alias("canonical")).distinct().withColumn("catalog", F.lit(True))
    return own.unionByName(manual).groupBy("canonical").agg(F.array_join(F.array_sort(F.collect_list("alias")), ",").alias("aliases"), F.bool_or("catalog").alias("in_catalog"))


@query("""SELECT p_partkey * 3 + i AS product_id, p_name || ' #' || i AS name, p_retailprice + i AS price FROM part CROSS JOIN range(3) t(i)""")
def catalog_scale(spark, sf_dir):
    """Three copies of each product with derived ids and prices: a row explodes into its own copies."""
    own = table(spark, sf_dir, "part").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return own.select((F.col("p_partkey") * 3 + F.col("i")).alias("product_id"), F.concat("p_name", F.lit(" #"), F.col("i").cast("string")).alias("name"), (F.col("p_retailprice") + F.col("i")).alias("price"))


@query("""SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)""")
def resumable_ingest(spark, sf_dir):
    """What is left to embed, with everything of the first five labels already there."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return rows.join(rows.where("label < 5").select("vec_id"), "vec_id", "left_anti")


@query(f"""WITH {_E}, f AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'must' WHEN 'click' THEN 'should' WHEN 'error' THEN 'must_not' END AS mode, k FROM e WHERE event_type IN ('view', 'click', 'error')),
    d AS (SELECT user_id, k, min(CASE mode WHEN 'must_not' THEN 0 WHEN 'must' THEN 1 ELSE 2 END) AS strongest, count(*) AS n FROM f GROUP BY 1, 2)
    SELECT user_id, count(*) FILTER (strongest = 0) AS must_not, count(*) FILTER (strongest = 1) AS must, count(*) FILTER (strongest = 2) AS should, CAST(sum(n) - count(*) AS BIGINT) AS repeats FROM d GROUP BY 1""")
def constraint_modes(spark, sf_dir):
    """Of several constraints on one value the strongest mode counts."""
    mode = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    own = events(spark, sf_dir).where("event_type IN ('view', 'click', 'error')").groupBy("user_id", "k").agg(F.min(mode).alias("strongest"), F.count(F.lit(1)).alias("n"))
    count = lambda m: F.count(F.when(F.col("strongest") == m, 1))
    return own.groupBy("user_id").agg(count(0).alias("must_not"), count(1).alias("must"), count(2).alias("should"), (F.sum("n") - F.count(F.lit(1))).alias("repeats"))


@query("""WITH c AS (SELECT conv_id, avg(least(length(text), 400)) FILTER (role = 'user') / 400 AS core, avg(least(length(text), 400)) / 400 AS other FROM conversations GROUP BY 1)
    SELECT conv_id, round(coalesce(core, other, 0.55), 6) AS confidence, CASE WHEN coalesce(core, other, 0.55) < 0.5 THEN 'rules' ELSE 'plan' END AS source FROM c""")
def plan_confidence(spark, sf_dir):
    """The mean over core fields, else over all, else a default; below a half the rules' plan is kept."""
    size = F.least(F.length("text"), F.lit(400))
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.avg(F.when(F.col("role") == "user", size)) / 400).alias("core"), (F.avg(size) / 400).alias("other"))
    value = F.coalesce("core", "other", F.lit(0.55))
    return own.select("conv_id", F.round(value, 6).alias("confidence"), F.when(value < 0.5, "rules").otherwise("plan").alias("source"))


@query(f"""WITH {_E}, v AS (SELECT user_id, k, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM e WHERE event_type = 'view')
    SELECT user_id, max(k) FILTER (place = 1) AS first_shown, max(k) FILTER (place = n) AS last_shown, arg_min(k, (value, place)) AS cheapest, max(k) FILTER (place = 2) AS second_shown FROM v GROUP BY 1""")
def reference_resolution(spark, sf_dir):
    """What "the first", "the second", "the last" and "the cheapest" of the shown products are."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = events(spark, sf_dir).where("event_type = 'view'").withColumn("place", F.row_number().over(order))
    at = lambda p: F.max(F.when(F.col("place") == p, F.col("k")))
    return own.groupBy("user_id").agg(
        at(1).alias("first_shown"), F.max_by("k", "place").alias("last_shown"), F.min_by("k", F.struct("value", "place")).alias("cheapest"), at(2).alias("second_shown")
    )


@query("""WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM conversations WHERE role = 'user')
    SELECT conv_id, string_agg(substr(text, 1, 20), ' / ' ORDER BY turn) AS summary, arg_min(substr(text, 1, 12), turn) AS title, count(*) AS turns FROM u WHERE from_end <= 3 GROUP BY 1""")
def history_summary(spark, sf_dir):
    """The last three user turns, cut for a list of sessions."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    own = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("from_end", F.row_number().over(order)).where("from_end <= 3")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 20).alias("t")))), lambda s: s["t"])
    return own.groupBy("conv_id").agg(F.array_join(texts, " / ").alias("summary"), F.min_by(F.substring("text", 1, 12), "turn").alias("title"), F.count(F.lit(1)).alias("turns"))


@query("""WITH p AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT day, count(*) AS users, max(CASE WHEN errors / n > 0.6 THEN 2 WHEN errors > 0 THEN 1 ELSE 0 END) AS worst, CASE max(CASE WHEN errors / n > 0.6 THEN 2 WHEN errors > 0 THEN 1 ELSE 0 END) WHEN 2 THEN 'failing' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS status FROM p GROUP BY 1""")
def health_rollup(spark, sf_dir):
    """The worst component's state is the day's."""
    own = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.count(F.lit(1)).alias("n"))
    code = F.when(F.col("errors") / F.col("n") > 0.6, 2).when(F.col("errors") > 0, 1).otherwise(0)
    worst = own.groupBy("day").agg(F.count(F.lit(1)).alias("users"), F.max(code).alias("worst"))
    return worst.withColumn("status", F.when(F.col("worst") == 2, "failing").when(F.col("worst") == 1, "degraded").otherwise("healthy"))


@query("""WITH c AS (SELECT 'labels' AS name, (SELECT count(*) FROM labels) * 1.0 / (SELECT count(*) FROM documents) AS share UNION ALL SELECT 'quality', (SELECT avg(quality) FROM labels) UNION ALL SELECT 'calm', (SELECT 1 - avg(toxic) FROM labels))
    SELECT name, CAST(round(share, 6) AS DOUBLE) AS share, CASE WHEN share < 0.7 THEN 'error' WHEN share < 0.9 THEN 'warning' ELSE 'ok' END AS severity FROM c""")
def readiness_checks(spark, sf_dir):
    """Shares with severity thresholds."""
    labels = table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("quality"), (1 - F.avg("toxic")).alias("calm"))
    docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("docs"))
    row = labels.crossJoin(docs)  # one row each
    each = row.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("name"), s.alias("share")) for n, s in (("labels", F.col("n") / F.col("docs")), ("quality", F.col("quality")), ("calm", F.col("calm")))]))
    )
    return each.select("name", F.round("share", 6).alias("share"), F.when(F.col("share") < 0.7, "error").when(F.col("share") < 0.9, "warning").otherwise("ok").alias("severity"))


@query("""SELECT p_brand, count(*) AS products, count(DISTINCT p_name) AS names, count(*) = count(DISTINCT p_name) AS unique_names FROM part GROUP BY 1""")
def card_binding_names(spark, sf_dir):
    """Whether a brand's product can be bound by its name alone."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("products"), F.countDistinct("p_name").alias("names")).withColumn("unique_names", F.col("products") == F.col("names"))


@query(f"""WITH {_E} SELECT user_id, arg_max(k, ts) FILTER (event_type = 'click') AS last_compared, arg_max(CAST(floor(value) AS BIGINT), ts) FILTER (event_type = 'purchase') AS last_quantity FROM e GROUP BY 1""")
def trace_last_values(spark, sf_dir):
    last = lambda kind, c: F.max_by(F.when(F.col("event_type") == kind, c), F.when(F.col("event_type") == kind, F.col("ts")))
    return events(spark, sf_dir).groupBy("user_id").agg(last("click", F.col("k")).alias("last_compared"), last("purchase", F.floor("value")).alias("last_quantity"))


@query("""WITH r AS (SELECT event_id, user_id, LEAST(0.5 * POW(2, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1), 30) AS wait FROM events WHERE event_type = 'error') SELECT event_id, user_id, wait FROM r""")
def retry_backoff(spark, sf_dir):
    """Exponential waits up to a bound."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    own = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", nth.alias("nth"))
    return own.select("event_id", "user_id", F.least(0.5 * F.pow(F.lit(2.0), F.col("nth") - 1), F.lit(30.0)).alias("wait"))


@query("""WITH j AS (SELECT o_custkey, l_partkey, max(CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) AS grade FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY grade DESC, l_partkey) AS place FROM j QUALIFY place <= 5) SELECT o_custkey, l_partkey, grade, place FROM r""")
def judged_product_pick(spark, sf_dir):
    """The five best judged products of each query."""
    grade = F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "N", 2).otherwise(1)
    own = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.max(grade).alias("grade"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("grade"), "l_partkey"))
    return own.withColumn("place", place.cast("long")).where("place <= 5")


@query("""WITH c AS (SELECT doc_id, list_filter([CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN contains(text, '|') THEN 'table' END], lambda x: x IS NOT NULL) AS found FROM documents)
    SELECT array_to_string(found, '+') AS labels, count(*) AS n, round(avg(CASE WHEN len(list_intersect(found, ['short', 'table'])) = 0 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM c GROUP BY 1""")
def expectation_checks(spark, sf_dir):
    """Cases by the labels found; a case passes if none of the unexpected ones is there."""
    found = F.array_compact(F.array(F.when(F.length("text") < 200, "short"), F.when(F.col("lang") != "en", "foreign"), F.when(F.contains("text", F.lit("|")), "table")))
    wrong = F.size(F.array_intersect(found, F.array(F.lit("short"), F.lit("table"))))
    return table(spark, sf_dir, "documents").groupBy(F.array_join(found, "+").alias("labels")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(wrong == 0, 1.0).otherwise(0.0)), 6).alias("pass_rate"))


@query("""SELECT s_suppkey, c.n AS sold, round(c.revenue, 2) AS revenue, greatest(least(c.n // 10, 50), 1) AS top_k FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1) c ON l_suppkey = s_suppkey""")
def merchant_totals(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("sold"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum"))
    own = table(spark, sf_dir, "supplier").join(sold, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return own.select("s_suppkey", "sold", F.round("sum", 2).alias("revenue"), F.greatest(F.least(F.floor(F.col("sold") / 10), F.lit(50)), F.lit(1)).cast("long").alias("top_k"))
