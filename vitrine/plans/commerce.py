"""Commerce queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.functions.text import hash_number, stable_bucket
from vitrine.operators import commerce, orders
from vitrine.operators.filters import first_wins
from vitrine.session import table

from .registry import query

#: Rows that a task sorts, about.
ROWS_OF_A_TASK = 500_000

_PRICES = """prices AS (SELECT l_partkey AS sku, l_shipdate AS day, max(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY 1, 2)"""


def _prices(spark, sf_dir):
    """Unit prices of each product by day; several of a day count as the highest."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("sku"), F.col("l_shipdate").alias("day")).agg(
        F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    )


@query(f"WITH {_PRICES} SELECT sku, arg_max(price, day) AS price, max(day) AS day FROM prices GROUP BY 1")
def asof_latest_price(spark, sf_dir):
    return commerce.latest_as_of(_prices(spark, sf_dir), "sku", "day", "price")


@query(f"""WITH {_PRICES}, changed AS (SELECT *, lag(price) OVER (PARTITION BY sku ORDER BY day) AS before FROM prices QUALIFY before IS NULL OR before <> price)
    SELECT sku, day AS effective_from, lead(day) OVER (PARTITION BY sku ORDER BY day) AS effective_to, price FROM changed""")
def price_scd2(spark, sf_dir):
    return commerce.history(_prices(spark, sf_dir), "sku", "day", "price").select("sku", "effective_from", "effective_to", "price")


@query(f"""WITH {_PRICES} SELECT o_orderkey, l_partkey AS sku, o_orderdate, arg_max(p.price, p.day) AS price, count(*) AS earlier_prices
    FROM (SELECT DISTINCT o_orderkey, o_orderdate, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) o JOIN prices p ON p.sku = l_partkey AND p.day <= o_orderdate GROUP BY 1, 2, 3""")
def order_asof_price(spark, sf_dir):
    """The price of each ordered product as of the order's date.

    Orders and prices are put in one sorted list of each product and the last price is carried
    on, so an order does not meet all prices of its product. Lines are dealt and sorted as they are:
    a day's highest price is the last of its rows, and a row that repeats the one before (a day of prices,
    an order of the product) counts for nothing, so no table of days or of orders is held. A task sorts
    about ``ROWS_OF_A_TASK`` rows, however many there are.
    """
    lines = table(spark, sf_dir, "lineitem")
    count = lines.count()
    tasks = lambda rows: max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_OF_A_TASK)
    asked = lines.select("l_orderkey", "l_partkey").repartition(tasks(count), "l_orderkey")
    dates = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").repartition(tasks(count), "o_orderkey")
    orders = asked.join(dates, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_partkey").alias("sku"), F.col("o_orderdate").alias("day"), "o_orderkey", F.lit(None).cast("double").alias("price"))
    prices = lines.select(F.col("l_partkey").alias("sku"), F.col("l_shipdate").alias("day"), F.lit(None).cast("long").alias("o_orderkey"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    events = orders.unionByName(prices).where("sku IS NOT NULL AND day IS NOT NULL").repartition(tasks(2 * count), "sku")
    # Of one date, prices (without an order) come first, the highest of them last.
    order = Window.partitionBy("sku").orderBy("day", "o_orderkey", "price")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    same = F.lag("day").over(order).eqNullSafe(F.col("day")) & F.lag("o_orderkey").over(order).eqNullSafe(F.col("o_orderkey"))
    own = events.withColumn("new", ~same).withColumn("last", F.last("price", ignorenulls=True).over(before)).withColumn("earlier_prices", F.count_if(F.col("new") & F.col("o_orderkey").isNull()).over(before))
    return own.where("o_orderkey IS NOT NULL AND new AND earlier_prices > 0").select("o_orderkey", "sku", F.col("day").alias("o_orderdate"), F.col("last").alias("price"), "earlier_prices")


@query(f"""WITH {_PRICES}, latest AS (SELECT sku, arg_max(price, day) AS price FROM prices GROUP BY 1), qty AS (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT p_partkey AS sku, 'price' AS field, p_retailprice AS catalog, price AS service FROM part JOIN latest ON sku = p_partkey WHERE floor(p_retailprice * 100 + 0.5) <> floor(price * 100 + 0.5)
    UNION ALL SELECT p_partkey, 'stock', CAST(n AS DOUBLE), CAST(q % 100 AS DOUBLE) FROM part JOIN qty ON l_partkey = p_partkey WHERE n <> q % 100""")
def price_conflicts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    latest = commerce.latest_as_of(_prices(spark, sf_dir), "sku", "day", "price")
    stock = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("sku")).agg((F.sum("l_quantity").cast("long") % 100).alias("q"), F.count(F.lit(1)).alias("n"))
    price = part.join(latest, part["p_partkey"] == latest["sku"]).where(F.floor(F.col("p_retailprice") * 100 + 0.5) != F.floor(F.col("price") * 100 + 0.5)).select(
        "sku", F.lit("price").alias("field"), F.col("p_retailprice").alias("catalog"), F.col("price").alias("service")
    )
    other = part.join(stock, part["p_partkey"] == stock["sku"]).where("n <> q").select("sku", F.lit("stock").alias("field"), F.col("n").cast("double").alias("catalog"), F.col("q").cast("double").alias("service"))
    return price.unionByName(other)


@query("""SELECT p_partkey, CAST('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) % 9 AS bucket,
    p_retailprice * (100 - CAST('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) % 9) / 100 AS price,
    CASE (CAST('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) % 3) WHEN 0 THEN 'next_day' WHEN 1 THEN 'standard' ELSE 'economy' END AS logistics FROM part""")
def hash_price_factor(spark, sf_dir):
    """Prices and policies derived from a stable hash bucket."""
    key = F.col("p_partkey").cast("string")
    kind = stable_bucket(key, 3)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        stable_bucket(key, 9).alias("bucket"),
        (F.col("p_retailprice") * (100 - stable_bucket(key, 9)) / 100).alias("price"),
        F.when(kind == 0, "next_day").when(kind == 1, "standard").otherwise("economy").alias("logistics"),
    )


@query("""SELECT p_partkey, round(10 + (CAST('0x' || substr(md5(p_name || p_partkey), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE) * 990, 2) AS price,
    (CAST('0x' || substr(sha256(p_name), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE) * 100 < 20 AS in_rollout FROM part""")
def synthetic_price(spark, sf_dir):
    ratio = hash_number(F.concat("p_name", F.col("p_partkey").cast("string")), "md5") / F.lit(4294967295.0)
    rollout = hash_number(F.col("p_name")) / F.lit(4294967295.0) * 100 < 20
    return table(spark, sf_dir, "part").select("p_partkey", F.round(10 + ratio * 990, 2).alias("price"), rollout.alias("in_rollout"))


@query("""SELECT o_custkey, CAST(sum(l_quantity) AS BIGINT) AS quantity, round(sum(l_quantity * p_retailprice), 2) AS price, count(*) AS items
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'P' GROUP BY 1""")
def cart_totals(spark, sf_dir):
    """Open orders are the carts."""
    carts = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    own = carts.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return own.groupBy("o_custkey").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.round(F.sum(F.col("l_quantity") * F.col("p_retailprice")), 2).alias("price"), F.count(F.lit(1)).alias("items"))


@query("""SELECT o_orderkey, round(sub, 2) AS subtotal, CASE WHEN sub >= 99 THEN 0.0 ELSE 10.0 END::DOUBLE AS shipping, round(sub + CASE WHEN sub >= 99 THEN 0 ELSE 10 END, 2) AS total
    FROM (SELECT o_orderkey, coalesce(round(sum(l_quantity * (1 + l_tax)), 2), 0) AS sub FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)""")
def order_totals_shipping(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") * (1 + F.col("l_tax"))), 2).alias("sub"))
    own = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("subtotal", F.coalesce("sub", F.lit(0.0)))
    return own.select("o_orderkey", F.round("subtotal", 2).alias("subtotal"), commerce.shipping(F.col("subtotal")).alias("shipping"), F.round(F.col("subtotal") + commerce.shipping(F.col("subtotal")), 2).alias("total"))


#: A literal table of coupon templates: code, type, amount, rate, cap, threshold.
COUPONS = [("A100", 1, 100.0, None, None, 1000.0), ("B9", 2, None, 0.9, 5000.0, 50000.0), ("C95", 2, None, 0.95, None, 0.0), ("D5000", 1, 5000.0, None, None, 300000.0), ("E30", 3, 30.0, None, None, 0.0)]
_COUPON_SQL = "coupon AS (SELECT code, kind, CAST(amount AS DOUBLE) AS amount, CAST(rate AS DOUBLE) AS rate, CAST(cap AS DOUBLE) AS cap, CAST(threshold AS DOUBLE) AS threshold FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in COUPONS
) + """) t(code, kind, amount, rate, cap, threshold)),
    offer AS (SELECT o_orderkey, o_totalprice AS total, code, round(CASE WHEN o_totalprice < threshold THEN 0.0 ELSE least(o_totalprice, CASE WHEN kind = 2 THEN CASE WHEN cap > 0 THEN least(o_totalprice * (1 - rate), cap)
        ELSE o_totalprice * (1 - rate) END ELSE coalesce(amount, 0) END) END, 2) AS discount FROM orders CROSS JOIN coupon)"""


def _offers(spark, sf_dir):
    """Each order with each coupon of the literal table."""
    coupons = spark.createDataFrame(COUPONS, "code string, kind int, amount double, rate double, cap double, threshold double")
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("total")).crossJoin(F.broadcast(coupons))  # five rows
    value = commerce.discount(F.col("total"), F.col("kind"), F.col("amount"), F.col("rate"), F.col("cap"), F.col("threshold"))
    return own.select("o_orderkey", "total", "code", F.round(value, 2).alias("discount"))


@query(f"WITH {_COUPON_SQL} SELECT * FROM offer")
def coupon_discount(spark, sf_dir):
    return _offers(spark, sf_dir)


@query(f"WITH {_COUPON_SQL} SELECT o_orderkey, code, discount, round(total - discount, 2) AS payable FROM offer WHERE discount > 0 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY discount DESC, code) = 1")
def best_coupon(spark, sf_dir):
    """The largest discount above 0; the least code of equals."""
    best = _offers(spark, sf_dir).where("discount > 0").groupBy("o_orderkey").agg(F.min(F.struct((-F.col("discount")).alias("minus"), "code", "discount", "total")).alias("b"))
    return best.select("o_orderkey", "b.code", "b.discount", F.round(F.col("b.total") - F.col("b.discount"), 2).alias("payable"))


@query("""WITH claim AS (SELECT event_id, user_id, ts, json_extract(props, '$.k')::BIGINT % 10 AS template FROM events WHERE event_type = 'click'),
    own AS (SELECT *, row_number() OVER (PARTITION BY template, user_id ORDER BY ts, event_id) AS nth FROM claim QUALIFY nth <= 2)
    SELECT event_id, user_id, template, row_number() OVER (PARTITION BY template ORDER BY ts, event_id) AS place FROM own QUALIFY place <= 100""")
def coupon_claim_limit(spark, sf_dir):
    """Claims within two for each user and a hundred for each template, first come first served."""
    claims = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "user_id", "ts", (F.get_json_object("props", "$.k").cast("long") % 10).alias("template"))
    own = claims.withColumn("nth", F.row_number().over(Window.partitionBy("template", "user_id").orderBy("ts", "event_id"))).where("nth <= 2")
    return own.withColumn("place", F.row_number().over(Window.partitionBy("template").orderBy("ts", "event_id"))).where("place <= 100").select("event_id", "user_id", "template", F.col("place").cast("long").alias("place"))


@query("""SELECT l_partkey AS sku, CAST(1000 - coalesce(sum(l_quantity) FILTER (o_orderstatus IN ('O', 'F')), 0) AS BIGINT) AS available, CAST(coalesce(sum(l_quantity) FILTER (o_orderstatus = 'O'), 0) AS BIGINT) AS reserved,
    CAST(coalesce(sum(l_quantity) FILTER (o_orderstatus = 'F'), 0) AS BIGINT) AS sold FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def inventory_state(spark, sf_dir):
    """Create reserves, pay turns reserved into sold, cancel gives back: signed sums over the orders' states."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") == F.col("l_orderkey"))
    taken = lambda *states: F.coalesce(F.sum(F.when(F.col("o_orderstatus").isin(*states), F.col("l_quantity"))), F.lit(0.0))
    return own.groupBy(F.col("l_partkey").alias("sku")).agg((1000 - taken("O", "F")).cast("long").alias("available"), taken("O").cast("long").alias("reserved"), taken("F").cast("long").alias("sold"))


@query("""WITH req AS (SELECT *, o_custkey || '-' || CAST(o_orderdate AS DATE) AS idem FROM orders)
    SELECT idem, min(o_orderkey) AS order_id, count(*) - 1 AS repeats FROM req GROUP BY 1""")
def idempotent_orders(spark, sf_dir):
    """The first request of each idempotency key makes the order; the others are repeats."""
    idem = F.concat_ws("-", F.col("o_custkey").cast("string"), F.to_date("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").groupBy(idem.alias("idem")).agg(F.min("o_orderkey").alias("order_id"), (F.count(F.lit(1)) - 1).alias("repeats"))


@query("""WITH RECURSIVE q AS (SELECT l_partkey AS sku, sum(l_quantity) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(min(l_shipdate) AS DATE), l_orderkey) AS k FROM lineitem GROUP BY l_partkey, l_orderkey),
    r AS (SELECT sku, 0 AS k, false AS taken, 0.0::DOUBLE AS held FROM (SELECT DISTINCT sku FROM q)
          UNION ALL SELECT q.sku, r.k + 1, held + n <= 300, CASE WHEN held + n <= 300 THEN held + n ELSE held END FROM r JOIN q ON q.sku = r.sku AND q.k = r.k + 1)
    SELECT sku, count(*) FILTER (taken) AS accepted, count(*) FILTER (k > 0 AND NOT taken) AS refused, CAST(max(held) AS BIGINT) AS reserved FROM r GROUP BY 1""")
def stock_reservation(spark, sf_dir):
    """Reservations of an order for a product, by their day: taken while 300 pieces last; a refused one takes nothing."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sku"), F.col("l_orderkey").alias("order_id"), "l_quantity", F.col("l_shipdate").cast("date").alias("at"))
    asked = lines.repartition("sku").groupBy("sku", "order_id").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.min("at").alias("at"))
    own = orders.reserved(asked, 300).groupBy("sku")
    return own.agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"), F.coalesce(F.sum(F.when(F.col("accepted"), F.col("quantity"))), F.lit(0)).alias("reserved"))


@query("""WITH item AS (SELECT o_custkey AS owner, l_partkey AS sku, o_orderstatus AS s, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('P', 'O') GROUP BY 1, 2, 3)
    SELECT owner, sku, CAST(coalesce(a.q, 0) + coalesce(b.q, 0) AS BIGINT) AS quantity, a.q IS NOT NULL AND b.q IS NOT NULL AS merged
    FROM (SELECT * FROM item WHERE s = 'P') a FULL JOIN (SELECT * FROM item WHERE s = 'O') b USING (owner, sku)""")
def cart_merge(spark, sf_dir):
    """An anonymous cart (pending) goes into the user's (open); quantities of the same product add up."""
    item = table(spark, sf_dir, "orders").where("o_orderstatus IN ('P', 'O')").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    # A full join of two sums over the same key is one sum over both.
    return item.groupBy(F.col("o_custkey").alias("owner"), F.col("l_partkey").alias("sku")).agg(F.sum("l_quantity").cast("long").alias("quantity"), (F.countDistinct("o_orderstatus") == 2).alias("merged"))


@query("""WITH carts AS (SELECT o_orderkey, o_totalprice AS total, (floor(o_totalprice / 1000) + 1) * 1000 AS threshold FROM orders WHERE o_orderstatus = 'P'), gaps AS (SELECT o_orderkey, threshold - total AS gap FROM carts),
    fit AS (SELECT o_orderkey, p_partkey, round(1 - abs(p_retailprice - gap) / gap, 6) AS score FROM gaps JOIN part ON p_retailprice BETWEEN gap * 0.5 AND gap * 1.5)
    SELECT o_orderkey, p_partkey, score, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, p_partkey) AS rank FROM fit QUALIFY rank <= 3""")
def threshold_addon(spark, sf_dir):
    """Three products whose price is nearest to what a cart lacks to the next threshold.

    Nearer is better, so of the prices below a gap only the three highest count, and of those
    above the three lowest. They are found by units of price: those of the gap's own unit by an
    equality join, and the three next ones below and above it from a running list over the units,
    of which there are as many as the catalogue's highest price has.
    """
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    gaps = pending.select("o_orderkey", ((F.floor(F.col("o_totalprice") / 1000) + 1) * 1000 - F.col("o_totalprice")).alias("gap")).withColumn("unit", F.floor("gap"))
    first = _first_of_price(spark, sf_dir)
    prices = first.select("price").distinct().withColumn("unit", F.floor("price"))
    edge = Window.partitionBy("unit").orderBy("price")
    back = Window.partitionBy("unit").orderBy(F.desc("price"))
    edges = prices.withColumn("low", F.row_number().over(edge)).withColumn("high", F.row_number().over(back)).groupBy("unit").agg(
        F.sort_array(F.collect_list(F.when(F.col("low") <= 3, F.col("price")))).alias("low"), F.sort_array(F.collect_list(F.when(F.col("high") <= 3, F.col("price"))), asc=False).alias("high")
    )
    units = spark.range(1001).select(F.col("id").alias("unit")).join(edges, "unit", "full")
    before = Window.orderBy("unit").rowsBetween(-1001, -1)  # units of price, not rows of data
    after = Window.orderBy("unit").rowsBetween(1, 1001)
    around = units.select(
        "unit",
        F.concat(
            F.slice(F.sort_array(F.flatten(F.collect_list("high").over(before)), asc=False), 1, 3), F.slice(F.sort_array(F.flatten(F.collect_list("low").over(after))), 1, 3)
        ).alias("others"),
    )
    far = gaps.join(around, "unit").select("o_orderkey", "gap", F.explode("others").alias("price"))
    near = gaps.join(prices, "unit").select("o_orderkey", "gap", "price")
    fit = far.unionByName(near).where(F.col("price").between(F.col("gap") * 0.5, F.col("gap") * 1.5)).join(first, "price")
    score = F.round(1 - F.abs(F.col("price") - F.col("gap")) / F.col("gap"), 6)
    order = Window.partitionBy("o_orderkey").orderBy(F.desc("score"), "p_partkey")
    return fit.select("o_orderkey", "p_partkey", score.alias("score")).withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 3")


def _first_of_price(spark, sf_dir):
    """The three products of least key of each price."""
    place = Window.partitionBy("p_retailprice").orderBy("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").withColumn("place", F.row_number().over(place)).where("place <= 3")
    return rows.select("p_partkey", F.col("p_retailprice").alias("price"))


_CARD = """{n} AS (SELECT row_number() OVER (ORDER BY score DESC, product_id) AS place, product_id, price, score FROM cand WHERE slot = '{n}' QUALIFY place <= 5 UNION ALL SELECT 0, NULL, 0, 0)"""


@query("WITH cand AS (SELECT string_split(p_name, ' ')[-1] AS slot, p_partkey AS product_id, p_retailprice AS price, CAST(p_size AS DOUBLE) AS score FROM part), "
    + ", ".join(_CARD.format(n=n) for n in ("ring", "gear", "bolt", "anvil"))
    + """, c AS (SELECT ring.price + gear.price + bolt.price + anvil.price AS total, ring.product_id AS ring_id, gear.product_id AS gear_id, bolt.product_id AS bolt_id, anvil.product_id AS anvil_id,
        ring.place AS p1, gear.place AS p2, bolt.place AS p3, anvil.place AS p4,
        CASE WHEN ring.place = 0 THEN -2500 ELSE 10000 + ring.score + 10 END + CASE WHEN gear.place = 0 THEN -2500 ELSE 10000 + gear.score + 5 END
        + CASE WHEN bolt.place = 0 THEN 0 ELSE 3500 + bolt.score + 3 END + CASE WHEN anvil.place = 0 THEN 0 ELSE 3500 + anvil.score + 2 END AS base FROM ring, gear, bolt, anvil)
    SELECT round(base + CASE WHEN total / 3000 BETWEEN 0.55 AND 0.98 THEN 60 ELSE 0 END - abs(0.8 - total / 3000) * 20, 6) AS points, total, ring_id, gear_id, bolt_id, anvil_id
    FROM c WHERE total <= 3000 ORDER BY points DESC, p1, p2, p3, p4 LIMIT 1""")
def bundle_optimize(spark, sf_dir):
    """The best bundle of four slots within a budget."""
    part = table(spark, sf_dir, "part")
    candidates = part.select(F.element_at(F.split("p_name", " "), -1).alias("slot"), F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("score"))
    slots = [commerce.Slot("ring", 1.0), commerce.Slot("gear", 0.5), commerce.Slot("bolt", 0.3, True), commerce.Slot("anvil", 0.2, True)]
    return commerce.bundles(candidates, slots, budget=3000.0)


@query("""WITH d AS (SELECT p_brand, p_type, min(p_retailprice) AS low, count(*) AS n, arg_min(p_partkey, (p_retailprice, p_partkey)) AS winner FROM part GROUP BY 1, 2)
    SELECT p_brand, p_type, n, low AS price, winner, low = min(low) OVER (PARTITION BY p_brand) AS best_of_brand FROM d""")
def compare_winner(spark, sf_dir):
    """The cheapest of each dimension, and whether it is the brand's cheapest too."""
    own = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min(F.struct("p_retailprice", "p_partkey")).alias("w"), F.count(F.lit(1)).alias("n"))
    lowest = F.min("w.p_retailprice").over(Window.partitionBy("p_brand"))  # a brand's types
    return own.select("p_brand", "p_type", "n", F.col("w.p_retailprice").alias("price"), F.col("w.p_partkey").alias("winner"), (F.col("w.p_retailprice") == lowest).alias("best_of_brand"))


@query("""SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier""")
def merchant_order(spark, sf_dir):
    order = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.row_number().over(order).cast("long").alias("place"))


@query("""SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def largest_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return first_wins(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
