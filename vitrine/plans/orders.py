"""Orders over their life: admission with stock, cancelling, paying, the ledger of products."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import orders
from vitrine.session import table

from .registry import query


def fold_sql(stock: int) -> str:
    """The moves of ``moves`` (o, day, step 0 to take or 1 to give back, items {sku, q}), one after the other: o and taken."""
    return f"""
    skus AS (SELECT sku, row_number() OVER (ORDER BY sku) AS s FROM (SELECT DISTINCT unnest(items).sku AS sku FROM moves)),
    flat AS (SELECT o, day, step, map(list(s), list(q)) AS delta, list(s) AS ss, list(q) AS qs FROM (SELECT o, day, step, unnest(items).sku AS sku, unnest(items).q AS q FROM moves) JOIN skus USING (sku) GROUP BY ALL),
    ev AS (SELECT row_number() OVER (ORDER BY day, o, step) AS pos, dense_rank() OVER (ORDER BY o) - 1 AS n, * FROM flat),
    fold AS (
        SELECT 0::BIGINT AS pos, NULL::BIGINT AS o, 0 AS step, false AS taken, repeat('0', (SELECT count(DISTINCT o)::INT FROM ev))::BIT AS held, list_transform(range((SELECT count(*) FROM skus)), lambda x: 0::INTEGER) AS used
        UNION ALL
        SELECT pos, o, step, taken, CASE WHEN step = 0 AND taken THEN set_bit(held, n::INT, 1) ELSE held END,
               CASE WHEN taken THEN list_transform(used, lambda u, j: u + coalesce(map_extract_value(delta, j), 0)::INTEGER) ELSE used END
        FROM (SELECT ev.pos, ev.o, ev.step, ev.n, ev.delta, f.held, f.used,
                     CASE WHEN ev.step = 1 THEN get_bit(f.held, ev.n::INT) = 1 ELSE list_bool_and(list_transform(list_zip(ss, qs), lambda z: f.used[z[1]] + z[2] <= {stock})) END AS taken
              FROM fold f JOIN ev ON ev.pos = f.pos + 1)
    ), answer AS (SELECT o, taken FROM fold WHERE pos > 0 AND step = 0)"""


#: Stock of each product, and days until a cancelled order is cancelled and a paid one is paid.
STOCK, GONE, PAID = 400, 90, 30
_LINES = """given AS (
        SELECT l_orderkey AS o, l_partkey AS sku, CAST(sum(l_quantity) AS BIGINT) AS q, min(CAST(o_orderdate AS DATE)) AS day,
               min(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) END) AS asked_back,
               min(CASE WHEN o_orderstatus = 'P' OR o_orderkey % 7 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 30 AS INTEGER) END) AS paid_at
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
    line AS (SELECT *, CASE WHEN paid_at IS NULL OR paid_at > asked_back THEN asked_back END AS gone_at FROM given),
    moves AS (
        SELECT o, day, 0 AS step, list({'sku': sku, 'q': q}) AS items FROM line GROUP BY 1, 2
        UNION ALL SELECT o, greatest(gone_at, day), 1, list({'sku': sku, 'q': -q}) FROM line WHERE gone_at IS NOT NULL GROUP BY 1, 2)"""


def _lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    own = o.select(
        F.col("o_orderkey").alias("order_id"),
        day.alias("at"),
        F.when(F.col("o_orderstatus") == "F", F.date_add(day, (F.col("o_orderkey") % GONE).cast("int"))).alias("gone_at"),
        F.when((F.col("o_orderstatus") == "P") | (F.col("o_orderkey") % 7 == 0), F.date_add(day, (F.col("o_custkey") % PAID).cast("int"))).alias("paid_at"),
    )
    # An order that is paid first can no longer be cancelled.
    own = own.withColumn("gone_at", F.when(F.col("paid_at").isNull() | (F.col("paid_at") > F.col("gone_at")), F.col("gone_at")))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku"), F.col("l_quantity").alias("quantity"))
    return lines.join(own, "order_id")


def _stock(lines, available):
    return lines.select("sku").distinct().select("sku", F.lit(available).alias("available"))


@query(f"WITH RECURSIVE {_LINES}, {fold_sql(STOCK)} SELECT o AS order_id, taken AS accepted FROM answer")
def order_admission(spark, sf_dir):
    """Orders by date: taken with all their products or not at all; a refused one takes nothing, a cancelled one gives back."""
    lines = _lines(spark, sf_dir)
    return orders.admitted(lines, _stock(lines, STOCK))


@query(f"""WITH RECURSIVE {_LINES}, {fold_sql(STOCK)},
    moved AS (SELECT sku, q, CASE WHEN gone_at IS NOT NULL THEN 'back' WHEN paid_at IS NOT NULL THEN 'sold' ELSE 'open' END AS state FROM line JOIN answer USING (o) WHERE taken)
    SELECT sku, CAST({STOCK} - coalesce(sum(q) FILTER (state <> 'back'), 0) AS BIGINT) AS available, CAST(coalesce(sum(q) FILTER (state = 'open'), 0) AS BIGINT) AS reserved,
        CAST(coalesce(sum(q) FILTER (state = 'sold'), 0) AS BIGINT) AS sold, CAST(coalesce(sum(q) FILTER (state = 'back'), 0) AS BIGINT) AS given_back
    FROM (SELECT DISTINCT sku FROM line) LEFT JOIN moved USING (sku) GROUP BY 1""")
def stock_ledger(spark, sf_dir):
    """What is left, reserved, sold and given back of each product after all orders were taken or refused, paid or cancelled."""
    lines = _lines(spark, sf_dir)
    stock = _stock(lines, STOCK)
    return orders.ledger(lines, stock, orders.admitted(lines, stock))
