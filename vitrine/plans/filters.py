"""Filter and pipeline queries over the product view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import haystack, token_set
from vitrine.operators.filters import (
    SearchSpec,
    brand_filter,
    category_filter,
    compiled,
    exclusion_filter,
    first_wins,
    keyword_filter,
    pushed,
    range_filter,
    rule_bonus,
    step_counts,
    stock_filter,
    type_filter,
    zero_cause,
)
from vitrine.operators.ranking import top_k
from vitrine.session import table

from .registry import query

PRODUCT_SQL = """
    product AS (
        SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS category, p_retailprice AS price, string_split(p_name, ' ') AS tags,
               lower(concat_ws(' ', p_name, p_brand, p_type)) AS hay, coalesce(stock, 0) AS stock
        FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) % 5 AS stock FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)
"""


def products(spark, sf_dir) -> DataFrame:
    """The product view: catalogue columns, tags, haystack and stock."""
    stock = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg((F.sum("l_quantity").cast("long") % 5).alias("stock"))
    return (
        table(spark, sf_dir, "part")
        .join(stock, F.col("p_partkey") == F.col("l_partkey"), "left")
        .select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").alias("price"),
            F.split("p_name", " ").alias("tags"),
            haystack(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("hay"),
            F.coalesce("stock", F.lit(0)).alias("stock"),
        )
    )


def _shown(rows):
    return rows.select("product_id", "name", "price", "stock")


def _sql(where: str) -> str:
    return f"WITH {PRODUCT_SQL} SELECT product_id, name, price, stock FROM product WHERE {where}"


@query(_sql("price BETWEEN 920 AND 950"))
def range_filtered(spark, sf_dir):
    return _shown(products(spark, sf_dir).where(range_filter(SearchSpec(min_price=920, max_price=950))))


@query(_sql("list_has_any(tags, ['ring', 'gear']) AND NOT list_has_any(tags, ['red']) AND category IN ('ECONOMY', 'PROMO')"))
def facet_or_within_and_across(spark, sf_dir):
    spec = SearchSpec(types=("ring", "gear"), not_types=("red",), categories=("ECONOMY", "PROMO"))
    return _shown(products(spark, sf_dir).where(type_filter(spec) & category_filter(spec)))


@query(_sql("stock > 0"))
def in_stock(spark, sf_dir):
    return _shown(products(spark, sf_dir).where(stock_filter(SearchSpec(in_stock=True))))


@query(f"WITH {PRODUCT_SQL} SELECT stock <= 0 AS missing, count(*) AS products, CAST(min(product_id) AS BIGINT) AS first_id FROM product GROUP BY 1")
def unavailable_split(spark, sf_dir):
    """Available and unavailable candidates, split by one predicate."""
    return products(spark, sf_dir).groupBy((F.col("stock") <= 0).alias("missing")).agg(F.count(F.lit(1)).alias("products"), F.min("product_id").alias("first_id"))


@query(_sql("(contains(hay, 'small') OR contains(hay, 'little') OR contains(hay, 'tiny')) AND (contains(hay, 'bolt') OR contains(hay, 'screw'))"))
def keyword_synonym_filter(spark, sf_dir):
    return _shown(products(spark, sf_dir).where(keyword_filter(SearchSpec(keywords=(("small", "little", "tiny"), ("bolt", "screw"))))))


@query(_sql("NOT (contains(hay, 'anvil') OR contains(hay, 'brand#17'))"))
def exclusion_filtered(spark, sf_dir):
    return _shown(products(spark, sf_dir).where(exclusion_filter(SearchSpec(excluded=("anvil", "brand#17")))))


#: A small alias table: alias, canonical brand.
BRAND_ALIASES = [("acme", "Brand#2"), ("acme tools", "Brand#2"), ("brand 2", "Brand#2"), ("globex", "Brand#17"), ("initech", "Brand#4"), ("hooli", "Brand#25")]
_ALIAS_SQL = "alias AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in BRAND_ALIASES) + ") t(alias, canonical))"


@query(f"WITH {PRODUCT_SQL}, {_ALIAS_SQL} SELECT product_id, name, price, stock FROM product WHERE brand IN (SELECT canonical FROM alias WHERE alias IN ('acme tools', 'hooli'))")
def brand_alias_filter(spark, sf_dir):
    """Brands asked for by alias: the alias table, which is a literal, gives the canonical names."""
    wanted = tuple(sorted({b for a, b in BRAND_ALIASES if a in ("acme tools", "hooli")}))
    return _shown(products(spark, sf_dir).where(brand_filter(SearchSpec(brands=wanted))))


SPEC = SearchSpec(min_price=905, max_price=980, types=("ring", "gear", "bolt"), not_types=("red",), categories=("ECONOMY", "PROMO", "SMALL"), excluded=("brand#17",), in_stock=True)
QUERY = "small ring from brand#2"
_SPEC_SQL = """price >= 905 AND price <= 980 AND list_has_any(tags, ['ring', 'gear', 'bolt']) AND NOT list_has_any(tags, ['red'])
    AND category IN ('ECONOMY', 'PROMO', 'SMALL') AND NOT contains(hay, 'brand#17') AND stock > 0"""
_BONUS_SQL = """CASE WHEN list_has_any(tags, ['ring', 'gear', 'bolt']) THEN 20.0 ELSE 0.0 END + CASE WHEN category IN ('ECONOMY', 'PROMO', 'SMALL') THEN 12.0 ELSE 0.0 END
    + CASE WHEN price <= 980 THEN 2.0::DOUBLE + least(greatest(980 - price, 0), 500) / 500 ELSE 0.0::DOUBLE END + CASE WHEN price >= 905 THEN 1.0 ELSE 0.0 END
    + CASE WHEN contains('small ring from brand#2', lower(name)) THEN 8.0 ELSE 0.0 END + CASE WHEN contains('small ring from brand#2', lower(brand)) THEN 4.0 ELSE 0.0 END"""
_RECALL_SQL = f"""{PRODUCT_SQL}, scored AS (
    SELECT *, CAST(len(list_intersect(list_distinct(regexp_extract_all(hay, '[a-z0-9]+')), ['small', 'ring', 'from', 'brand', '2'])) AS DOUBLE) AS score FROM product)"""


def _recall(rows: DataFrame) -> DataFrame:
    asked = token_set(F.lit(QUERY))
    return rows.withColumn("score", F.size(F.array_intersect(token_set(F.col("hay")), asked)).cast("double"))


def _limited(rows: DataFrame, n: int) -> DataFrame:
    return rows.where("score > 0").orderBy(F.desc("score"), "product_id").limit(n)


def _reranked(rows: DataFrame, k: int) -> DataFrame:
    bonus = rule_bonus(SPEC, F.contains(F.lit(QUERY), F.lower("name")), F.contains(F.lit(QUERY), F.lower("brand")))
    scored = rows.withColumn("score", F.round(F.col("score") + bonus, 6)).withColumn("query_id", F.lit(0))
    return top_k(scored, k, item="product_id").select("rank", "product_id", "name", "price", "score")


@query(f"""WITH {_RECALL_SQL}, pool AS (SELECT * FROM scored WHERE score > 0 AND {_SPEC_SQL.replace("AND NOT contains(hay, 'brand#17')", "")} ORDER BY score DESC, product_id LIMIT 50),
    kept AS (SELECT *, round(score + {_BONUS_SQL}, 6) AS total FROM pool WHERE {_SPEC_SQL})
    SELECT row_number() OVER (ORDER BY total DESC, product_id) AS rank, product_id, name, price, total AS score FROM kept QUALIFY rank <= 10""")
def pipeline_topk(spark, sf_dir):
    """Over-fetch with what the store can filter, then all filters, one row a product, rules, the ten best."""
    pool = _limited(_recall(products(spark, sf_dir)).where(pushed(SPEC)), 50)
    kept = first_wins(pool.where(compiled(SPEC)), ["product_id"], [F.desc("score")])
    return _reranked(kept, 10)


@query(f"""WITH {_RECALL_SQL}, pool AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, product_id LIMIT 50)
    SELECT row_number() OVER (ORDER BY round(score + {_BONUS_SQL}, 6) DESC, product_id) AS rank, product_id, name, price, round(score + {_BONUS_SQL}, 6) AS score FROM pool QUALIFY rank <= 20""")
def rule_rerank(spark, sf_dir):
    return _reranked(_limited(_recall(products(spark, sf_dir)), 50), 20)


_STEP_CONDITIONS = ["TRUE", "price >= 905 AND price <= 980", "TRUE", "stock > 0", "NOT contains(hay, 'brand#17')", "list_has_any(tags, ['ring', 'gear', 'bolt']) AND NOT list_has_any(tags, ['red'])", "category IN ('ECONOMY', 'PROMO', 'SMALL')", "TRUE"]
_STEP_NAMES = ["recall", "RangeFilter", "BrandFilter", "StockFilter", "ExclusionFilter", "ProductTypeFilter", "CategoryFilter", "KeywordFilter"]
_STEPS_SQL = f"WITH {_RECALL_SQL}, c AS (SELECT * FROM scored WHERE score > 0) " + " UNION ALL ".join(
    f"SELECT '{n}' AS step, CAST({k} AS BIGINT) AS position, count(*) AS count FROM c WHERE {' AND '.join(_STEP_CONDITIONS[: k + 1])}" for k, n in enumerate(_STEP_NAMES)
)


@query(_STEPS_SQL)
def pipeline_step_counts(spark, sf_dir):
    return step_counts(_recall(products(spark, sf_dir)).where("score > 0"), SPEC)


@query(f"""WITH {_RECALL_SQL}, c AS (SELECT * FROM scored WHERE score > 0)
    SELECT 'RangeFilter' AS step, CAST(1 AS BIGINT) AS position, count(*) AS before FROM c HAVING count(*) > 0 AND count(*) FILTER (price <= 1) = 0""")
def filter_to_zero_cause(spark, sf_dir):
    """Which filter left nothing, for a price no product has."""
    return zero_cause(step_counts(_recall(products(spark, sf_dir)).where("score > 0"), SearchSpec(max_price=1.0, in_stock=True)))


@query(f"""WITH {_RECALL_SQL}, pool AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, product_id LIMIT 20)
    SELECT product_id, name, price, score, true AS relaxed FROM pool""")
def relaxed_retry(spark, sf_dir):
    """A recall that finds nothing with its filters pushed down is repeated without them, in one plan."""
    scored = _recall(products(spark, sf_dir))
    strict = _limited(scored.where(pushed(SearchSpec(categories=("NO SUCH",)))), 20)
    found = strict.agg(F.count(F.lit(1)).alias("n"))
    loose = _limited(scored, 20).crossJoin(F.broadcast(found)).where("n = 0").drop("n")  # one row
    both = strict.withColumn("relaxed", F.lit(False)).unionByName(loose.withColumn("relaxed", F.lit(True)))
    return both.select("product_id", "name", "price", "score", "relaxed")


@query("""SELECT p_name, CAST(min(p_partkey) AS BIGINT) AS product_id, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY 1""")
def first_wins_dedupe(spark, sf_dir):
    rows = first_wins(table(spark, sf_dir, "part"), ["p_name"], [F.asc("p_partkey")])
    return rows.select("p_name", F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"))


@query("""WITH shown AS (SELECT o_custkey AS session, min(o_totalprice) - 1 AS below FROM orders GROUP BY 1)
    SELECT session, round(below, 2) AS below, count(p_partkey) AS cheaper FROM shown LEFT JOIN part ON p_retailprice <= below GROUP BY ALL""")
def contextual_cheaper(spark, sf_dir):
    """Products cheaper than the cheapest a session has seen.

    The catalogue's prices are counted per distinct price, and a running count is looked up as of
    each session's bound, so sessions never meet products one by one.
    """
    from pyspark.sql import Window

    below = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("session")).agg((F.min("o_totalprice") - 1).alias("below"))
    prices = table(spark, sf_dir, "part").groupBy(F.col("p_retailprice").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    events = below.select(F.col("below").alias("at"), F.lit(0).cast("long").alias("n"), "session").unionByName(prices.withColumn("session", F.lit(None).cast("long")))
    # Whole units first, so that the running count needs one ordered group of units and one of rows in each.
    unit = F.floor("at").alias("unit")
    own = events.withColumn("unit", unit)
    units = own.groupBy("unit").agg(F.sum("n").alias("n"))
    before = units.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.sum("n").over(Window.partitionBy("unit").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    return own.withColumn("inside", inside).where("session IS NOT NULL").join(before, "unit").select("session", F.round("at", 2).alias("below"), (F.col("inside") + F.col("before")).cast("long").alias("cheaper"))
