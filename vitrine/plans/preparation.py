"""Queries that prepare training and evaluation data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.session import table

from .registry import query


@query("""SELECT o_custkey AS query_id, count(DISTINCT l_partkey) AS judged, count(DISTINCT l_partkey) FILTER (l_returnflag = 'A') AS positives
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING bool_or(l_returnflag = 'A')""")
def query_group_positives(spark, sf_dir):
    """Judgements of each query, where at least one is positive."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = own.groupBy(F.col("o_custkey").alias("query_id"), "l_partkey").agg(F.max((F.col("l_returnflag") == "A").cast("int")).alias("positive"))
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("judged"), F.sum("positive").alias("positives")).where("positives > 0")


@query("""WITH pairs AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey), held AS (SELECT * FROM pairs WHERE CAST('0x' || substr(md5(o_custkey || '-' || l_partkey), 1, 8) AS BIGINT) % 10 = 0)
    SELECT o_custkey, l_partkey FROM pairs ANTI JOIN held USING (o_custkey, l_partkey)""")
def leakage_anti_join(spark, sf_dir):
    """Training pairs without those held out for evaluation."""
    pairs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()
    bucket = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("l_partkey").cast("string"))), 1, 8), 16, 10).cast("long") % 10
    held = pairs.where(bucket == 0)
    return pairs.join(held, ["o_custkey", "l_partkey"], "left_anti")


@query("""SELECT lower(p_name) AS name, lower(p_brand) AS brand, min(p_partkey) AS product_id, count(*) AS repeats FROM part GROUP BY 1, 2""")
def pair_dedupe(spark, sf_dir):
    """Pairs that differ in case only are one; the first stays."""
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name"), F.lower("p_brand").alias("brand")).agg(F.min("p_partkey").alias("product_id"), F.count(F.lit(1)).alias("repeats"))


@query("""SELECT p_partkey, option, p_partkey || '-' || option AS sku_id, round(p_retailprice + i, 2) AS price FROM (SELECT p_partkey, p_retailprice, unnest(string_split(p_name, ' ')) AS option, unnest(range(2)) AS i FROM part)""")
def sku_explode(spark, sf_dir):
    """A row for each option value of a product."""
    own = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.posexplode(F.split("p_name", " ")).alias("i", "option"))
    return own.select("p_partkey", "option", F.concat_ws("-", F.col("p_partkey").cast("string"), "option").alias("sku_id"), F.round(F.col("p_retailprice") + F.col("i"), 2).alias("price"))


@query("""SELECT CASE WHEN regexp_matches(p_name, 'ring|plate') THEN 'flat' WHEN regexp_matches(p_name, 'bolt|gear') THEN 'small' WHEN regexp_matches(p_name, 'anvil') THEN 'heavy' ELSE 'other' END AS category, count(*) AS products, min(p_partkey) AS first_id FROM part GROUP BY 1""")
def category_regex_map(spark, sf_dir):
    name = F.col("p_name")
    category = F.when(name.rlike("ring|plate"), "flat").when(name.rlike("bolt|gear"), "small").when(name.rlike("anvil"), "heavy").otherwise("other")
    return table(spark, sf_dir, "part").groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("products"), F.min("p_partkey").alias("first_id"))


@query("""SELECT l_partkey AS product_id, count(DISTINCT l_suppkey) AS options, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS reviews,
    'min=' || CAST(min(l_quantity) AS BIGINT) || ';max=' || CAST(max(l_quantity) AS BIGINT) AS spec FROM lineitem GROUP BY 1""")
def product_normalize(spark, sf_dir):
    """One row a product, with its price range, options and normalised specification."""
    whole = lambda c: c.cast("long").cast("string")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(
        F.countDistinct("l_suppkey").alias("options"),
        F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("high"),
        F.count(F.lit(1)).alias("reviews"),
        F.concat(F.lit("min="), whole(F.min("l_quantity")), F.lit(";max="), whole(F.max("l_quantity"))).alias("spec"),
    )


@query("""SELECT p_partkey, 'catalog.' || substr(sha1(p_type), 1, 10) AS category_id, substr(sha256(p_name || '|' || p_brand), 1, 16) AS fingerprint, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') || '_' || substr(sha1(p_name), 1, 8) AS identifier FROM part""")
def derived_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("catalog."), F.substring(F.sha1("p_type"), 1, 10)).alias("category_id"),
        F.substring(F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256), 1, 16).alias("fingerprint"),
        F.concat(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_"), F.lit("_"), F.substring(F.sha1("p_name"), 1, 8)).alias("identifier"),
    )


@query("""WITH r AS (SELECT p_type, string_split(p_name, ' ')[-1] AS term, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_type, term, n, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, term) AS place FROM r QUALIFY place <= 5""")
def category_term_profile(spark, sf_dir):
    terms = table(spark, sf_dir, "part").groupBy("p_type", F.element_at(F.split("p_name", " "), -1).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("n"), "term"))
    return terms.withColumn("place", place.cast("long")).where("place <= 5")


@query("""SELECT * FROM (SELECT p_partkey, p_name, p_brand, md5('7' || p_partkey) AS h FROM part) ORDER BY h LIMIT 100""")
def seeded_sample(spark, sf_dir):
    """A hundred rows by a seeded hash."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.md5(F.concat(F.lit("7"), F.col("p_partkey").cast("string"))).alias("h"))
    return rows.orderBy("h").limit(100)


@query("""SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def market_totals(spark, sf_dir):
    own = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("sum"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return own.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "customers", F.round("sum", 2).alias("balance"))


@query("""SELECT text_key, min(doc_id) AS doc_id, count(*) AS repeats FROM (SELECT doc_id, sha256(text) AS text_key FROM documents) GROUP BY 1""")
def content_hash_skip(spark, sf_dir):
    """One document of each content hash: what an incremental index has to embed."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("repeats"))


