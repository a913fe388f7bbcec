"""Aliases with their places in texts, brands by alias, and names that are nearly an alias."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import fuzzy, spans
from vitrine.session import table

from .registry import query


def occurrences_sql(texts: str) -> str:
    """Common table expressions: ``hit`` (id, target, alias, excludes, a, b) of ``alias`` (target, alias, excludes) in ``txt`` (id, text)."""
    return f"""txt AS ({texts}),
    one AS (SELECT DISTINCT alias FROM alias),
    cut AS (SELECT id, text, alias, string_split(text, alias) AS parts FROM txt JOIN one ON contains(text, alias)),
    raw AS (SELECT id, text, alias, CAST(list_sum(list_transform(parts[:k], lambda p: length(p))) + (k - 1) * length(alias) AS BIGINT) AS a
            FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM cut)),
    hit AS (
        SELECT id, target, alias, excludes, a, a + length(alias) AS b FROM raw JOIN alias USING (alias)
        WHERE regexp_matches(alias, '[^\\x00-\\x7f]') OR NOT (regexp_matches(substr(text, a, CASE WHEN a > 0 THEN 1 ELSE 0 END), '[a-z0-9]') OR regexp_matches(substr(text, a + 1 + length(alias), 1), '[a-z0-9]'))),
    found AS (
        SELECT id, target, alias, string_agg(a || '-' || b, ',' ORDER BY a) AS places, count(*) AS n,
               count(*) FILTER (NOT EXISTS (SELECT 1 FROM hit e WHERE e.excludes AND e.id = h.id AND e.target = h.target AND e.a < h.b AND h.a < e.b)) AS free
        FROM hit h WHERE NOT excludes GROUP BY 1, 2, 3)"""


_ITEMS = """alias AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS target, lower(w[k + 1]) AS alias, false AS excludes FROM (SELECT item_id, string_split(text, ' ') AS w, unnest([0, 2, 4]) AS k FROM benchmark) WHERE w[k + 1] <> ''
    UNION SELECT CAST(item_id AS VARCHAR), lower(w[k + 1] || ' ' || w[k + 2]), true FROM (SELECT item_id, string_split(text, ' ') AS w, unnest([0, 2]) AS k FROM benchmark) WHERE len(w) >= k + 2)"""


def _item_aliases(spark, sf_dir):
    """Of each benchmark item: its first, third and fifth word as aliases, and the first two pairs of words as what excludes them."""
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("target"), F.split("text", " ").alias("w"))
    word = lambda k: F.try_element_at("w", F.lit(k + 1))
    single = words.select("target", F.explode(F.array(word(0), word(2), word(4))).alias("alias"), F.lit(False).alias("excludes"))
    double = words.select("target", F.explode(F.array(F.concat(word(0), F.lit(" "), word(1)), F.concat(word(2), F.lit(" "), word(3)))).alias("alias"), F.lit(True).alias("excludes"))
    return single.unionByName(double)


@query(f"WITH {_ITEMS}, {occurrences_sql('SELECT doc_id AS id, lower(text) AS text FROM documents')} SELECT id AS doc_id, target, alias, places, n, free FROM found")
def alias_spans(spark, sf_dir):
    """Where documents name an item's words, and how often outside of the pairs of words that exclude them."""
    return spans.found(table(spark, sf_dir, "documents"), "doc_id", "text", _item_aliases(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query(f"""WITH {_ITEMS}, {occurrences_sql("SELECT conv_id * 1000 + turn AS id, lower(text) AS text FROM conversations")}
    SELECT target, count(DISTINCT id) AS turns, CAST(sum(n) AS BIGINT) AS n, CAST(sum(free) AS BIGINT) AS free, count(DISTINCT CASE WHEN free > 0 THEN id END) AS meant FROM found GROUP BY 1""")
def alias_turns(spark, sf_dir):
    """How many turns name an item, and in how many it is meant, since an occurrence is not covered."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    own = spans.found(turns, "id", "text", _item_aliases(spark, sf_dir)).groupBy("target", "id").agg(F.sum("n").alias("n"), F.sum("free").alias("free"))
    return own.groupBy("target").agg(F.count(F.lit(1)).alias("turns"), F.sum("n").alias("n"), F.sum("free").alias("free"), F.count_if(F.col("free") > 0).alias("meant"))


#: Types with their aliases, and what excludes each type.
TYPES = [("parts.bolt", "bolt", False), ("parts.bolt", "old bolt", True), ("jewelry.ring", "ring", False), ("jewelry.ring", "ring gear", True), ("parts.gear", "gear", False), ("parts.gear", "small gear", True), ("parts.small_gear", "small gear", False), ("misc.widget", "widget", False), ("misc.widget", "red widget", True)]
_TYPES_SQL = "alias AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{a}', {str(x).lower()})" for t, a, x in TYPES) + ") v(target, alias, excludes))"


@query(f"WITH {_TYPES_SQL}, {occurrences_sql('SELECT p_partkey AS id, lower(p_name) AS text FROM part')} SELECT DISTINCT id AS p_partkey, target AS type FROM found WHERE free > 0")
def taxonomy_spans(spark, sf_dir):
    """The types of each product by aliases in its name that no exclusion of the type covers."""
    aliases = spark.createDataFrame(TYPES, "target string, alias string, excludes boolean")
    own = spans.found(table(spark, sf_dir, "part"), "p_partkey", "p_name", aliases).where("free > 0")
    return own.select(F.col("id").alias("p_partkey"), F.col("target").alias("type")).distinct()


_BRANDS_SQL = "alias AS (SELECT DISTINCT b AS target, lower(trim(unnest([b, regexp_replace(b, '[#\\s\\-_.·]+', ' ', 'g'), regexp_replace(b, '[#\\s\\-_.·]+', '-', 'g'), regexp_replace(b, '[#\\s\\-_.·]+', '', 'g')]))) AS alias, false AS excludes FROM (SELECT DISTINCT p_brand AS b FROM part))"
_WITHOUT = "'no ' || replace(p_brand, '#', CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE ' ' END) || ' please'"


@query(f"""WITH {_BRANDS_SQL}, {occurrences_sql(f"SELECT o_orderkey AS id, lower({_WITHOUT}) AS text FROM orders JOIN part ON p_partkey = o_orderkey % 200 + 1")},
    brand AS (SELECT p_brand AS target, count(*) AS products FROM part GROUP BY 1), every AS (SELECT count(*) AS products FROM part)
    SELECT f.id AS o_orderkey, f.target AS excluded, every.products - brand.products AS remaining FROM (SELECT DISTINCT id, target FROM found) f JOIN brand USING (target) CROSS JOIN every""")
def brands_excluded(spark, sf_dir):
    """Brands that requests do not want, in any spelling of the alias table, and how many products are left for each."""
    p = table(spark, sf_dir, "part")
    aliases = p.select(F.col("p_brand").alias("target")).distinct().select("target", F.explode(spans.surface_forms(F.col("target"))).alias("alias"))
    k = F.col("o_orderkey") % 3
    sign = F.when(k == 0, "").when(k == 1, "-").otherwise(" ")
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 200 + 1).alias("p_partkey")).join(p.select("p_partkey", "p_brand"), "p_partkey")
    asked = asked.select("o_orderkey", F.concat(F.lit("no "), F.replace("p_brand", F.lit("#"), sign), F.lit(" please")).alias("message"))
    own = spans.found(asked, "o_orderkey", "message", aliases).select(F.col("id").alias("o_orderkey"), F.col("target").alias("excluded")).distinct()
    left = p.groupBy(F.col("p_brand").alias("excluded")).agg(F.count(F.lit(1)).alias("own"))
    every = p.agg(F.count(F.lit(1)).alias("every"))
    return own.join(left, "excluded").crossJoin(F.broadcast(every)).select("o_orderkey", "excluded", (F.col("every") - F.col("own")).alias("remaining"))  # one row


@query()
def fuzzy_names(spark, sf_dir):
    """Misspelt product names and the name each one resolves to, by the ratio of matching blocks."""
    p = table(spark, sf_dir, "part")
    key, name = F.col("p_partkey") % 4, F.col("p_name")
    typo = F.when(key == 0, F.concat(F.substring(name, 1, 4), F.substring(name, 6, 1000))).when(key == 1, F.concat(F.substring(name, 1, 3), F.substring(name, 3, 1000))).when(key == 2, F.upper(name)).otherwise(F.reverse(name))
    return fuzzy.resolved(p.select(typo.alias("value")), "value", p.select(F.col("p_name").alias("alias"), F.col("p_name").alias("target")))
