"""Catalogue queries: raw products to records, facts with fallbacks, labels, pairs, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators import catalogue as cat
from vitrine.session import table

from .registry import query

_CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def raw_products(spark, sf_dir) -> DataFrame:
    """Products as a marketplace dump has them: blanks in titles, some fields missing, values by language."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("B/"), key.cast("string"), F.lit("-"), F.col("p_size").cast("string")).alias("raw_id"),
        F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "   "), F.lit(" ")).alias("title"),
        F.when(key % 3 != 0, F.col("p_brand")).alias("brand"),
        F.when(key % 4 == 0, F.split("p_name", " ")[0]).alias("color"),
        F.col("p_type").alias("description"),
        F.array(
            F.struct(F.lit("en_US").alias("tag"), F.col("p_name").alias("value")),
            F.struct(F.when(key % 2 == 0, "zh_CN").otherwise("de_DE").alias("tag"), F.concat(F.lit("款式 "), F.col("p_name")).alias("value")),
            F.struct(F.lit("en_GB").alias("tag"), F.col("p_type").alias("value")),
        ).alias("values"),
        key.alias("key"),
    )


_RAW_SQL = """raw AS (
    SELECT 'B/' || p_partkey || '-' || p_size AS raw_id, '  ' || replace(p_name, ' ', '   ') || ' ' AS title, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS brand,
           CASE WHEN p_partkey % 4 = 0 THEN split_part(p_name, ' ', 1) END AS color, p_type AS description,
           [{'tag': 'en_US', 'value': p_name}, {'tag': CASE WHEN p_partkey % 2 = 0 THEN 'zh_CN' ELSE 'de_DE' END, 'value': '款式 ' || p_name}, {'tag': 'en_GB', 'value': p_type}] AS values, p_partkey AS key
    FROM part)"""


@query(f"""WITH {_RAW_SQL}
    SELECT 'mkt_us_' || regexp_replace(raw_id, '[^A-Za-z0-9]', '_', 'g') AS id, substr({_CLEAN.format('title')}, 1, 240) AS name, coalesce(brand, 'Unknown') AS brand,
           array_to_string(list_filter(['market', 'us', coalesce(brand, 'Unknown'), {_CLEAN.format('title')}, coalesce(color, '')], lambda x: x <> ''), '|') AS tags, substr(coalesce(description, ''), 1, 2000) AS description
    FROM raw""")
def marketplace_products(spark, sf_dir):
    """Raw rows to catalogue records: clean text, defaults, public ids, tags without empty ones."""
    r = raw_products(spark, sf_dir)
    title, brand = cat.clean(F.col("title")), F.coalesce("brand", F.lit("Unknown"))
    tags = F.filter(F.array(F.lit("market"), F.lit("us"), brand, title, F.coalesce("color", F.lit(""))), lambda x: x != "")
    return r.select(cat.public_id("mkt", "us", F.col("raw_id")).alias("id"), F.substring(title, 1, 240).alias("name"), brand.alias("brand"), F.array_join(tags, "|").alias("tags"), F.substring(F.coalesce("description", F.lit("")), 1, 2000).alias("description"))


@query(f"""WITH {_RAW_SQL}
    SELECT key, coalesce(list_filter(values, lambda v: starts_with(v.tag, 'zh'))[1].value, '') AS zh, coalesce(list_filter(values, lambda v: starts_with(v.tag, 'en'))[1].value, '') AS en,
           array_to_string(list_transform(list_filter(values, lambda v: starts_with(v.tag, 'en')), lambda v: v.value), '；') AS bullets FROM raw""")
def language_values(spark, sf_dir):
    """The value of a language by the prefix of its tag: the first, and all of them."""
    of = lambda p: cat.values_of(F.col("values"), p)
    first = lambda p: F.coalesce(F.try_element_at(of(p), F.lit(1)), F.lit(""))
    return raw_products(spark, sf_dir).select("key", first("zh").alias("zh"), first("en").alias("en"), F.array_join(F.slice(of("en"), 1, 5), "；").alias("bullets"))


_TITLES = "'[' || p_brand || '] ' || p_brand || ' 官方旗舰 ' || p_name || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' 红色' || (p_size % 7) || '寸加厚' END"
_STRIPPED = "trim(regexp_replace(replace(replace(regexp_replace(" + _TITLES + ", '^\\[[^\\]]*\\]\\s*', ''), p_brand, ''), '官方旗舰', ''), '\\s+', ' ', 'g'), ' ,、-')"


@query(f"""WITH t AS (SELECT p_partkey, {_STRIPPED} AS title FROM part), d AS (SELECT title, CAST(min(p_partkey) AS BIGINT) AS product_id FROM t GROUP BY 1)
    SELECT product_id, trim(substr(title, 1, 32)) AS query FROM d WHERE length(trim(substr(title, 1, 32))) >= 6 AND len(regexp_extract_all(substr(title, 1, 32), '[\\x{{4e00}}-\\x{{9fff}}]')) >= 4""")
def title_queries(spark, sf_dir):
    """Titles as queries: without their bracket, brand and generic words; one for each title, long enough, with four CJK characters."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    suffix = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit(" 红色"), (F.col("p_size") % 7).cast("string"), F.lit("寸加厚")))
    title = F.concat(F.lit("["), "p_brand", F.lit("] "), "p_brand", F.lit(" 官方旗舰 "), "p_name", suffix)
    stripped = cat.query_title(title, F.col("p_brand"), ("官方旗舰",))
    first = p.select(stripped.alias("title"), key.alias("key")).groupBy("title").agg(F.min("key").alias("product_id"))
    asked = F.trim(F.substring("title", 1, 32))
    return first.where((F.length(asked) >= 6) & (F.regexp_count(asked, F.lit("[\\x{4e00}-\\x{9fff}]")) >= 4)).select("product_id", asked.alias("query"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), e AS (SELECT doc_id, unnest(t) AS x, unnest(range(len(t))) AS i FROM w),
    f AS (SELECT doc_id, x, min(i) AS i FROM e GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) <= 12),
    g AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS tags FROM f GROUP BY 1)
    SELECT doc_id, source || ' ' || lang || coalesce(' ' || tags, '') AS title_text FROM documents LEFT JOIN g USING (doc_id)""")
def title_text(spark, sf_dir):
    """What a title match looks at: the fields and at most twelve tags, the first distinct words of the text."""
    tags = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))), 1, 12)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.concat(F.array("source", "lang"), tags), " ").alias("title_text"))


_TAGGED = "list_concat(string_split(p.p_name, ' '), [p.p_brand, p.p_type, 'code:' || p.p_brand || '/' || p.p_type, 'a tag of more than eighteen characters'])"


@query(f"""WITH m AS (SELECT p.p_partkey AS product_id, lower('need ' || q.p_name || ' of ' || q.p_brand || ' code:' || p.p_brand || '/' || p.p_type) AS asked, {_TAGGED} AS tags FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1)
    SELECT product_id, array_to_string(list_slice(list_filter(list_transform(range(1, len(tags) + 1), lambda i: CASE WHEN list_position(tags, tags[i]) = i AND (length(tags[i]) <= 18 OR contains(tags[i], ':')) AND contains(asked, lower(tags[i])) THEN tags[i] END), lambda x: x IS NOT NULL), 1, 4), '|') AS matched FROM m""")
def matched_tags(spark, sf_dir):
    """The tags that a query has in it: four at most, no long ones unless they are codes."""
    p = table(spark, sf_dir, "part")
    asked = p.select((F.col("p_partkey") - 1).alias("product_id"), F.concat(F.lit("need "), "p_name", F.lit(" of "), "p_brand").alias("head"))
    own = p.withColumnRenamed("p_partkey", "product_id")
    code = F.concat(F.lit("code:"), "p_brand", F.lit("/"), "p_type")
    tags = F.concat(F.split("p_name", " "), F.array("p_brand", "p_type", code, F.lit("a tag of more than eighteen characters")))
    query_text = F.lower(F.concat("head", F.lit(" "), code))
    return own.join(asked, "product_id").select("product_id", F.array_join(cat.tags_in(tags, query_text), "|").alias("matched"))


@query("""SELECT p_partkey, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.2f', v), '0+$', ''), '[.]$', '') END AS shown
    FROM (SELECT p_partkey, round(p_retailprice * CASE WHEN p_partkey % 10 = 0 THEN 10 ELSE 1 END, 2) AS v FROM part)""")
def formatted_prices(spark, sf_dir):
    """Prices without trailing zeros."""
    return table(spark, sf_dir, "part").select("p_partkey", cat.shown_price(F.round(F.col("p_retailprice") * F.when(F.col("p_partkey") % 10 == 0, 10).otherwise(1), 2)).alias("shown"))


_FACTS_SQL = """
    override AS (SELECT l_partkey AS product_id, CAST(NULL AS INT) AS sku, max(l_extendedprice) AS price FROM lineitem WHERE l_partkey % 7 = 0 GROUP BY 1
        UNION ALL SELECT l_partkey, l_linenumber, min(l_extendedprice) FROM lineitem WHERE l_partkey % 21 = 0 AND l_linenumber <= 2 GROUP BY 1, 2),
    asked AS (SELECT p_partkey AS product_id, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 7 END AS sku, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS catalogue, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand FROM part),
    facts AS (SELECT a.product_id, round(coalesce(s.price, o.price, a.catalogue), 2) AS price,
                     CASE WHEN s.price IS NOT NULL THEN 'override_sku' WHEN o.price IS NOT NULL THEN 'override' WHEN a.catalogue IS NOT NULL THEN 'catalogue' ELSE 'none' END AS source,
                     array_to_string(list_filter([CASE WHEN coalesce(s.price, o.price, a.catalogue) IS NULL THEN 'price' END, CASE WHEN brand IS NULL THEN 'brand' END], lambda x: x IS NOT NULL), ',') AS missing, brand
              FROM asked a LEFT JOIN override o ON o.product_id = a.product_id AND o.sku IS NULL LEFT JOIN override s ON s.product_id = a.product_id AND s.sku = a.sku)"""


def _facts(spark, sf_dir) -> DataFrame:
    lines, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    whole = lines.where("l_partkey % 7 = 0").groupBy(F.col("l_partkey").alias("product_id")).agg(F.max("l_extendedprice").alias("price"))
    by_sku = lines.where("l_partkey % 21 = 0 AND l_linenumber <= 2").groupBy(F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("sku")).agg(F.min("l_extendedprice").alias("price"))
    asked = p.select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(7).alias("sku"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")).alias("catalogue"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("brand"))
    return cat.with_facts(asked, whole, by_sku)


@query(f"WITH {_FACTS_SQL} SELECT product_id, price, source, missing FROM facts")
def enriched_facts(spark, sf_dir):
    """Each fact from the most particular source that has it, where it comes from, and which facts nothing has."""
    return _facts(spark, sf_dir).select("product_id", "price", "source", "missing")


@query(f"""WITH {_FACTS_SQL}, sold AS (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS sold FROM lineitem GROUP BY 1)
    SELECT f.product_id, p_name AS name, coalesce(f.brand, 'Unknown') AS brand, f.price, f.source,
           CASE WHEN coalesce(sold, 0) >= 600 THEN 'popular' WHEN f.source <> 'catalogue' THEN 'special' ELSE 'match' END AS reason, coalesce(sold, 0) AS sold
    FROM facts f JOIN part ON p_partkey = f.product_id LEFT JOIN sold ON l_partkey = f.product_id""")
def product_cards(spark, sf_dir):
    """Hits as cards: facts, names, what sold, and the reason that is shown."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(F.sum("l_quantity").cast("long").alias("sold"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"))
    n = F.coalesce("sold", F.lit(0).cast("long"))
    reason = F.when(n >= 600, "popular").when(F.col("source") != "catalogue", "special").otherwise("match")
    return _facts(spark, sf_dir).join(names, "product_id").join(sold, "product_id", "left").select("product_id", "name", F.coalesce("brand", F.lit("Unknown")).alias("brand"), "price", "source", reason.alias("reason"), n.alias("sold"))


@query("""SELECT doc_id, substr(text, 1, 500) AS text, substr(source, 1, 4) AS source, length(text) > 500 AS cut FROM documents""")
def truncated_rows(spark, sf_dir):
    """Rows for a store that limits its string columns."""
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 500).alias("text"), F.substring("source", 1, 4).alias("source"), (F.length("text") > 500).alias("cut"))


@query("""WITH k AS (SELECT doc_id, sha256('model-a|' || text) AS key, length(text) AS size FROM documents), cache AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0)
    SELECT k.key, CASE WHEN c.key IS NULL THEN 'computed' ELSE 'cached' END AS origin, count(*) AS documents, CAST(max(size) AS BIGINT) AS size FROM k LEFT JOIN cache c USING (key) GROUP BY 1, 2""")
def cached_embeddings(spark, sf_dir):
    """A cache by digest: what it has is read, what it lacks is computed once for each digest, both together are the new cache."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(F.lit("model-a|"), "text"), 256).alias("key"), F.length("text").cast("long").alias("size"))
    cache = own.where("doc_id % 3 = 0").select("key").distinct()
    return cat.through_cache(own.groupBy("key").agg(F.count(F.lit(1)).alias("documents"), F.max("size").alias("size")), cache).select("key", "origin", "documents", "size")


@query("""SELECT e_id AS order_id, p_partkey AS product_id, p_name AS name, CAST(count(*) AS BIGINT) AS examples FROM (SELECT l_orderkey AS e_id, l_partkey FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') AND l_returnflag = 'R') JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def restricted_examples(spark, sf_dir):
    """Examples whose product is in a set of ids, then with the product's fields."""
    p = table(spark, sf_dir, "part")
    wanted = p.where("p_type = 'PROMO'").select("p_partkey")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("p_partkey"))
    kept = lines.join(wanted, "p_partkey", "left_semi").groupBy("order_id", "p_partkey").agg(F.count(F.lit(1)).alias("examples"))
    return kept.join(p.select("p_partkey", "p_name"), "p_partkey").select("order_id", F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), "examples")


@query("""WITH t AS (SELECT event_id, 'Sure, here it is: ' || CASE event_id % 5 WHEN 0 THEN '```json ' || props || ' ```' WHEN 1 THEN props || ' {"x": 1}' WHEN 2 THEN 'none'
        WHEN 3 THEN 'see {it} or {"a": {"b": [1, {"c": "}{ "}]}, "k": ' || CAST(event_id % 7 AS VARCHAR) || '} ' || props ELSE '{"k": 1, "in": ' || props END AS answer, event_type, value FROM events),
    o AS (SELECT *, list_filter(range(1, length(answer) + 1), lambda i: substr(answer, CAST(i AS INT), 1) = '{') AS opens, list_filter(range(1, length(answer) + 1), lambda i: substr(answer, CAST(i AS INT), 1) = '}') AS closes FROM t),
    j AS (SELECT *, list_filter(flatten(list_transform(opens, lambda a: list_transform(closes, lambda b: CASE WHEN b > a THEN substr(answer, CAST(a AS INT), CAST(b - a + 1 AS INT)) END))), lambda x: x IS NOT NULL AND json_valid(x))[1] AS found FROM o)
    SELECT event_id, CAST(json_extract_string(found, '$.k') AS INT) AS k, found IS NOT NULL AS parsed,
           CASE WHEN points >= 3 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT *, CASE WHEN found IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END + CASE WHEN value > 50 THEN 1 ELSE 0 END AS points FROM j)""")
def json_in_text(spark, sf_dir):
    """The first JSON object in a model's answer, with inner objects, and how sure its fields make us."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id") % 5
    nested = F.concat(F.lit('see {it} or {"a": {"b": [1, {"c": "}{ "}]}, "k": '), (F.col("event_id") % 7).cast("string"), F.lit("} "), "props")
    body = F.when(n == 0, F.concat(F.lit("```json "), "props", F.lit(" ```"))).when(n == 1, F.concat("props", F.lit(' {"x": 1}'))).when(n == 2, "none").when(n == 3, nested).otherwise(F.concat(F.lit('{"k": 1, "in": '), "props"))
    e = e.select("event_id", "event_type", "value", cat.first_json(F.concat(F.lit("Sure, here it is: "), body)).alias("found"))
    found = F.col("found")
    points = found.isNotNull().cast("int") + (F.col("event_type") != "error").cast("int") + (F.col("value") > 50).cast("int")
    return e.select("event_id", F.get_json_object(found, "$.k").cast("int").alias("k"), found.isNotNull().alias("parsed"), F.when(points >= 3, "high").when(points >= 2, "medium").otherwise("low").alias("confidence"))


@query("""WITH m AS (SELECT user_id, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2) SELECT label, CAST(sum(n) AS BIGINT) AS total, count(*) AS users, CAST(max(n) AS BIGINT) AS most FROM m GROUP BY 1""")
def labels_long(spark, sf_dir):
    """Maps of labels to counts, one a user, as rows, and their totals."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("labels"))
    return maps.select("user_id", F.explode("labels").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("users"), F.max("n").alias("most"))


_LABELS = {"view": "I", "click": "C", "purchase": "E", "signup": "S"}


@query("""WITH e AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS product, CASE trim(lower(event_type || ' ')) WHEN 'view' THEN 'I' WHEN 'click' THEN 'C' WHEN 'purchase' THEN 'E' WHEN 'signup' THEN 'S' END AS label FROM events WHERE value < 60)
    SELECT product, label, event_id FROM e WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product ORDER BY event_id) = 1""")
def normalized_labels(spark, sf_dir):
    """Labels by a map, unknown ones dropped, one band of values, the first row of each product."""
    e = table(spark, sf_dir, "events").where("value < 60")
    label = cat.mapped(F.trim(F.lower(F.concat("event_type", F.lit(" ")))), _LABELS)
    own = e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("product"), label.alias("label")).where("label IS NOT NULL")
    return own.groupBy("product").agg(F.min_by("label", "event_id").alias("label"), F.min("event_id").alias("event_id"))


#: A literal taxonomy: label, type, display name.
TYPES = [("ring", "jewelry.ring", "Ring"), ("gear", "parts.gear", "Gear"), ("bolt", "parts.bolt", "Bolt"), ("anvil", "tools.anvil", "Anvil")]
_TYPES_SQL = "types AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in TYPES) + ") t(label, type, shown))"


@query(f"""WITH {_TYPES_SQL}, m AS (SELECT p_partkey AS product_id, '{{"name":"' || p_name || '","types":"stale"}}' AS metadata FROM part),
    j AS (SELECT product_id, json_extract_string(metadata, '$.name') AS name FROM m)
    SELECT product_id, string_agg(type, ',' ORDER BY type) AS types, string_agg(shown, ', ' ORDER BY type) AS shown FROM j JOIN types ON contains(lower(name), label) GROUP BY 1""")
def rehydrated_types(spark, sf_dir):
    """Types derived again from stored metadata, whatever types it holds, and their display names."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.concat(F.lit('{"name":"'), "p_name", F.lit('","types":"stale"}')).alias("metadata"))
    name = F.lower(F.from_json("metadata", "name string, types string")["name"])
    types = F.broadcast(spark.createDataFrame(TYPES, "label string, type string, shown string"))  # a literal
    found = p.select("product_id", name.alias("name")).join(types, F.contains("name", F.col("label"))).groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("type", "shown"))).alias("t"))
    return found.select("product_id", F.array_join("t.type", ",").alias("types"), F.array_join("t.shown", ", ").alias("shown"))


@query("""WITH p AS (SELECT 'text' AS kind, doc_id AS id, substr(sha256(CAST(doc_id AS VARCHAR) || 'seed-7'), 1, 16) AS place FROM documents
        UNION ALL SELECT 'item', item_id, substr(sha256(CAST(item_id AS VARCHAR) || 'seed-7'), 1, 16) FROM benchmark)
    SELECT kind, id, place, ntile(4) OVER (ORDER BY place, kind, id) AS part FROM p""")
def shuffled_pairs(spark, sf_dir):
    """Two sets of pairs as one, in an order by seeded digest, in four parts of equal size.

    Parts are counted by the first digits of the digest, so no task holds the whole order.
    """
    digest = lambda c: F.substring(F.sha2(F.concat(F.col(c).cast("string"), F.lit("seed-7")), 256), 1, 16)
    docs = table(spark, sf_dir, "documents").select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), digest("doc_id").alias("place"))
    items = table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), digest("item_id").alias("place"))
    return cat.tiles(docs.unionByName(items), 4)


@query("""WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS expected FROM orders GROUP BY 1), b AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS got FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
    SELECT a.o_custkey, array_to_string(list_sort(list_filter(expected, lambda x: NOT list_contains(coalesce(got, []), x))), ',') AS missing, array_to_string(list_sort(list_filter(coalesce(got, []), lambda x: x <> '1-URGENT' AND list_contains(expected, x))), ',') AS shared FROM a LEFT JOIN b USING (o_custkey)""")
def label_differences(spark, sf_dir):
    """Labels that were expected and not found, and those in both."""
    o = table(spark, sf_dir, "orders")
    sets = o.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("expected"), F.collect_set(F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))).alias("got"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return sets.select("o_custkey", joined(F.array_except("expected", "got")).alias("missing"), joined(F.array_except(F.array_intersect("expected", "got"), F.array(F.lit("1-URGENT")))).alias("shared"))


@query("""WITH c AS (SELECT user_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS value, CAST(floor(value) AS BIGINT) AS confidence, event_id FROM events)
    SELECT user_id, kind, value, max(confidence) AS confidence, CAST(arg_min(event_id, (-confidence, event_id)) AS BIGINT) AS event_id FROM c GROUP BY 1, 2, 3""")
def surest_candidates(spark, sf_dir):
    """Candidates of one kind and value: the surest stays, the first of equals."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), (F.get_json_object("props", "$.k").cast("int") % 10).alias("value"), F.floor("value").alias("confidence"), "event_id")
    return e.groupBy("user_id", "kind", "value").agg(F.max("confidence").alias("confidence"), F.min_by("event_id", F.struct(-F.col("confidence"), "event_id")).alias("event_id"))


@query("""SELECT session, last_seen, rank FROM (SELECT user_id AS session, max(event_id) AS last_seen, row_number() OVER (ORDER BY max(ts) DESC, user_id) AS rank FROM events GROUP BY 1) WHERE rank <= 20""")
def recent_sessions(spark, sf_dir):
    """The twenty sessions seen last: sorted in parts, limited in each."""
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session")).agg(F.max("event_id").alias("last_seen"), F.max("ts").alias("ts"))
    best = last.orderBy(F.desc("ts"), "session").limit(20)
    return best.select("session", "last_seen", F.row_number().over(Window.orderBy(F.desc("ts"), "session")).cast("long").alias("rank"))
