"""Retrieval over a table of queries, slots, fusions of modes, and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions.text import search_tokens_sql
from vitrine.operators import ranking, selection, vectors
from vitrine.session import kept, table

from .filters import PRODUCT_SQL, products
from .registry import query

_QUERIES_SQL = """q AS (SELECT p_partkey AS query_id, lower(p_name || ' ' || p_brand) AS q, CASE WHEN p_partkey % 150 = 0 THEN lower(p_type) ELSE p_type END AS category,
    p_retailprice - 20 AS low, p_retailprice + 20 AS high, split_part(p_name, ' ', 2) AS type, CASE WHEN p_partkey % 100 = 0 THEN lower(p_brand) END AS excluded FROM part WHERE p_partkey % 50 = 0)"""
_POOL_SQL = f"""{PRODUCT_SQL}, {_QUERIES_SQL},
    t AS (SELECT *, {search_tokens_sql('q')} AS qt FROM q), d AS (SELECT *, {search_tokens_sql('hay')} AS dt FROM product),
    pairs AS (SELECT query_id, product_id, CAST(len(list_intersect(qt, dt)) AS DOUBLE) AS recall, d.category = t.category AND list_contains(tags, type) AND price BETWEEN low AND high AND stock > 0 AS strict FROM t, d),
    tight AS (SELECT query_id, product_id, recall, false AS relaxed FROM pairs WHERE recall > 0 AND strict QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY recall DESC, product_id) <= 50),
    loose AS (SELECT query_id, product_id, recall, true AS relaxed FROM pairs WHERE recall > 0 AND query_id NOT IN (SELECT query_id FROM tight) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY recall DESC, product_id) <= 50),
    pool AS (SELECT * FROM tight UNION ALL SELECT * FROM loose),
    kept AS (SELECT pool.*, name, brand, price, q, low, high FROM pool JOIN product USING (product_id) JOIN q USING (query_id)
             WHERE price BETWEEN low AND high AND stock > 0 AND (excluded IS NULL OR NOT contains(hay, excluded)) AND list_contains(tags, type) AND lower(product.category) = lower(q.category))"""


def _asked(spark, sf_dir):
    """A query for each fiftieth product; a third of them name a category as a store does not."""
    p, key = table(spark, sf_dir, "part").where("p_partkey % 50 = 0"), F.col("p_partkey")
    return p.select(
        key.alias("query_id"),
        F.lower(F.concat("p_name", F.lit(" "), "p_brand")).alias("q"),
        F.when(key % 150 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("category"),
        (F.col("p_retailprice") - 20).alias("low"),
        (F.col("p_retailprice") + 20).alias("high"),
        F.split("p_name", " ")[1].alias("type"),
        F.when(key % 100 == 0, F.lower("p_brand")).alias("excluded"),
    )


@query(f"""WITH {_POOL_SQL}
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank, product_id, score, relaxed FROM (
        SELECT *, round(recall + 20.0::DOUBLE + 12 + 2 + least(greatest(high - price, 0), 500) / 500 + 1 + CASE WHEN contains(q, lower(name)) THEN 8 ELSE 0 END + CASE WHEN contains(q, lower(brand)) THEN 4 ELSE 0 END, 6) AS score FROM kept)
    QUALIFY rank <= 10""")
def many_queries_topk(spark, sf_dir):
    """The whole pipeline for a table of queries: pools, a second recall where the first is empty, all filters, rules, ten each."""
    p, q = kept(products(spark, sf_dir), "products"), _asked(spark, sf_dir)
    left = selection.filtered(selection.retrieved(p, q), p, q)
    score = left.select("query_id", F.col("product_id").alias("doc_id"), "relaxed", F.round(F.col("recall") + selection.bonus(), 6).alias("score"))
    return ranking.top_k(score, 10).select("query_id", "rank", F.col("doc_id").alias("product_id"), "score", "relaxed")


@query(f"""WITH {_POOL_SQL}, n AS (SELECT query_id, count(*) AS pool, bool_or(relaxed) AS relaxed FROM pool GROUP BY 1), k AS (SELECT query_id, count(*) AS kept FROM kept GROUP BY 1)
    SELECT query_id, coalesce(pool, 0) AS pool, coalesce(relaxed, true) AS relaxed, coalesce(kept, 0) AS kept, CASE WHEN coalesce(pool, 0) = 0 THEN 'recall' WHEN coalesce(kept, 0) = 0 THEN 'filters' ELSE 'none' END AS emptied_by
    FROM q LEFT JOIN n USING (query_id) LEFT JOIN k USING (query_id)""")
def many_queries_branches(spark, sf_dir):
    """Of each query: how large its pool was, whether filters were relaxed, what is left, and what emptied it."""
    p, q = kept(products(spark, sf_dir), "products"), _asked(spark, sf_dir)
    pool = selection.retrieved(p, q)
    n = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("pool"), F.bool_or("relaxed").alias("relaxed"))
    k = selection.filtered(pool, p, q).groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))
    own = q.select("query_id").join(n, "query_id", "left").join(k, "query_id", "left").select("query_id", F.coalesce("pool", F.lit(0)).alias("pool"), F.coalesce("relaxed", F.lit(True)).alias("relaxed"), F.coalesce("kept", F.lit(0)).alias("kept"))
    return own.withColumn("emptied_by", F.when(F.col("pool") == 0, "recall").when(F.col("kept") == 0, "filters").otherwise("none"))


#: Slots of two bundles: bundle, slot, place, the type that fills it, and its budget.
SLOTS = [("desk", "base", 1, "gear", 950.0), ("desk", "joint", 2, "bolt", 930.0), ("gift", "main", 1, "ring", 990.0), ("gift", "extra", 2, "widget", 920.0)]
_SLOTS_SQL = "slots AS (SELECT * FROM (VALUES " + ", ".join(f"('{b}', '{s}', {n}, '{t}', {p}::DOUBLE)" for b, s, n, t, p in SLOTS) + ") v(bundle, slot, place, type, budget))"


@query(f"""WITH {PRODUCT_SQL}, {_SLOTS_SQL}, c AS (SELECT bundle, slot, product_id, price, row_number() OVER (PARTITION BY bundle, slot ORDER BY price DESC, product_id) AS rank
    FROM product JOIN slots ON list_contains(tags, type) WHERE price <= budget AND stock > 0) SELECT * FROM c WHERE rank <= 3""")
def slot_retrieval(spark, sf_dir):
    """The best three products of every slot of every bundle, in one job: types are joined, slots are windows."""
    slots = F.broadcast(spark.createDataFrame(SLOTS, "bundle string, slot string, place int, type string, budget double"))  # a literal
    found = products(spark, sf_dir).where("stock > 0").select("product_id", "price", F.explode(F.array_distinct("tags")).alias("type")).join(slots, "type").where("price <= budget")
    keyed = found.select(F.concat_ws("/", "bundle", "slot").alias("query_id"), "bundle", "slot", "product_id", "price", F.col("price").alias("score"))
    return ranking.top_k(keyed, 3, item="product_id").select("bundle", "slot", "product_id", "price", "rank")


@query(f"""WITH near AS (SELECT q.vec_id AS query_id, d.vec_id, round(1 - round(list_cosine_similarity(q.e, d.e), 6), 6) AS distance
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) d JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0) q ON d.vec_id <> q.vec_id
        QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, d.e), 6) DESC, d.vec_id) <= 100),
    w AS (SELECT doc_id, {search_tokens_sql('text')} AS t FROM documents),
    s AS (SELECT query_id, vec_id AS doc_id, round(len(list_intersect(a.t, b.t)) + 1 / (1 + distance), 6) AS score FROM near JOIN w a ON a.doc_id = query_id JOIN w b ON b.doc_id = vec_id)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def vector_then_lexical(spark, sf_dir):
    """Ten times as many nearest vectors as are asked for, scored again by shared terms and nearness."""
    rows, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    near = vectors.nearest(rows, rows.where("vec_id % 50 = 0"), 100).select("query_id", F.col("vec_id").alias("doc_id"), F.round(1 - F.col("score"), 6).alias("distance"))
    asked = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("q"))
    both = near.join(asked, "query_id").join(docs.select("doc_id", "text"), "doc_id")
    return ranking.top_k(both.select("query_id", "doc_id", F.round(selection.shared_terms(F.col("q"), F.col("text")) + 1 / (1 + F.col("distance")), 6).alias("score")), 10)


def _half(start: int, name: str) -> str:
    cos = f"round(list_cosine_similarity(list_slice(q.e, {start}, {start + 31}), list_slice(d.e, {start}, {start + 31})), 6)"
    return f"""{name} AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {cos} AS score FROM v d JOIN v q ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
        QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {cos} DESC, d.vec_id) <= 50)"""


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), {_half(1, 'words')}, {_half(33, 'looks')},
    f AS (SELECT query_id, doc_id, round(0.6::DOUBLE * coalesce(a.score, 0) + 0.4::DOUBLE * coalesce(b.score, 0), 6) AS score FROM words a FULL JOIN looks b USING (query_id, doc_id))
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def text_image_fusion(spark, sf_dir):
    """Hits by text and by image, fused by weight; a mode that lacks a hit gives it nothing."""
    rows = table(spark, sf_dir, "embeddings")

    def mode(start: int):
        own = rows.select("vec_id", F.slice("embedding", start, 32).alias("embedding"))
        return vectors.nearest(own, own.where("vec_id % 50 = 0"), selection.POOL).withColumnRenamed("vec_id", "doc_id")

    both = ranking.both(mode(1).withColumn("route", F.lit("bm25")).unionByName(mode(33).withColumn("route", F.lit("overlap"))))
    return ranking.top_k(both.select("query_id", "doc_id", F.round(0.6 * F.col("a") + 0.4 * F.col("b"), 6).alias("score")), 10)


#: Scenarios: name, priority, words that call it, words that suggest it, words of its slots, types.
SCENARIOS = [("workshop", 60, ("bolt", "anvil"), ("small", "old"), ("economy", "standard"), ("gear",)), ("present", 80, ("ring",), ("red", "blue", "hot"), ("promo",), ("ring", "widget")), ("daily", 20, ("cold",), ("large",), ("medium", "small"), ("panel",))]


def _scenario_sql(name, priority, calls, hints, slots, types) -> str:
    n = lambda words: "(" + " + ".join(f"CASE WHEN contains(m, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"
    longest = "greatest(" + ", ".join(f"CASE WHEN contains(m, '{w}') THEN {len(w)} ELSE 0 END" for w in calls) + ", 0)"
    return f"""SELECT product_id, '{name}' AS scenario, {priority} AS priority, CASE WHEN {n(calls)} + {n(hints)} = 0 THEN 0.0 ELSE {priority} * 0.15::DOUBLE
        + CASE WHEN {n(calls)} > 0 THEN 55 + {longest} + 8 * least({n(calls)}, 3) ELSE 0 END + 12 * least({n(hints)}, 4) + 7 * least({n(slots)}, 5) + 18 * {n(types)} END AS score FROM msg"""


@query("WITH msg AS (SELECT p_partkey AS product_id, lower('need a ' || p_name || ' for ' || p_type) AS m FROM part), s AS (" + " UNION ALL ".join(_scenario_sql(*s) for s in SCENARIOS) + """),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score DESC, priority DESC, scenario) = 1)
    SELECT product_id, CASE WHEN score >= 30 THEN scenario ELSE 'default' END AS scenario, round(score, 4) AS score, round(least(score / 100, 0.99), 4) AS confidence, CASE WHEN score >= 60 THEN 'bundle' WHEN score >= 30 THEN 'ask' ELSE 'single' END AS route FROM b""")
def scenario_route(spark, sf_dir):
    """Which scenario a message calls: points for words, slots and types, a gate, a default, and the route that follows."""
    m = F.lower(F.concat(F.lit("need a "), "p_name", F.lit(" for "), "p_type"))
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), m.alias("m"))

    def points(name, priority, calls, hints, slots, types):
        n = lambda words: sum((F.contains("m", F.lit(w)).cast("int") for w in words), F.lit(0))
        longest = F.greatest(*[F.when(F.contains("m", F.lit(w)), len(w)).otherwise(0) for w in calls], F.lit(0))
        called = F.when(n(calls) > 0, 55 + longest + 8 * F.least(n(calls), F.lit(3))).otherwise(0)
        total = priority * 0.15 + called + 12 * F.least(n(hints), F.lit(4)) + 7 * F.least(n(slots), F.lit(5)) + 18 * n(types)
        return F.struct(F.when(n(calls) + n(hints) == 0, 0.0).otherwise(total).alias("score"), F.lit(priority).alias("priority"), F.lit(name).alias("scenario"))

    # The best by score and priority; of equals the first by name, which no two scenarios of one priority need here.
    best = own.withColumn("best", F.array_max(F.array(*[points(*s) for s in SCENARIOS])))
    score = F.col("best.score")
    return best.select(
        "product_id", F.when(score >= 30, F.col("best.scenario")).otherwise("default").alias("scenario"), F.round(score, 4).alias("score"),
        F.round(F.least(score / 100, F.lit(0.99)), 4).alias("confidence"), F.when(score >= 60, "bundle").when(score >= 30, "ask").otherwise("single").alias("route"),
    )


_SIDES_SQL = """side AS (SELECT p_partkey AS query_id, 1 AS side, split_part(p_name, ' ', 1) AS term, p_retailprice AS high, p_type FROM part WHERE p_partkey % 50 = 0
        UNION ALL SELECT p_partkey, 2, split_part(p_name, ' ', 2), p_retailprice, p_type FROM part WHERE p_partkey % 50 = 0)"""
_PICK_SQL = """row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN contains(lower(p.p_name), term) AND p.p_retailprice <= high THEN 0 WHEN contains(lower(p.p_name), term) THEN 1 WHEN p.p_retailprice <= high THEN 2 ELSE 3 END, p_partkey) = 1"""


@query(f"""WITH {_SIDES_SQL}, a AS (SELECT query_id, side, p_partkey AS product_id FROM side s JOIN part p ON p.p_type = s.p_type WHERE side = 1 QUALIFY {_PICK_SQL}),
    b AS (SELECT s.query_id, s.side, p_partkey AS product_id FROM side s JOIN part p ON p.p_type = s.p_type JOIN a ON a.query_id = s.query_id AND a.product_id <> p_partkey WHERE s.side = 2 QUALIFY {_PICK_SQL.replace('query_id', 's.query_id')})
    SELECT * FROM a UNION ALL SELECT * FROM b""")
def compared_cards(spark, sf_dir):
    """A card for both sides of a comparison: a match within budget, else a match, else another; no card twice."""
    p = table(spark, sf_dir, "part")
    terms = F.array(*[F.split_part("p_name", F.lit(" "), F.lit(k)) for k in (1, 2)])
    asked = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), terms.alias("terms"), F.col("p_retailprice").alias("high"), F.col("p_type").alias("category"))
    cards = p.select(F.col("p_partkey").alias("product_id"), F.lower("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_type").alias("category"))
    return selection.compared_pick(cards, asked)


def _fold_sql() -> str:
    parts = ["base AS (SELECT o_orderkey, o_totalprice * 0.25 AS rest FROM orders)", "card AS (SELECT l_orderkey, l_linenumber % 3 AS slot, l_partkey AS id, l_extendedprice AS price FROM lineitem)"]
    before, taken = "base", []
    for k in range(3):
        unseen = "".join(f" AND (b.id{j} IS NULL OR c.id <> b.id{j})" for j in taken)
        parts.append(f"""s{k} AS (SELECT b.*, c.id AS id{k}, c.price AS price{k} FROM {before} b LEFT JOIN card c ON c.l_orderkey = b.o_orderkey AND c.slot = {k} AND c.price <= b.rest{unseen}
            QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY c.price NULLS LAST, c.id) = 1)""")
        parts.append(f"r{k} AS (SELECT * REPLACE (rest - coalesce(price{k}, 0) AS rest) FROM s{k})")
        before, taken = f"r{k}", [*taken, k]
    return "WITH " + ", ".join(parts) + " SELECT o_orderkey, array_to_string([coalesce(CAST(id0 AS VARCHAR), '-'), coalesce(CAST(id1 AS VARCHAR), '-'), coalesce(CAST(id2 AS VARCHAR), '-')], ',') AS cards, round(rest, 4) AS rest FROM r2"


@query(_fold_sql())
def cheapest_feasible(spark, sf_dir):
    """When no best bundle is affordable: slot by slot the cheapest card that the rest of the budget pays. An order's lines are its cards."""
    cards = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 3).alias("slot")).agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("id"))).alias("cards"))
    slots = cards.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("slot", "cards"))).alias("m"))
    none = F.array().cast("array<struct<price:double,id:long>>")
    own = table(spark, sf_dir, "orders").join(slots, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    in_order = F.array(*[F.coalesce(F.try_element_at("m", F.lit(k)), none) for k in range(3)])
    done = own.select("o_orderkey", selection.cheapest_fold(in_order, F.col("o_totalprice") * 0.25).alias("f"))
    return done.select("o_orderkey", F.array_join(F.transform("f.ids", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias("cards"), F.round("f.rest", 4).alias("rest"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS place, l_partkey AS id, lower(p_name) AS name FROM lineitem JOIN part ON p_partkey = l_partkey),
    a AS (SELECT l_orderkey, lower('We like the ' || coalesce(string_agg(name, ', then the ' ORDER BY id DESC, place DESC) FILTER (place > 1), 'store')) AS answer FROM l GROUP BY 1)
    SELECT l_orderkey, string_agg(CAST(id AS VARCHAR), ',' ORDER BY CASE WHEN strpos(answer, name) > 0 THEN strpos(answer, name) ELSE 10000000 END, place, id) AS shown FROM l JOIN a USING (l_orderkey) GROUP BY 1""")
def cards_by_mention(spark, sf_dir):
    """Cards in the order in which the answer names them."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("name"))
    lines = table(spark, sf_dir, "lineitem").join(names, "l_partkey").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("id"), "name")).alias("cards"))
    told = F.transform(F.reverse(F.array_sort(F.transform(F.filter("cards", lambda c: c["place"] > 1), lambda c: F.struct(c["id"], c["place"], c["name"].alias("name"))))), lambda c: c["name"])
    answer = F.concat(F.lit("we like the "), F.when(F.size(told) > 0, F.array_join(told, ", then the ")).otherwise("store"))
    return lines.select("l_orderkey", F.array_join(F.transform(selection.by_mention(F.col("cards"), answer), lambda x: x.cast("string")), ",").alias("shown"))


@query("""SELECT o_orderkey, round(least(o_totalprice, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal * 100 END, o_totalprice)), 2) AS high, round(greatest(100, o_totalprice / 1000), 2) AS low,
    array_to_string(list_sort(list_distinct(['returns', lower(o_orderstatus), lower(c_mktsegment), CASE WHEN o_orderstatus = 'F' THEN 'returns' ELSE 'f' END])), ',') AS excluded FROM orders JOIN customer ON c_custkey = o_custkey""")
def merged_slot_filters(spark, sf_dir):
    """A slot's filters within those of the whole: the lower of the upper bounds, the higher of the lower ones, all exclusions."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment"), "o_custkey")
    high = F.least("o_totalprice", F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 100), F.col("o_totalprice")))
    slot, whole = F.array(F.lit("returns"), F.lower("o_orderstatus")), F.array(F.lower("c_mktsegment"), F.when(F.col("o_orderstatus") == "F", "returns").otherwise("f"))
    return o.select("o_orderkey", F.round(high, 2).alias("high"), F.round(F.greatest(F.lit(100.0), F.col("o_totalprice") / 1000), 2).alias("low"), F.array_join(F.array_sort(F.array_union(slot, whole)), ",").alias("excluded"))
