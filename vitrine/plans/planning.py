"""Planning queries: rewrites, routes, constraints, scopes, pending purchases, orders, taxonomy annotation, guard counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.functions import text as t
from vitrine.operators import grounding, orders
from vitrine.operators import language as nlu
from vitrine.session import table

from . import grounding as answers_of
from .language import _MSG_SQL, messages
from .orders import fold_sql
from .registry import query

_VAGUE = "(length(trim(message)) < 3 OR regexp_matches(trim(message), '^[0-9\\s]+$'))"


@query(f"""WITH {_MSG_SQL}, o AS (SELECT event_id, user_id, message, {_VAGUE} AS vague FROM msg JOIN events USING (event_id)),
    l AS (SELECT *, last_value(CASE WHEN NOT vague THEN message END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS topic FROM o)
    SELECT event_id, vague, CASE WHEN vague AND topic IS NOT NULL THEN topic || ' ' || message ELSE message END AS rewritten, vague AND topic IS NULL AS clarify FROM l""")
def rewritten_queries(spark, sf_dir):
    """A message that says too little is read with the last one of its session that says enough; without one, it must be asked about."""
    own = messages(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    vague = (F.length(F.trim("message")) < 3) | F.trim("message").rlike(r"^[0-9\s]+$")
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = own.withColumn("vague", vague).withColumn("topic", F.last(F.when(~F.col("vague"), F.col("message")), ignorenulls=True).over(before))
    joined = F.when(F.col("vague") & F.col("topic").isNotNull(), F.concat("topic", F.lit(" "), "message")).otherwise(F.col("message"))
    return rows.select("event_id", "vague", joined.alias("rewritten"), (F.col("vague") & F.col("topic").isNull()).alias("clarify"))


@query(f"""WITH {_MSG_SQL}, s AS (SELECT event_id, regexp_matches(message, '不要|不想要|除了|不是|对比') AS complex, regexp_matches(message, '左右|大概|差不多') AND regexp_matches(message, '[0-9]') AS loose, length(trim(message)) < 3 AS short, regexp_matches(message, '下单|购物车|删掉|改成') AS acts FROM msg)
    SELECT event_id, array_to_string(list_filter([CASE WHEN complex THEN 'complex_preference' END, CASE WHEN loose THEN 'ambiguous_budget' END, CASE WHEN short THEN 'short' END, CASE WHEN acts THEN 'action' END], lambda x: x IS NOT NULL), ',') AS signals,
        CASE WHEN short THEN 'clarification' WHEN acts THEN 'deterministic' WHEN complex OR loose THEN 'planner' ELSE 'deterministic' END AS route FROM s""")
def route_signals(spark, sf_dir):
    """What in a message speaks for a plan, for an answer by rules, or for a question back."""
    m = F.col("message")
    complex_, loose, short, acts = m.rlike("不要|不想要|除了|不是|对比"), m.rlike("左右|大概|差不多") & m.rlike("[0-9]"), F.length(F.trim(m)) < 3, m.rlike("下单|购物车|删掉|改成")
    signals = F.array_compact(F.array(F.when(complex_, "complex_preference"), F.when(loose, "ambiguous_budget"), F.when(short, "short"), F.when(acts, "action")))
    route = F.when(short, "clarification").when(acts, "deterministic").when(complex_ | loose, "planner").otherwise("deterministic")
    return messages(spark, sf_dir).select("event_id", F.array_join(signals, ",").alias("signals"), route.alias("route"))


@query(f"""WITH {_MSG_SQL}, b AS (SELECT event_id, message, regexp_extract_all(message, '(?:预算|不超过)\\s*([0-9]+)', 1) AS hi, regexp_extract_all(message, '(?:高于|至少)\\s*([0-9]+)', 1) AS lo, regexp_extract_all(message, '(?:除了|不要|不想要)([^，。,.]+)', 1) AS no FROM msg),
    c AS (SELECT event_id, 'must' AS mode, 'max_price' AS kind, unnest(hi) AS value FROM b UNION ALL SELECT event_id, 'must', 'min_price', unnest(lo) FROM b UNION ALL SELECT event_id, 'must_not', 'exclude', unnest(no) FROM b
        UNION ALL SELECT event_id, 'should', 'keyword', unnest(list_filter(['大码', '三星', '红色', '蓝牙', '耳机'], lambda w: contains(message, w))) FROM b)
    SELECT event_id, mode, kind, value FROM c QUALIFY row_number() OVER (PARTITION BY event_id, kind, value ORDER BY mode) = 1""")
def message_constraints(spark, sf_dir):
    """The constraints of every message, each kind and value once: what must hold, what must not, what should."""
    every = lambda p: F.regexp_extract_all("message", F.lit(p), F.lit(1))
    wanted = F.filter(F.array(*map(F.lit, ("大码", "三星", "红色", "蓝牙", "耳机"))), lambda w: F.contains("message", w))
    kinds = (("must", "max_price", every(r"(?:预算|不超过)\s*([0-9]+)")), ("must", "min_price", every(r"(?:高于|至少)\s*([0-9]+)")), ("must_not", "exclude", every("(?:除了|不要|不想要)([^，。,.]+)")), ("should", "keyword", wanted))
    row = lambda mode, kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(mode).alias("mode"))
    made = F.flatten(F.array(*[F.transform(found, row(mode, kind)) for mode, kind, found in kinds]))
    each = messages(spark, sf_dir).select("event_id", F.explode(made).alias("c")).select("event_id", "c.kind", "c.value", "c.mode")
    return each.groupBy("event_id", "kind", "value").agg(F.min("mode").alias("mode")).select("event_id", "mode", "kind", "value")


@query("""WITH s AS (SELECT event_id, user_id, event_type || CASE WHEN value > 50 THEN '.' || CAST(CAST(floor(value / 10) AS INT) AS VARCHAR) ELSE '' END AS scope FROM events WHERE event_type <> 'error'),
    l AS (SELECT *, lag(scope) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s)
    SELECT event_id, scope, CASE WHEN before IS NULL THEN 'new' WHEN before = scope THEN 'same' WHEN starts_with(scope, before || '.') THEN 'refined' WHEN starts_with(before, scope || '.') THEN 'widened' WHEN split_part(scope, '.', 1) = split_part(before, '.', 1) THEN 'sibling' ELSE 'reset' END AS transition FROM l""")
def scope_refinements(spark, sf_dir):
    """How each turn's scope, a dotted name, follows from the one before: narrower, wider, beside it, or another."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    part = F.when(F.col("value") > 50, F.concat(F.lit("."), F.floor(F.col("value") / 10).cast("int").cast("string"))).otherwise("")
    own = e.select("event_id", "user_id", F.concat("event_type", part).alias("scope")).withColumn("before", F.lag("scope").over(Window.partitionBy("user_id").orderBy("event_id")))
    s, b, dot = F.col("scope"), F.col("before"), F.lit(".")
    root = lambda c: F.substring_index(c, ".", 1)
    kind = F.when(b.isNull(), "new").when(b == s, "same").when(F.startswith(s, F.concat(b, dot)), "refined").when(F.startswith(b, F.concat(s, dot)), "widened").when(root(s) == root(b), "sibling").otherwise("reset")
    return own.select("event_id", "scope", kind.alias("transition"))


@query("""WITH n AS (SELECT event_id, user_id, event_type, value, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts AS wait FROM events)
    SELECT event_id, user_id, CASE WHEN next IS NULL THEN 'pending' WHEN wait > INTERVAL '12 hours' THEN 'expired' WHEN next = 'purchase' THEN 'confirmed' WHEN next = 'error' THEN 'cancelled' ELSE 'superseded' END AS outcome, greatest(1, CAST(floor(value) AS BIGINT) % 4) AS quantity FROM n WHERE event_type = 'click'""")
def pending_purchases(spark, sf_dir):
    """What became of each purchase that waited for a yes: the user's next event decides, if it comes in time."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = table(spark, sf_dir, "events").withColumn("next", F.lead("event_type").over(by_user)).withColumn("late", F.lead("ts").over(by_user) > F.col("ts") + F.expr("INTERVAL 12 HOURS")).where("event_type = 'click'")
    outcome = F.when(F.col("next").isNull(), "pending").when(F.col("late"), "expired").when(F.col("next") == "purchase", "confirmed").when(F.col("next") == "error", "cancelled").otherwise("superseded")
    return own.select("event_id", "user_id", outcome.alias("outcome"), F.greatest(F.lit(1).cast("long"), F.floor("value") % 4).alias("quantity"))


@query("""WITH c AS (SELECT l_orderkey, list(DISTINCT p_name) AS names, arg_max(p_name, (l_shipdate, l_linenumber, p_name)) AS last, count(DISTINCT p_name) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
    q AS (SELECT *, CASE l_orderkey % 4 WHEN 0 THEN 'remove the bolt' WHEN 1 THEN 'remove number 2' WHEN 2 THEN 'change that one' ELSE 'remove the ring please' END AS message, list_sort(names) AS sorted FROM c),
    m AS (SELECT *, CAST(nullif(regexp_extract(message, 'number ([0-9]+)', 1), '') AS INT) AS place, list_filter(sorted, lambda x: contains(message, split_part(x, ' ', 2))) AS hits FROM q)
    SELECT l_orderkey, CASE WHEN place BETWEEN 1 AND n THEN sorted[place] WHEN len(hits) = 1 THEN hits[1] WHEN contains(message, 'that one') THEN last WHEN n = 1 THEN sorted[1] END AS target,
        CASE WHEN place BETWEEN 1 AND n THEN 'index' WHEN len(hits) = 1 THEN 'text' WHEN contains(message, 'that one') THEN 'last' WHEN n = 1 THEN 'sole' ELSE 'ask' END AS by FROM m""")
def cart_targets(spark, sf_dir):
    """Which line of a cart a message means: by number, by the one name that fits, the last touched, the only one; else it is asked."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    cart = table(spark, sf_dir, "lineitem").join(names, "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("name")).alias("sorted"), F.max_by("name", F.struct("l_shipdate", "l_linenumber", "name")).alias("last"))
    k = F.col("l_orderkey") % 4
    asked = cart.withColumn("message", F.when(k == 0, "remove the bolt").when(k == 1, "remove number 2").when(k == 2, "change that one").otherwise("remove the ring please"))
    place = F.nullif(F.regexp_extract("message", "number ([0-9]+)", 1), F.lit("")).cast("int")
    own = asked.withColumn("place", place).withColumn("hits", F.filter("sorted", lambda x: F.contains("message", F.split_part(x, F.lit(" "), F.lit(2))))).withColumn("n", F.size("sorted"))
    index, by_text, last, sole = F.col("place").between(1, F.col("n")), F.size("hits") == 1, F.contains("message", F.lit("that one")), F.col("n") == 1
    target = F.when(index, F.try_element_at("sorted", F.coalesce("place", F.lit(1)))).when(by_text, F.try_element_at("hits", F.lit(1))).when(last, F.col("last")).when(sole, F.try_element_at("sorted", F.lit(1)))
    return own.select("l_orderkey", target.alias("target"), F.when(index, "index").when(by_text, "text").when(last, "last").when(sole, "sole").otherwise("ask").alias("by"))


@query(f"""WITH RECURSIVE req AS (SELECT o_orderkey, o_custkey || '-' || CAST(o_orderdate AS DATE) AS key, o_custkey FROM orders), first AS (SELECT * FROM req QUALIFY row_number() OVER (PARTITION BY key ORDER BY o_orderkey) = 1),
    line AS (SELECT o_orderkey, o_custkey, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS q, sum(l_extendedprice) AS amount FROM first JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    moves AS (SELECT o_orderkey AS o, o_orderkey // 1000 AS day, 0 AS step, list({{'sku': l_partkey, 'q': q}}) AS items FROM line GROUP BY 1, 2), {fold_sql(400)},
    ok AS (SELECT o_orderkey, o_custkey, taken AS in_stock, sum(amount) AS amount FROM line JOIN answer ON o = o_orderkey GROUP BY 1, 2, 3)
    SELECT o_orderkey, in_stock, round(amount, 2) AS amount, CASE WHEN in_stock AND o_custkey % 3 = 0 AND amount >= 1000 THEN 50.0 ELSE 0.0 END AS coupon, round(CASE WHEN in_stock THEN amount - CASE WHEN o_custkey % 3 = 0 AND amount >= 1000 THEN 50 ELSE 0 END ELSE 0 END, 2) AS total FROM ok""")
def created_orders(spark, sf_dir):
    """Orders as requests: one of each key, taken in order if all their products are left (a refused one takes nothing), a coupon frozen, the total."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat_ws("-", "o_custkey", F.col("o_orderdate").cast("date")).alias("key"))
    first = o.groupBy("key").agg(F.min("o_orderkey").alias("o_orderkey"), F.min("o_custkey").alias("o_custkey")).drop("key")
    lines = first.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity", "l_extendedprice"), "o_orderkey")
    asked = lines.select(F.col("o_orderkey").alias("order_id"), F.floor(F.col("o_orderkey") / 1000).alias("at"), F.lit(None).cast("long").alias("gone_at"), F.col("l_partkey").alias("sku"), F.col("l_quantity").alias("quantity"))
    answers = orders.admitted(asked, asked.select("sku").distinct().withColumn("available", F.lit(400))).select(F.col("order_id").alias("o_orderkey"), F.col("accepted").alias("in_stock"))
    ok = lines.groupBy("o_orderkey", "o_custkey").agg(F.sum("l_extendedprice").alias("amount")).join(answers, "o_orderkey")
    coupon = F.when(F.col("in_stock") & (F.col("o_custkey") % 3 == 0) & (F.col("amount") >= 1000), 50.0).otherwise(0.0)
    return ok.select("o_orderkey", "in_stock", F.round("amount", 2).alias("amount"), coupon.alias("coupon"), F.round(F.when(F.col("in_stock"), F.col("amount") - coupon).otherwise(0.0), 2).alias("total"))


#: Types by alias, by two words that must both occur, and a word that may be misspelt.
_RULES = [("anvil", "tools.anvil"), ("gear", "parts.gear"), ("ring", "jewelry.ring")]
_PAIRS = [("small", "bolt", "parts.small_bolt"), ("large", "widget", "misc.large_widget")]
_LOOSE = [("panel", "parts.panel"), ("lever", "parts.lever")]
_NAME = "lower(CASE WHEN p_partkey % 4 = 1 THEN replace(p_name, 'e', 'a') ELSE p_name END)"


@query(f"""WITH n AS (SELECT p_partkey, {_NAME} AS name FROM part),
    w AS (SELECT name, bool_or(levenshtein(x, 'panel') <= 1) AS panel, bool_or(levenshtein(x, 'lever') <= 1) AS lever FROM (SELECT DISTINCT name, unnest(string_split(name, ' ')) AS x FROM n) GROUP BY 1),
    a AS (SELECT p_partkey, CASE {' '.join(f"WHEN regexp_matches(name, '(^|[^a-z0-9]){k}($|[^a-z0-9])') THEN '{v}'" for k, v in _RULES)} END AS by_alias, CASE {' '.join(f"WHEN contains(name, '{x}') AND contains(name, '{y}') THEN '{v}'" for x, y, v in _PAIRS)} END AS by_pair,
        CASE WHEN panel THEN 'parts.panel' WHEN lever THEN 'parts.lever' END AS by_edit FROM n JOIN w USING (name))
    SELECT p_partkey, coalesce(by_alias, by_pair, by_edit) AS type, CASE WHEN by_alias IS NOT NULL THEN 0.95 WHEN by_pair IS NOT NULL THEN 0.82 WHEN by_edit IS NOT NULL THEN 0.78 ELSE 0.0 END::DOUBLE AS confidence FROM a""")
def taxonomy_annotation(spark, sf_dir):
    """A product's type: by alias, else by two words that both occur, else by a word one edit away; and how sure that is."""
    key = F.col("p_partkey") % 4
    n = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.when(key == 1, F.replace("p_name", F.lit("e"), F.lit("a"))).otherwise(F.col("p_name"))).alias("name"))
    first = lambda pairs: F.coalesce(*[F.when(hit, F.lit(v)) for hit, v in pairs])
    near = lambda k: F.exists(F.split("name", " "), lambda w: t.within_edits(w, F.lit(k), 1) <= 1)
    own = n.select("name").distinct().select(
        "name",
        first([(t.alias_in(F.col("name"), F.lit(k)), v) for k, v in _RULES]).alias("by_alias"),
        first([(F.contains("name", F.lit(x)) & F.contains("name", F.lit(y)), v) for x, y, v in _PAIRS]).alias("by_pair"),
        first([(near(k), v) for k, v in _LOOSE]).alias("by_edit"),
    )
    sure = F.when(F.col("by_alias").isNotNull(), 0.95).when(F.col("by_pair").isNotNull(), 0.82).when(F.col("by_edit").isNotNull(), 0.78).otherwise(0.0)
    return n.join(own, "name").select("p_partkey", F.coalesce("by_alias", "by_pair", "by_edit").alias("type"), sure.alias("confidence"))


_SPELT = "CASE o_orderkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN replace(p_brand, '#', ' ') WHEN 2 THEN replace(p_brand, '#', '-') ELSE lower(replace(p_brand, '#', '')) END"


@query(f"""WITH alias AS (SELECT DISTINCT lower(unnest([b, replace(b, '#', ' '), replace(b, '#', '-'), replace(b, '#', '')])) AS alias, b AS canonical FROM (SELECT DISTINCT p_brand AS b FROM part)),
    asked AS (SELECT o_orderkey, 'order of ' || {_SPELT} || ' goods' AS message FROM orders JOIN part ON p_partkey = o_orderkey % 100 + 1),
    found AS (SELECT o_orderkey, canonical FROM asked JOIN alias ON alias = lower(regexp_extract(message, '(?i)brand[# -]?[0-9]+')))
    SELECT canonical AS brand, count(*) AS messages, CAST(min(o_orderkey) AS BIGINT) AS first FROM found GROUP BY 1""")
def brands_by_alias(spark, sf_dir):
    """Brands that messages name in any spelling: each brand's surface forms are a table, and mentions are joined to it."""
    p = table(spark, sf_dir, "part")
    forms = lambda c: F.array(*[F.lower(x) for x in (c, F.replace(c, F.lit("#"), F.lit(" ")), F.replace(c, F.lit("#"), F.lit("-")), F.replace(c, F.lit("#"), F.lit("")))])
    alias = p.select(F.col("p_brand").alias("canonical")).distinct().select("canonical", F.explode(F.array_distinct(forms(F.col("canonical")))).alias("alias"))
    k, b = F.col("o_orderkey") % 4, F.col("p_brand")
    spelt = F.when(k == 0, b).when(k == 1, F.replace(b, F.lit("#"), F.lit(" "))).when(k == 2, F.replace(b, F.lit("#"), F.lit("-"))).otherwise(F.lower(F.replace(b, F.lit("#"), F.lit(""))))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 100 + 1).alias("p_partkey")).join(p.select("p_partkey", "p_brand"), "p_partkey").select("o_orderkey", F.concat(F.lit("order of "), spelt, F.lit(" goods")).alias("message"))
    mention = F.lower(F.regexp_extract("message", "(?i)brand[# -]?[0-9]+", 0))
    return asked.select("o_orderkey", mention.alias("alias")).join(alias, "alias").groupBy(F.col("canonical").alias("brand")).agg(F.count(F.lit(1)).alias("messages"), F.min("o_orderkey").alias("first"))


@query(f"""WITH {answers_of._CLAIMS_SQL}, a AS (SELECT *, CASE WHEN list_contains(v, 'no_product') THEN 'fallback' WHEN list_has_any(v, ['absolute', 'promotion', 'business']) THEN 'regenerate' WHEN list_has_any(v, ['price', 'stock', 'status', 'ungrounded']) THEN 'auto_correct' ELSE 'pass' END AS action FROM broken),
    l AS (SELECT action, unnest(CASE WHEN len(v) = 0 THEN [0] ELSE list_distinct(list_transform(v, lambda x: CASE WHEN x = 'no_product' THEN 1 WHEN x IN ('price', 'stock', 'status', 'ungrounded') THEN 2 ELSE 3 END)) END) AS layer FROM a) SELECT action, CAST(layer AS INT) AS layer, count(*) AS answers FROM l GROUP BY 1, 2""")
def guard_layers(spark, sf_dir):
    """Answers by what was done with them and by the layer of the guard that found something; 0 where none did."""
    v = grounding.violations(F.col("answer"), [F.col("a"), F.col("b")])
    own = answers_of.answers(spark, sf_dir).select(v.alias("v")).select(grounding.action(F.col("v")).alias("action"), "v")
    layer = lambda x: F.when(x == "no_product", 1).when(x.isin("price", "stock", "status", "ungrounded"), 2).otherwise(3)
    return own.select("action", F.explode(F.when(F.size("v") == 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.transform("v", layer)))).alias("layer")).groupBy("action", "layer").agg(F.count(F.lit(1)).alias("answers"))


@query("""WITH j AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Verdict: {"violation": true, "product": "' || source || '"}' WHEN 1 THEN '{"violation": false, "product": ""}' ELSE 'cannot say' END AS judged, source FROM documents),
    p AS (SELECT doc_id, source, nullif(regexp_extract(judged, '\\{[^{}]*\\}'), '') AS found FROM j)
    SELECT source, count(*) AS judged, count(found) AS parsed, count(*) FILTER (json_extract_string(found, '$.violation') = 'true') AS violations, count(*) FILTER (json_extract_string(found, '$.product') = source) AS named FROM p GROUP BY 1""")
def judge_outputs(spark, sf_dir):
    """What a judge's outputs say, those that can be read: violations, and whether the product is named."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id") % 3
    said = F.when(n == 0, F.concat(F.lit('Verdict: {"violation": true, "product": "'), "source", F.lit('"}'))).when(n == 1, F.lit('{"violation": false, "product": ""}')).otherwise("cannot say")
    found = F.nullif(F.regexp_extract(said, r"\{[^{}]*\}", 0), F.lit(""))
    own = d.select("source", found.alias("found"))
    return own.groupBy("source").agg(
        F.count(F.lit(1)).alias("judged"), F.count("found").alias("parsed"), F.count(F.when(F.get_json_object("found", "$.violation") == "true", 1)).alias("violations"), F.count(F.when(F.get_json_object("found", "$.product") == F.col("source"), 1)).alias("named")
    )


@query("""WITH u AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events), m AS (SELECT max(ts) AS now FROM events)
    SELECT user_id, count(*) FILTER (ts < now - INTERVAL '7 days') AS expired, count(*) FILTER (ts >= now - INTERVAL '7 days') AS kept FROM u, m GROUP BY 1""")
def upload_expiry(spark, sf_dir):
    """How many of a user's uploads are older than a week, as of the last one of all."""
    e = table(spark, sf_dir, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    old = F.col("ts") < F.col("now") - F.expr("INTERVAL 7 DAYS")
    return e.select("user_id", "ts").crossJoin(now).groupBy("user_id").agg(F.count(F.when(old, 1)).alias("expired"), F.count(F.when(~old, 1)).alias("kept"))


@query("""WITH p AS (SELECT conv_id, turn, role, text, substr(sha256(role || '|' || substr(text, 1, 40)), 1, 16) AS print FROM conversations), f AS (SELECT conv_id, string_agg(print, '' ORDER BY turn) FILTER (turn <= 1) AS head FROM p GROUP BY 1)
    SELECT sha256(coalesce(head, '')) AS fingerprint, count(*) AS conversations, round((count(*) - 1) / count(*), 6) AS hit_rate FROM f GROUP BY 1""")
def prefix_fingerprints(spark, sf_dir):
    """Conversations with the same beginning, and how often a cache of beginnings would serve them."""
    p = table(spark, sf_dir, "conversations").where("turn <= 1").select("conv_id", "turn", F.substring(F.sha2(F.concat("role", F.lit("|"), F.substring("text", 1, 40)), 256), 1, 16).alias("print"))
    head = p.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "print"))), lambda x: x["print"]), "").alias("head"))
    every = table(spark, sf_dir, "conversations").select("conv_id").distinct().join(head, "conv_id", "left")
    n = F.count(F.lit(1))
    return every.groupBy(F.sha2(F.coalesce("head", F.lit("")), 256).alias("fingerprint")).agg(n.alias("conversations"), F.round((n - 1) / n, 6).alias("hit_rate"))


@query("""WITH t AS (SELECT conv_id, turn, CAST(floor(length(text) * 0.6) AS BIGINT) AS tokens FROM conversations), r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS behind, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place, sum(tokens) OVER (PARTITION BY conv_id) AS total FROM t)
    SELECT conv_id, count(*) AS turns, CAST(max(total) AS BIGINT) AS tokens, count(*) FILTER (total > 300 AND place > 4) AS compacted, CAST(coalesce(sum(tokens) FILTER (total <= 300 OR place <= 4), 0) AS BIGINT) AS left_tokens FROM r GROUP BY 1""")
def compacted_turns(spark, sf_dir):
    """Turns that a conversation over its budget of tokens gives up: all but the last four."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.length("text") * 0.6).alias("tokens"))
    rows = own.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).withColumn("total", F.sum("tokens").over(Window.partitionBy("conv_id")))
    gone = (F.col("total") > 300) & (F.col("place") > 4)
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("total").alias("tokens"), F.count(F.when(gone, 1)).alias("compacted"), F.coalesce(F.sum(F.when(~gone, F.col("tokens"))), F.lit(0).cast("long")).alias("left_tokens"))


@query("""WITH h AS (SELECT p_partkey, CAST('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) AS h, p_retailprice AS price FROM part)
    SELECT p_partkey, CASE WHEN h % 10 < 2 THEN 'minus_10' WHEN h % 10 < 5 AND price >= 950 THEN 'minus_50_of_900' ELSE 'none' END AS promotion, CASE h % 3 WHEN 0 THEN 'paper' WHEN 1 THEN 'electronic' ELSE 'both' END AS invoice, CASE WHEN price >= 940 THEN 'free' ELSE 'paid' END AS shipping,
        round(CASE WHEN h % 10 < 2 THEN price * 0.9 WHEN h % 10 < 5 AND price >= 950 THEN price - 50 ELSE price END, 4) AS to_pay FROM h""")
def derived_policies(spark, sf_dir):
    """Policies that follow from a product's digest and price, and the price that they make."""
    own = table(spark, sf_dir, "part").select("p_partkey", t.hash_number(F.col("p_partkey").cast("string")).alias("h"), F.col("p_retailprice").alias("price"))
    ten, fifty = F.col("h") % 10 < 2, (F.col("h") % 10 < 5) & (F.col("price") >= 950)
    return own.select(
        "p_partkey", F.when(ten, "minus_10").when(fifty, "minus_50_of_900").otherwise("none").alias("promotion"), F.when(F.col("h") % 3 == 0, "paper").when(F.col("h") % 3 == 1, "electronic").otherwise("both").alias("invoice"),
        F.when(F.col("price") >= 940, "free").otherwise("paid").alias("shipping"), F.round(F.when(ten, F.col("price") * 0.9).when(fifty, F.col("price") - 50).otherwise(F.col("price")), 4).alias("to_pay"),
    )


@query("""WITH c AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) % 6 AS template, count(*) AS n, min(ts) AS claimed FROM events WHERE event_type = 'signup' GROUP BY 1, 2), tpl AS (SELECT unnest(range(6)) AS template, unnest(['off', 'off', 'percent', 'percent', 'ship', 'ship']) AS kind, unnest([100, 50, 90, 80, 0, 0]) AS value)
    SELECT user_id, template, kind, value, CASE WHEN n > 1 THEN 'used' WHEN claimed < TIMESTAMP '2024-01-10' THEN 'expired' ELSE 'open' END AS state, row_number() OVER (PARTITION BY user_id ORDER BY claimed DESC, template) AS place FROM c JOIN tpl USING (template) WHERE value > 0""")
def own_coupons(spark, sf_dir):
    """A user's coupons with their templates, those that are worth something, the newest first."""
    tpl = F.broadcast(spark.createDataFrame(list(zip(range(6), ("off", "off", "percent", "percent", "ship", "ship"), (100, 50, 90, 80, 0, 0), strict=True)), "template int, kind string, value int"))  # a literal
    c = table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy("user_id", (F.get_json_object("props", "$.k").cast("int") % 6).alias("template")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("claimed"))
    state = F.when(F.col("n") > 1, "used").when(F.col("claimed") < F.lit("2024-01-10").cast("timestamp_ntz"), "expired").otherwise("open")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("claimed"), "template"))
    return c.join(tpl, "template").where("value > 0").select("user_id", "template", "kind", "value", state.alias("state"), place.cast("long").alias("place"))
