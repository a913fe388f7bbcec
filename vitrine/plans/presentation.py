"""Presentation queries: templates, markdown, comparisons, bundle checks, descriptions of filters, metrics of requests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.functions.text import search_tokens_sql
from vitrine.operators import language as nlu
from vitrine.operators import ranking
from vitrine.session import table

from .language import _MSG_SQL, messages
from .registry import query

_MARKED = "'# ' || p_name || chr(10) || '- **' || p_brand || '** at `' || p_type || '`' || chr(10) || '* see [' || p_name || '](http://x/' || p_partkey || ')'"


@query(rf"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MARKED}, '\*\*|__|`', '', 'g'), '(?m)^#+\s*', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^[-*]\s+', '', 'g') AS plain FROM part""")
def plain_answers(spark, sf_dir):
    """Answers without their markdown."""
    key = F.col("p_partkey").cast("string")
    marked = F.concat(F.lit("# "), "p_name", F.lit("\n- **"), "p_brand", F.lit("** at `"), "p_type", F.lit("`\n* see ["), "p_name", F.lit("](http://x/"), key, F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", nlu.plain_text(marked).alias("plain"))


@query("""SELECT p_partkey, regexp_replace(replace(replace('We have {name} by {brand}{unknown_tail} for you', '{name}', p_name), '{brand}', p_brand), '\\{[a-z_]+\\}', '', 'g') AS text FROM part""")
def rendered_templates(spark, sf_dir):
    """A template with its names filled in and unknown ones taken out."""
    return table(spark, sf_dir, "part").select("p_partkey", nlu.rendered("We have {name} by {brand}{unknown_tail} for you", name=F.col("p_name"), brand=F.col("p_brand")).alias("text"))


@query(rf"""WITH m AS (SELECT a.p_partkey, CASE WHEN a.p_partkey % 3 = 0 THEN 'Compare ' || a.p_name || ' vs ' || b.p_name || '?' WHEN a.p_partkey % 3 = 1 THEN a.p_name || ' versus ' || b.p_name ELSE 'show me ' || a.p_name END AS text FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
    t AS (SELECT p_partkey, lower(text) AS text, '^(?:compare\s+)?(.+?)\s+(?:vs\.?|versus|and|和|跟)\s+(.+?)[?.!]*$' AS p FROM m)
    SELECT p_partkey, trim(regexp_extract(text, '^(?:compare\s+)?(.+?)\s+(?:vs\.?|versus|and|和|跟)\s+(.+?)[?.!]*$', 1)) AS a, trim(regexp_extract(text, '^(?:compare\s+)?(.+?)\s+(?:vs\.?|versus|and|和|跟)\s+(.+?)[?.!]*$', 2)) AS b FROM t""")
def compared_terms(spark, sf_dir):
    """Both sides of a comparison that a message asks for; empty where it asks for none."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("Compare "), "p_name", F.lit(" vs "), "other", F.lit("?"))).when(k == 1, F.concat("p_name", F.lit(" versus "), "other")).otherwise(F.concat(F.lit("show me "), "p_name"))
    terms = nlu.comparison_terms(text)
    return both.select("p_partkey", terms[0].alias("a"), terms[1].alias("b"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price, l_quantity AS quantity, l_discount AS discount FROM lineitem),
    w AS (SELECT *, min(price) OVER w AS low, max(quantity) OVER w AS most, max(discount) OVER w AS best, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY l_orderkey))
    SELECT l_orderkey, l_linenumber, l_partkey, price, array_to_string(list_filter([CASE WHEN price = low THEN 'price' END, CASE WHEN quantity = most THEN 'quantity' END, CASE WHEN discount = best THEN 'discount' END], lambda x: x IS NOT NULL), ',') AS strengths,
        array_to_string(list_filter([CASE WHEN price > low * 1.5 THEN 'dear' END, CASE WHEN discount = 0 AND best > 0 THEN 'no_discount' END], lambda x: x IS NOT NULL), ',') AS trade_offs FROM w WHERE n > 1""")
def comparison_cards(spark, sf_dir):
    """Lines of an order side by side: in which dimension each is the best, and what it gives up."""
    w = Window.partitionBy("l_orderkey")
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    own = d.withColumn("low", F.min("price").over(w)).withColumn("most", F.max("quantity").over(w)).withColumn("best", F.max("discount").over(w)).withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1")
    named = lambda *cases: F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in cases])), ",")
    strengths = named((F.col("price") == F.col("low"), "price"), (F.col("quantity") == F.col("most"), "quantity"), (F.col("discount") == F.col("best"), "discount"))
    given = named((F.col("price") > F.col("low") * 1.5, "dear"), ((F.col("discount") == 0) & (F.col("best") > 0), "no_discount"))
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "price", strengths.alias("strengths"), given.alias("trade_offs"))


@query("""WITH b AS (SELECT l_orderkey, count(*) AS cards, count(DISTINCT l_partkey) AS distinct_cards, sum(l_extendedprice) AS total, count(DISTINCT l_linenumber % 3) AS slots FROM lineitem GROUP BY 1)
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN cards IS NULL THEN 'empty' END, CASE WHEN total > o_totalprice THEN 'over_budget' END, CASE WHEN cards > distinct_cards THEN 'duplicate' END], lambda x: x IS NOT NULL), ',') AS violations,
        array_to_string(list_filter([CASE WHEN slots < 3 THEN 'missing_slot' END, CASE WHEN total < o_totalprice * 0.2 THEN 'far_below_budget' END], lambda x: x IS NOT NULL), ',') AS warnings FROM orders LEFT JOIN b ON l_orderkey = o_orderkey""")
def bundle_grounding(spark, sf_dir):
    """What is wrong with a bundle (an order's lines within its total), and what is only worth a warning."""
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("cards"), F.countDistinct("l_partkey").alias("distinct_cards"), F.sum("l_extendedprice").alias("total"), F.countDistinct(F.col("l_linenumber") % 3).alias("slots"))
    named = lambda *cases: F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in cases])), ",")
    wrong = named((F.col("cards").isNull(), "empty"), (F.col("total") > F.col("o_totalprice"), "over_budget"), (F.col("cards") > F.col("distinct_cards"), "duplicate"))
    warned = named((F.col("slots") < 3, "missing_slot"), (F.col("total") < F.col("o_totalprice") * 0.2, "far_below_budget"))
    return table(spark, sf_dir, "orders").join(b, "o_orderkey", "left").select("o_orderkey", wrong.alias("violations"), warned.alias("warnings"))


@query(f"""WITH {_MSG_SQL}, p AS (SELECT event_id, regexp_extract(message, '预算([0-9]+)', 1) AS hi, regexp_extract(message, '高于([0-9]+)', 1) AS lo, regexp_matches(message, '耳机') AS ear FROM msg)
    SELECT event_id, array_to_string(list_filter([CASE WHEN hi <> '' THEN 'max_price=' || hi END, CASE WHEN lo <> '' THEN 'min_price=' || lo END, CASE WHEN ear THEN 'type=earphones' END], lambda x: x IS NOT NULL), '; ') AS described FROM p""")
def described_filters(spark, sf_dir):
    """The filters that a message sets, as a line for a log."""
    hi, lo = F.regexp_extract("message", "预算([0-9]+)", 1), F.regexp_extract("message", "高于([0-9]+)", 1)
    parts = F.array_compact(F.array(F.when(hi != "", F.concat(F.lit("max_price="), hi)), F.when(lo != "", F.concat(F.lit("min_price="), lo)), F.when(F.contains("message", F.lit("耳机")), "type=earphones")))
    return messages(spark, sf_dir).select("event_id", F.array_join(parts, "; ").alias("described"))


@query("""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), q AS (SELECT user_id, k, count(*) FILTER (event_type = 'view') AS shown, avg(value) FILTER (event_type = 'view') AS latency, count(*) FILTER (event_type = 'click') AS clicks FROM e GROUP BY 1, 2)
    SELECT k, CAST(sum(shown) AS BIGINT) AS shown, round(avg(latency), 6) AS latency, round(count(*) FILTER (clicks > 0 AND shown > 0) / nullif(count(*) FILTER (shown > 0), 0), 6) AS ctr FROM q GROUP BY 1""")
def query_statistics(spark, sf_dir):
    """Of each query how often it was shown, how long it took, and in what share of its showings to a user it was clicked."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    seen, hit = F.col("event_type") == "view", F.col("event_type") == "click"
    q = e.groupBy("user_id", "k").agg(F.count(F.when(seen, 1)).alias("shown"), F.avg(F.when(seen, F.col("value"))).alias("latency"), F.count(F.when(hit, 1)).alias("clicks"))
    share = F.try_divide(F.count(F.when((F.col("clicks") > 0) & (F.col("shown") > 0), 1)), F.count(F.when(F.col("shown") > 0, 1)))
    return q.groupBy("k").agg(F.sum("shown").alias("shown"), F.round(F.avg("latency"), 6).alias("latency"), F.round(share, 6).alias("ctr"))


@query("""SELECT user_id, count(*) AS requests, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS hit_rate, round(avg(value), 4) AS mean,
    round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.99), 4) AS p99, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 0) * 3600, 4) AS per_hour FROM events GROUP BY 1""")
def request_metrics(spark, sf_dir):
    """A user's requests: rates, mean, middle and late ones, and how many an hour."""
    seconds = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1_000_000
    n = F.count(F.lit(1))
    share = lambda kind: F.round(F.count(F.when(F.col("event_type") == kind, 1)) / n, 6)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        n.alias("requests"), share("error").alias("error_rate"), share("view").alias("hit_rate"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.percentile("value", 0.5), 4).alias("p50"), F.round(F.percentile("value", 0.99), 4).alias("p99"), F.round(F.try_divide(n, seconds) * 3600, 4).alias("per_hour")
    )


@query("""WITH e AS (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) % 10 + 1 AS position FROM events)
    SELECT user_id, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS click_rate, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS buy_rate, round(avg(position) FILTER (event_type = 'click'), 2) AS click_position, round(avg(1 / log2(position + 1)) FILTER (event_type = 'click'), 6) AS click_dcg FROM e GROUP BY 1""")
def quality_snapshot(spark, sf_dir):
    """Rates of a user's clicks and purchases, where clicks were, and their discounted gain."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.get_json_object("props", "$.k").cast("int") % 10 + 1).alias("position"))
    n, click = F.count(F.lit(1)), F.col("event_type") == "click"
    return e.groupBy("user_id").agg(
        F.round(F.count(F.when(click, 1)) / n, 6).alias("click_rate"), F.round(F.count(F.when(F.col("event_type") == "purchase", 1)) / n, 6).alias("buy_rate"),
        F.round(F.avg(F.when(click, F.col("position"))), 2).alias("click_position"), F.round(F.avg(F.when(click, 1 / F.log2(F.col("position") + 1))), 6).alias("click_dcg"),
    )


_FILTERED = "(SELECT doc_id, text FROM documents WHERE lang = 'en' AND n_chars >= 200)"


@query(f"""WITH dtok AS (SELECT doc_id, {search_tokens_sql('text')} AS t FROM {_FILTERED}), stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dtok), post AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dtok),
    tf AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM post GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), asked AS (SELECT item_id, unnest({search_tokens_sql('text')}) AS term FROM benchmark),
    s AS (SELECT item_id AS query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5) + 1), 0.25) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN tf USING (term) JOIN df USING (term) CROSS JOIN stats GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""")
def bm25_filtered(spark, sf_dir):
    """BM25 over the rows that a filter leaves; the filter reaches the scan."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en' AND n_chars >= 200")
    found = ranking.scored(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 5)
    return found.where("route = 'bm25'").select("query_id", "doc_id", "score", "rank")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus FROM orders), l AS (SELECT l_partkey, o_orderstatus, sum(l_quantity) AS q FROM lineitem JOIN o ON o_orderkey = l_orderkey GROUP BY 1, 2)
    SELECT l_partkey, CAST(1000 - coalesce(sum(q) FILTER (o_orderstatus <> 'F'), 0) AS BIGINT) AS available, CAST(coalesce(sum(q) FILTER (o_orderstatus = 'O'), 0) AS BIGINT) AS reserved, CAST(coalesce(sum(q) FILTER (o_orderstatus = 'P'), 0) AS BIGINT) AS sold, CAST(coalesce(sum(q) FILTER (o_orderstatus = 'F'), 0) AS BIGINT) AS given_back FROM l GROUP BY 1""")
def stock_after_orders(spark, sf_dir):
    """Stock as signed changes: open orders reserve, paid ones sell, cancelled ones give back what they took."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    l = table(spark, sf_dir, "lineitem").join(o, "l_orderkey")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("l_quantity"))), F.lit(0.0)).cast("long")
    s = F.col("o_orderstatus")
    return l.groupBy("l_partkey").agg((F.lit(1000) - F.coalesce(F.sum(F.when(s != "F", F.col("l_quantity"))), F.lit(0.0))).cast("long").alias("available"), total(s == "O").alias("reserved"), total(s == "P").alias("sold"), total(s == "F").alias("given_back"))


@query("""WITH p AS (SELECT doc_id, split_part(text, 'FAQ', 1) AS body FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' FAQ: how?' ELSE text END AS text FROM documents))
    SELECT doc_id, length(body) AS chars, len(list_filter(string_split_regex(body, '[.!?。！？\\n]+'), lambda x: length(trim(x)) > 0)) AS sentences FROM p""")
def described_sentences(spark, sf_dir):
    """A description up to its questions and answers, and how many sentences it has."""
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" FAQ: how?"))).otherwise(F.col("text"))
    body = F.split_part(text, F.lit("FAQ"), F.lit(1))
    return d.select("doc_id", F.length(body).cast("long").alias("chars"), F.size(F.filter(F.split(body, r"[.!?。！？\n]+"), lambda x: F.length(F.trim(x)) > 0)).cast("long").alias("sentences"))
