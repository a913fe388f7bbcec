"""Evaluation queries: list metrics over nearest neighbours, agreement, rates, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import evaluation, vectors
from vitrine.session import table

from .registry import query

_LIST = """
    e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    pairs AS (SELECT q.vec_id AS query_id, q.label AS q_label, d.vec_id AS doc_id, d.label AS d_label,
                     round(list_cosine_similarity(q.v, d.v), 6) AS cosine, round(1 - list_distance(q.v, d.v) / sqrt(len(q.v)), 6) AS rmse
              FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
    cosine_list AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rank FROM pairs QUALIFY rank <= 10),
    rmse_list AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rmse DESC, doc_id) AS rank FROM pairs QUALIFY rank <= 10),
    relevant AS (SELECT query_id, q_label, count(*) FILTER (q_label = d_label) AS n_relevant FROM pairs GROUP BY 1, 2)
"""
_METRICS = """
    metrics_{0} AS (
        SELECT r.query_id, r.q_label, coalesce(hits, 0) AS hits, n_relevant, round(coalesce(hits, 0) / n_relevant, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
               round(CASE WHEN n_relevant > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg
        FROM relevant r LEFT JOIN (
            SELECT query_id, count(*) FILTER (q_label = d_label) AS hits, min(rank) FILTER (q_label = d_label) AS first, sum(CASE WHEN q_label = d_label THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
            FROM {0}_list GROUP BY 1) USING (query_id))
"""


def _lists(spark, sf_dir, measure="cosine"):
    """ranked lists with both labels; relevant counts."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0")
    found = vectors.nearest(rows, asked, 10, measure=measure).withColumnRenamed("vec_id", "doc_id")
    labels = rows.select("vec_id", "label")
    ranked = found.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id").join(
        labels.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("d_label")), "doc_id"
    )
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    relevant = asked.join(sizes, "label").select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"), (F.col("n") - 1).alias("n_relevant"))
    return ranked, relevant


def _metrics(spark, sf_dir, measure="cosine"):
    ranked, relevant = _lists(spark, sf_dir, measure)
    judged = ranked.where("q_label = d_label").select("query_id", "doc_id")
    return evaluation.list_metrics(ranked.select("query_id", "doc_id", "rank"), judged, relevant.drop("q_label"), 10).join(relevant.select("query_id", "q_label"), "query_id")


@query(f"WITH {_LIST}, {_METRICS.format('cosine')} SELECT query_id, hits, n_relevant, recall, mrr, ndcg FROM metrics_cosine")
def ranked_list_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).drop("q_label")


@query(f"WITH {_LIST}, {_METRICS.format('cosine')} SELECT count(*) AS queries, round(avg(recall), 4) AS recall_at_10, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg_at_10 FROM metrics_cosine")
def recall_mrr_ndcg(spark, sf_dir):
    return _metrics(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("recall"), 4).alias("recall_at_10"), F.round(F.avg("mrr"), 4).alias("mrr"), F.round(F.avg("ndcg"), 4).alias("ndcg_at_10")
    )


@query(f"""WITH {_LIST}, graded AS (SELECT *, greatest(0, 3 - abs(q_label - d_label)) AS gain FROM pairs),
    got AS (SELECT query_id, sum((pow(2, greatest(0, 3 - abs(q_label - d_label))) - 1) / log2(rank + 1)) AS dcg FROM cosine_list GROUP BY 1),
    best AS (SELECT query_id, sum((pow(2, gain) - 1) / log2(place + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS place FROM graded QUALIFY place <= 10) GROUP BY 1)
    SELECT query_id, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM best JOIN got USING (query_id)""")
def ndcg_graded(spark, sf_dir):
    """Gain 2^grade - 1; the ideal list is made from how many rows have each grade, not from the rows."""
    ranked, relevant = _lists(spark, sf_dir)
    grade = lambda a, b: F.greatest(F.lit(0), 3 - F.abs(F.col(a) - F.col(b)))
    got = ranked.groupBy("query_id").agg(F.sum((F.pow(2.0, grade("q_label", "d_label")) - 1) / F.log2(F.col("rank") + 1)).alias("dcg"))
    sizes = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("d_label")).agg(F.count(F.lit(1)).alias("n"))
    # Ten labels a query: a row for each label's rows, at most ten of a grade count.
    counts = relevant.join(sizes, F.abs(F.col("q_label") - F.col("d_label")) <= 3)
    each = counts.select("query_id", F.explode(F.array_repeat(grade("q_label", "d_label"), F.least(F.col("n") - F.when(F.col("q_label") == F.col("d_label"), 1).otherwise(0), F.lit(10)).cast("int"))).alias("gain"))
    gains = each.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("gain"), asc=False), 1, 10).alias("gains"))
    # Places short of ten have gain 0 and add nothing.
    ideal = F.aggregate(
        F.zip_with("gains", F.sequence(F.lit(1), F.size("gains")), lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 1)), F.lit(0.0), lambda acc, x: acc + x
    )
    return got.join(gains, "query_id").select("query_id", F.round(F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"))


@query(f"""WITH {_LIST}, {_METRICS.format('cosine')}, {_METRICS.format('rmse')},
    arms AS (SELECT 'cosine' AS arm, * FROM metrics_cosine UNION ALL SELECT 'rmse', * FROM metrics_rmse)
    SELECT coalesce(arm, 'all') AS arm, coalesce(CAST(q_label AS BIGINT), -1) AS label, count(*) AS queries, round(avg(recall), 4) AS recall, round(avg(ndcg), 4) AS ndcg
    FROM arms GROUP BY ROLLUP (arm, q_label)""")
def arm_type_rollup(spark, sf_dir):
    arms = _metrics(spark, sf_dir).withColumn("arm", F.lit("cosine")).unionByName(_metrics(spark, sf_dir, "rmse").withColumn("arm", F.lit("rmse")))
    return arms.rollup("arm", "q_label").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("ndcg"), 4).alias("ndcg")).select(
        F.coalesce("arm", F.lit("all")).alias("arm"), F.coalesce(F.col("q_label").cast("long"), F.lit(-1)).alias("label"), "queries", "recall", "ndcg"
    )


@query(f"""WITH {_LIST}, {_METRICS.format('cosine')}
    SELECT row_number() OVER (ORDER BY ndcg, recall, n_relevant DESC, query_id) AS place, query_id, ndcg, recall, n_relevant FROM metrics_cosine QUALIFY place <= 20""")
def miss_examples(spark, sf_dir):
    """The twenty worst lists."""
    worst = _metrics(spark, sf_dir).orderBy("ndcg", "recall", F.desc("n_relevant"), "query_id").limit(20)
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("ndcg", "recall", F.desc("n_relevant"), "query_id"))  # twenty rows
    return worst.select(place.cast("long").alias("place"), "query_id", "ndcg", "recall", "n_relevant")


@query(f"""WITH {_LIST}, hit AS (SELECT d_label AS label, count(*) AS hits FROM cosine_list WHERE q_label = d_label GROUP BY 1),
    total AS (SELECT q_label AS label, CAST(sum(n_relevant) AS BIGINT) AS total FROM relevant GROUP BY 1)
    SELECT CAST(label AS BIGINT) AS label, coalesce(hits, 0) AS hits, total, round(coalesce(hits, 0) / total, 6) AS recall FROM total LEFT JOIN hit USING (label)""")
def label_recall(spark, sf_dir):
    ranked, relevant = _lists(spark, sf_dir)
    hits = ranked.where("q_label = d_label").groupBy(F.col("d_label").alias("label")).agg(F.count(F.lit(1)).alias("hits"))
    total = relevant.groupBy(F.col("q_label").alias("label")).agg(F.sum("n_relevant").alias("total"))
    hit = F.coalesce("hits", F.lit(0))
    return total.join(hits, "label", "left").select(F.col("label").cast("long").alias("label"), hit.cast("long").alias("hits"), "total", F.round(hit / F.col("total"), 6).alias("recall"))


@query(f"""WITH {_LIST}, params AS (SELECT * FROM (VALUES (1, 0.1), (3, 0.1), (5, 0.1), (10, 0.1), (5, 0.2), (10, 0.2), (10, 0.3)) t(k, least))
    SELECT CAST(k AS BIGINT) AS k, CAST(least AS DOUBLE) AS least, count(DISTINCT query_id) FILTER (rank <= k AND cosine >= least) AS covered,
           count(*) FILTER (rank <= k AND cosine >= least) AS shown, count(*) FILTER (rank = 1 AND cosine >= least AND q_label = d_label) AS top1
    FROM params CROSS JOIN cosine_list GROUP BY 1, 2""")
def param_sweep(spark, sf_dir):
    """Every parameter pair over one set of lists; the pairs are a literal of seven rows."""
    ranked, _ = _lists(spark, sf_dir)
    pairs = [(1, 0.1), (3, 0.1), (5, 0.1), (10, 0.1), (5, 0.2), (10, 0.2), (10, 0.3)]
    both = ranked.withColumn("p", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(t).alias("least")) for k, t in pairs])))
    ok = F.col("score") >= F.col("p.least")
    inside = ok & (F.col("rank") <= F.col("p.k"))
    return both.groupBy("p").agg(
        F.countDistinct(F.when(inside, F.col("query_id"))).alias("covered"),
        F.count(F.when(inside, 1)).alias("shown"),
        F.count(F.when(ok & (F.col("rank") == 1) & (F.col("q_label") == F.col("d_label")), 1)).alias("top1"),
    ).select("p.k", "p.least", "covered", "shown", "top1")


@query("""WITH s AS (SELECT count(*) AS n, avg(CAST(quality = 1 - toxic AS INT)) AS o, avg(quality) AS a, avg(1 - toxic) AS b FROM labels),
    k AS (SELECT *, a * b + (1 - a) * (1 - b) AS e FROM s)
    SELECT n, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa,
           CASE WHEN (o - e) / (1 - e) < 0.2 THEN 'slight' WHEN (o - e) / (1 - e) < 0.4 THEN 'fair' WHEN (o - e) / (1 - e) < 0.6 THEN 'moderate' WHEN (o - e) / (1 - e) < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM k""")
def cohens_kappa(spark, sf_dir):
    """Two judges of a document: its quality label, and that it is not toxic."""
    return evaluation.kappa(table(spark, sf_dir, "labels").withColumn("calm", 1 - F.col("toxic")), "quality", "calm")


@query("""SELECT source, count(*) AS answers, round(avg(toxic), 6) AS violation_rate, round(avg(CASE WHEN toxic = 1 AND quality = 0 THEN 1.0 ELSE 0.0 END), 6) AS guard_rate, CAST(sum(toxic) AS BIGINT) AS violations
    FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def violation_rates(spark, sf_dir):
    own = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    both = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), 1.0).otherwise(0.0)
    return own.groupBy("source").agg(F.count(F.lit(1)).alias("answers"), F.round(F.avg("toxic"), 6).alias("violation_rate"), F.round(F.avg(both), 6).alias("guard_rate"), F.sum("toxic").alias("violations"))


@query("""WITH a AS (SELECT user_id, round(sum(value) FILTER (event_type = 'view'), 4) AS plain, round(sum(value) FILTER (event_type = 'click'), 4) AS routed,
        count(*) FILTER (event_type = 'view') AS plain_calls, count(*) FILTER (event_type = 'click') AS routed_calls FROM events GROUP BY 1)
    SELECT *, round((plain - routed) / plain, 6) AS reduction FROM a""")
def token_cost_reduction(spark, sf_dir):
    """Cost of two arms side by side, and what one saves."""
    pivoted = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click"]).agg(F.sum("value").alias("cost"), F.count(F.lit(1)).alias("calls"))
    own = pivoted.select(
        "user_id", F.round("view_cost", 4).alias("plain"), F.round("click_cost", 4).alias("routed"), F.coalesce("view_calls", F.lit(0)).alias("plain_calls"), F.coalesce("click_calls", F.lit(0)).alias("routed_calls")
    )
    return own.withColumn("reduction", F.round(F.try_divide(F.col("plain") - F.col("routed"), F.col("plain")), 6))


@query("""SELECT lang, count(*) AS outputs, round(avg(CASE WHEN regexp_matches(html, '</html>') THEN 1.0 ELSE 0.0 END), 6) AS parse_rate, round(avg(CASE WHEN length(html) > 2000 THEN 1.0 ELSE 0.0 END), 6) AS complete_rate,
        round(avg(CASE WHEN contains(html, '<h1>') THEN 1.0 ELSE 0.0 END), 6) AS non_empty_rate
    FROM (SELECT html, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang FROM pages) GROUP BY 1""")
def validity_rates(spark, sf_dir):
    """Of structured outputs: how many parse, are complete, are not empty."""
    rows = table(spark, sf_dir, "pages").select("html", F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"))
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("outputs"),
        rate(F.contains("html", F.lit("</html>"))).alias("parse_rate"),
        rate(F.length("html") > 2000).alias("complete_rate"),
        rate(F.contains("html", F.lit("<h1>"))).alias("non_empty_rate"),
    )


@query(f"""WITH {_LIST}, best AS (SELECT query_id, q_label, max(cosine) FILTER (q_label = d_label) AS same_best, max(cosine) AS best, count(*) FILTER (q_label = d_label) AS hits FROM cosine_list GROUP BY 1, 2),
    c AS (SELECT CASE WHEN hits > 0 AND same_best < best THEN 'ranking_error' WHEN hits > 0 THEN 'none' WHEN best >= 0.9 THEN 'near_duplicate' WHEN best < 0.35 THEN 'query_ambiguity' ELSE 'recall_missing' END AS cause FROM best)
    SELECT cause, count(*) AS cases, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM c GROUP BY 1""")
def bad_case_attribution(spark, sf_dir):
    """The first cause that holds, and each cause's share."""
    ranked, _ = _lists(spark, sf_dir)
    same = F.col("q_label") == F.col("d_label")
    best = ranked.groupBy("query_id").agg(F.max(F.when(same, F.col("score"))).alias("same_best"), F.max("score").alias("best"), F.count(F.when(same, 1)).alias("hits"))
    cause = (
        F.when((F.col("hits") > 0) & (F.col("same_best") < F.col("best")), "ranking_error")
        .when(F.col("hits") > 0, "none")
        .when(F.col("best") >= 0.9, "near_duplicate")
        .when(F.col("best") < 0.35, "query_ambiguity")
        .otherwise("recall_missing")
    )
    counts = best.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("cases"))
    total = counts.agg(F.sum("cases").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("cause", "cases", F.round(F.col("cases") / F.col("total"), 6).alias("share"))  # one row


@query("""SELECT user_id, round(avg(1 / log2(p + 2)), 6) AS click_dcg, count(*) AS clicks
    FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS p FROM events WHERE event_type = 'click') GROUP BY 1""")
def click_dcg_mean(spark, sf_dir):
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("p"))
    return clicks.groupBy("user_id").agg(F.round(F.avg(1 / F.log2(F.col("p") + 2)), 6).alias("click_dcg"), F.count(F.lit(1)).alias("clicks"))


@query("""SELECT p_brand, p_type, n, round_even(list_sort(prices)[len(prices) // 2 + 1] * 1.1, -1) AS budget
    FROM (SELECT p_brand, p_type, count(*) AS n, list(p_retailprice) AS prices FROM part GROUP BY 1, 2 HAVING count(*) >= 2)""")
def evaluation_set_budgets(spark, sf_dir):
    """Groups of two products or more, with a budget of 1.1 times the upper median price, to tens."""
    own = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY p_retailprice DESC)").alias("upper")).where("n >= 2")
    return own.select("p_brand", "p_type", "n", F.bround(F.col("upper") * 1.1, -1).alias("budget"))


