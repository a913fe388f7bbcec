"""Retrieval queries: index, BM25, lexical overlap, nearest neighbours, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions.text import haystack, hash_number, search_tokens, search_tokens_sql, token_set
from vitrine.operators import blockindex, ranking, vectors
from vitrine.session import scratch, table

from .registry import query

_TOKENS = search_tokens_sql("text")
#: SQL of the BM25 scores, as common table expressions.
BM25_SQL = f"""
    dtok AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
    tok AS (SELECT doc_id, unnest(t) AS term FROM dtok),
    stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM dtok),
    dl AS (SELECT doc_id, len(t) AS dl FROM dtok),
    post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    asked AS (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark),
    bm25 AS (
        SELECT item_id AS query_id, p.doc_id,
               round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 0.25) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM asked JOIN post p USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN stats GROUP BY 1, 2),
    lexical AS (
        SELECT item_id AS query_id, doc_id, CAST(count(*) AS DOUBLE) AS score
        FROM (SELECT DISTINCT * FROM asked) JOIN post USING (term) GROUP BY 1, 2),
    bm25_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25 QUALIFY rank <= 50),
    lexical_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lexical QUALIFY rank <= 50)
"""
_FUSED = """, joined AS (
        SELECT query_id, doc_id, coalesce(a.score, 0) AS a, coalesce(b.score, 0) AS b
        FROM bm25_top a FULL JOIN lexical_top b USING (query_id, doc_id))"""


def _ranked(top: str, score: str, k: int = 10) -> str:
    return f"""WITH {BM25_SQL} {_FUSED}, scored AS (SELECT query_id, doc_id, {score} AS score FROM {top} {'GROUP BY 1, 2' if 'sum(' in score else ''})
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {k}"""


def _scored(spark, sf_dir, pool):
    return ranking.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", pool)


def _route(scored, name):
    return scored.where(F.col("route") == name).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM bm25_top WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _route(_scored(spark, sf_dir, 10), "bm25")


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM bm25_top WHERE rank <= 10")
def stored_index_topk(spark, sf_dir):
    """BM25 from an index that is written once; a search opens the folders of its terms and scores the lanes that can reach the best."""
    path = scratch(spark, "index")
    blockindex.write(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return blockindex.search(spark, path, table(spark, sf_dir, "benchmark"), "item_id", "text", 10)


@query(f"""WITH {BM25_SQL.replace('FROM benchmark', "FROM (SELECT item_id, array_to_string(list_slice(string_split(text, ' '), 3, 5), ' ') AS text FROM benchmark)")}
    SELECT query_id, doc_id, score, rank FROM bm25_top WHERE rank <= 10""")
def stored_index_phrases(spark, sf_dir):
    """Short queries of three words against the stored index."""
    path = scratch(spark, "index")
    blockindex.write(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    short = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 3, 3), " ").alias("text"))
    return blockindex.search(spark, path, short, "item_id", "text", 10)


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM lexical_top WHERE rank <= 10")
def lexical_document_topk(spark, sf_dir):
    return _route(_scored(spark, sf_dir, 10), "overlap")


@query(f"""WITH {BM25_SQL}
    SELECT term, df, CAST(ctf AS BIGINT) AS ctf, round(greatest(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 0.25), 4) AS idf
    FROM (SELECT term, count(*) AS df, sum(tf) AS ctf FROM post GROUP BY 1) CROSS JOIN stats""")
def bm25_term_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    per_term = ranking.postings(docs, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))
    stats = F.broadcast(ranking.index_stats(docs, "doc_id", "text"))  # one row
    return per_term.crossJoin(stats).select("term", "df", "ctf", F.round(ranking.idf(F.col("n_docs"), F.col("df")), 4).alias("idf"))


@query(f"""WITH {BM25_SQL} SELECT n_docs, (SELECT CAST(sum(dl) AS BIGINT) FROM dl) AS total_len, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS n_terms FROM stats""")
def bm25_index_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    terms = docs.select(F.explode(search_tokens(F.col("text"))).alias("term")).agg(F.countDistinct("term").alias("n_terms"))
    return ranking.index_stats(docs, "doc_id", "text").crossJoin(terms).select("n_docs", "total_len", F.round("avgdl", 6).alias("avgdl"), "n_terms")


@query(f"""
    SELECT doc_id, term, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
    FROM (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {_TOKENS} AS t FROM documents))
    GROUP BY 1, 2""")
def postings_positions(spark, sf_dir):
    return ranking.postings(table(spark, sf_dir, "documents"), "doc_id", "text", positions=True).select("doc_id", "term", "tf", "positions")


_CHANGED = "(SELECT doc_id, text FROM documents WHERE doc_id % 50 <> 0 UNION ALL SELECT doc_id, source || ' ' || lang || ' replaced text of ' || source FROM documents WHERE doc_id % 100 = 0 UNION ALL SELECT -1 - item_id, text FROM benchmark)"


@query(f"""WITH {BM25_SQL.replace('FROM documents', f'FROM {_CHANGED}')}
    SELECT term, df, round(greatest(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 0.25), 4) AS idf, n_docs FROM df CROSS JOIN stats""")
def incremental_index(spark, sf_dir):
    """Document frequencies after documents were deleted, replaced and added.

    The index's frequencies are changed by those of the documents that changed: what the old texts of deleted and
    replaced ones counted is taken off, what the new texts count is put on. Nothing else is tokenised again.
    """
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    index = ranking.frequencies(docs, "doc_id", "text")
    gone = docs.where("doc_id % 50 = 0").select("doc_id", "text")
    words = F.concat("source", F.lit(" "), "lang", F.lit(" replaced text of "), "source")
    new = docs.where("doc_id % 100 = 0").select("doc_id", words.alias("text")).unionByName(items.select((-1 - F.col("item_id")).alias("doc_id"), "text"))
    return ranking.changed(index, gone, new, "doc_id", "text").select("term", "df", F.round(ranking.idf(F.col("n_docs"), F.col("df")), 4).alias("idf"), "n_docs")


@query(f"""WITH {BM25_SQL.replace('FROM documents', 'FROM documents WHERE doc_id % 50 <> 0')}
    SELECT term, df, round(greatest(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 0.25), 4) AS idf, n_docs FROM df CROSS JOIN stats""")
def incremental_index_delete(spark, sf_dir):
    """Document frequencies after a delete of every document whose id divides by 50: its counts are taken off."""
    docs = table(spark, sf_dir, "documents")
    gone = docs.where("doc_id % 50 = 0").select("doc_id", "text")
    left = ranking.changed(ranking.frequencies(docs, "doc_id", "text"), gone, None, "doc_id", "text")
    return left.select("term", "df", F.round(ranking.idf(F.col("n_docs"), F.col("df")), 4).alias("idf"), "n_docs")


@query("""
    WITH q AS (SELECT p_partkey AS query_id, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS qt FROM part WHERE p_partkey % 50 = 0),
    d AS (SELECT p_partkey AS doc_id, lower(concat_ws(' ', p_name, p_brand, p_type)) AS hay, lower(p_name) AS title,
                 list_distinct(regexp_extract_all(lower(concat_ws(' ', p_name, p_brand, p_type)), '[a-z0-9]+')) AS dt FROM part),
    s AS (SELECT query_id, doc_id, CAST(len(list_intersect(qt, dt)) + 2 * len(list_filter(qt, lambda x: length(x) > 1 AND contains(hay, x)))
                 + 6 * len(list_filter(qt, lambda x: length(x) > 1 AND contains(title, x))) AS DOUBLE) AS score FROM q, d)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10""")
def lexical_overlap_topk(spark, sf_dir):
    """Products for each query product's name, by shared tokens and substrings.

    A token of a query that is inside a text is inside one of the text's tokens, so the two vocabularies
    are matched first, by the parts of each token, and postings are joined by what matched. Scores are worked out once for
    each distinct pair of query text and product text, and only the ten least ids of a text can be
    in a list of ten, so equal products don't multiply.
    """
    part = table(spark, sf_dir, "part")
    asked = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.lower("p_name").alias("q"))
    shown = part.select(F.col("p_partkey").alias("doc_id"), haystack(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("hay"), F.lower("p_name").alias("title"))
    terms = asked.select("q").distinct().select("q", F.explode(token_set(F.col("q"))).alias("term"))
    texts = shown.select("hay", "title").distinct()
    in_title = F.array_contains(token_set(F.col("title")), F.col("token"))
    have = texts.select("hay", "title", F.explode(token_set(F.col("hay"))).alias("token")).select("hay", "title", "token", in_title.alias("in_title"))
    size = F.length("token")
    parts = have.select("token").distinct().select("token", F.explode(F.sequence(F.lit(1), size)).alias("i")).select("token", F.explode(F.transform(F.sequence(F.lit(1), size - F.col("i") + 1), lambda n: F.substring("token", F.col("i"), n))).alias("term"))
    matched = parts.distinct().join(terms.select("term").distinct(), "term")
    found = have.join(matched, "token").groupBy("hay", "title", "term").agg(
        F.max((F.col("token") == F.col("term")).cast("int")).alias("same"), F.max(F.col("in_title").cast("int")).alias("in_title")
    )
    longer = (F.length("term") > 1).cast("int")
    points = found.select("hay", "title", "term", (F.col("same") + longer * (2 + 6 * F.col("in_title"))).alias("points")).where("points > 0")
    scored = points.join(terms, "term").groupBy("q", "hay", "title").agg(F.sum("points").cast("double").alias("score"))
    first = ranking.top_k(shown.select("hay", "title", "doc_id", F.lit(0.0).alias("score")), 10, by="hay").select("hay", "doc_id")
    best = ranking.top_k(scored.join(first, "hay").select("q", "doc_id", "score"), 10, by="q")
    return asked.join(best, "q").select("query_id", "doc_id", "score", "rank")


_KNN = """
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, d.vec_id, round({}, 6) AS score
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) d JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0) q ON d.vec_id <> q.vec_id)
    QUALIFY rank <= 10"""


@query(_KNN.format("list_cosine_similarity(q.e, d.e)"))
def knn_cosine_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 50 = 0"), 10)


@query(_KNN.format("1 - list_distance(q.e, d.e) / sqrt(len(q.e))"))
def knn_signature_rmse(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 50 = 0"), 10, measure="rmse")


@query(_ranked("(SELECT query_id, doc_id, rank FROM bm25_top UNION ALL SELECT query_id, doc_id, rank FROM lexical_top)", "round(sum(1.0::DOUBLE / (60 + rank)), 6)"))
def rrf_fusion(spark, sf_dir):
    return ranking.top_k(ranking.rrf(_scored(spark, sf_dir, 50)), 10)


@query(_ranked("joined", "round(0.5 * least(greatest(a / 50, 0), 1) + 0.5 * b / (1 + b), 6)"))
def weighted_fusion(spark, sf_dir):
    both = ranking.both(_scored(spark, sf_dir, 50))
    return ranking.top_k(both.select("query_id", "doc_id", F.round(0.5 * ranking.clipped(F.col("a") / 50) + 0.5 * F.col("b") / (1 + F.col("b")), 6).alias("score")), 10)


@query(_ranked("joined", "round(greatest(least(greatest(a / 50, 0), 1), b / (1 + b)), 6)"))
def max_fusion(spark, sf_dir):
    both = ranking.both(_scored(spark, sf_dir, 50))
    return ranking.top_k(both.select("query_id", "doc_id", F.round(F.greatest(ranking.clipped(F.col("a") / 50), F.col("b") / (1 + F.col("b"))), 6).alias("score")), 10)


_MODEL = "((doc_id * 7919 + query_id * 104729) % 1000 / 1000.0::DOUBLE)"


@query(_ranked("joined", f"round(0.7 * {_MODEL} + 0.15 / (1 + exp(-a)) + 0.15 / (1 + exp(-b)), 6)"))
def ensemble_score(spark, sf_dir):
    """Three signals: a model's score, which is an input column (here a number of the pair), and both routes, squashed."""
    both = ranking.both(_scored(spark, sf_dir, 50))
    score = 0.7 * _model() + 0.15 * ranking.sigmoid(F.col("a")) + 0.15 * ranking.sigmoid(F.col("b"))
    return ranking.top_k(both.select("query_id", "doc_id", F.round(score, 6).alias("score")), 10)


@query(_ranked("joined", f"round(0.6 * {_MODEL} + 0.2 * least(greatest(a / 50, 0), 1) + 0.2 * b / (1 + b), 6)"))
def light_ensemble_score(spark, sf_dir):
    """The light variant: the routes are clipped, not squashed."""
    both = ranking.both(_scored(spark, sf_dir, 50))
    score = 0.6 * _model() + 0.2 * ranking.clipped(F.col("a") / 50) + 0.2 * F.col("b") / (1 + F.col("b"))
    return ranking.top_k(both.select("query_id", "doc_id", F.round(score, 6).alias("score")), 10)


def _model():
    return (F.col("doc_id") * 7919 + F.col("query_id") * 104729) % 1000 / 1000.0


@query(_ranked("joined", "round(a + b, 6)", 20))
def raw_sum_candidates(spark, sf_dir):
    """The pool that a model would re-rank: 20 of the largest raw sum of both routes."""
    both = ranking.both(_scored(spark, sf_dir, 50))
    return ranking.top_k(both.select("query_id", "doc_id", F.round(F.col("a") + F.col("b"), 6).alias("score")), 20)


@query("""
    WITH t AS (SELECT p_partkey, unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', p_name, p_brand, p_type)), '[a-z0-9]+'))) AS term FROM part),
    h AS (SELECT p_partkey, term, sha256(term) AS x FROM t),
    b AS (SELECT p_partkey, (CAST('0x' || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) AS BIGINT)) % 384 AS bucket,
                 CASE WHEN CAST('0x' || substr(x, 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END * (1 + least(length(term), 8) / 8.0::DOUBLE) AS w FROM h),
    v AS (SELECT p_partkey, bucket, sum(w) AS w FROM b GROUP BY 1, 2)
    SELECT p_partkey, count(*) AS buckets, round(sqrt(sum(w * w)), 6) AS norm, round(max(abs(w)) / sqrt(sum(w * w)), 6) AS largest FROM v GROUP BY 1""")
def hashing_embedding_norms(spark, sf_dir):
    """A hashing embedding of each product: little-endian digest buckets, signed weights by token length."""
    part = table(spark, sf_dir, "part")
    each = part.select("p_partkey", F.explode(token_set(haystack(F.col("p_name"), F.col("p_brand"), F.col("p_type")))).alias("term")).withColumn("x", F.sha2("term", 256))
    swapped = F.concat(*[F.substring("x", i, 2) for i in (7, 5, 3, 1)])
    bucket = F.conv(swapped, 16, 10).cast("long") % 384
    sign = F.when(F.conv(F.substring("x", 9, 2), 16, 10).cast("long") % 2 == 0, 1).otherwise(-1)
    vector = each.groupBy("p_partkey", bucket.alias("bucket")).agg(F.sum(sign * (1 + F.least(F.length("term"), F.lit(8)) / 8.0)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
    return vector.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("buckets"), F.round(norm, 6).alias("norm"), F.round(F.max(F.abs("w")) / norm, 6).alias("largest"))


@query("""SELECT lang, source, count(*) AS docs, substr(sha256(concat_ws('|', lang, source)), 1, 32) AS cache_key,
    CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) AS bucket FROM documents GROUP BY ALL""")
def cache_keys(spark, sf_dir):
    """Keys of cached results: a digest of the sorted filters."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")).select(
        "lang", "source", "docs", F.substring(F.sha2(F.concat_ws("|", "lang", "source"), 256), 1, 32).alias("cache_key"), hash_number(F.col("source"), "md5").alias("bucket")
    )
