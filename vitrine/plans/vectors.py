"""Vectors of hashed terms: the vectors themselves, neighbours among texts, and what fewer places cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions.text import haystack, search_tokens, search_tokens_sql
from vitrine.operators import hashing
from vitrine.session import kept, table

from .registry import query

_SIGNED = """CASE WHEN CAST('0x' || substr(x, 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END * (8 + least(length(term), 8))"""
_NUMBER = """CAST('0x' || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) AS BIGINT)"""


def _vectors(name: str, id: str, text: str, rows: str, places: str = "384") -> str:
    """Tables ``name`` (id, place, e) and ``name``_size (id, size) of the rows, empty vectors too; size is the length in eighths."""
    return f"""{name}_h AS (SELECT id, term, sha256(term) AS x FROM (SELECT {id} AS id, unnest(list_distinct({search_tokens_sql(text)})) AS term FROM {rows})),
    {name} AS (SELECT id, {_NUMBER} % {places} AS place, CAST(sum({_SIGNED}) AS BIGINT) AS e FROM {name}_h GROUP BY 1, 2 HAVING e <> 0),
    {name}_size AS (SELECT r.id, coalesce(sqrt(CAST(sum(e * e) AS DOUBLE)), 0) AS size FROM (SELECT {id} AS id FROM {rows}) r LEFT JOIN {name} USING (id) GROUP BY 1)"""


@query(f"""WITH {_vectors('v', 'doc_id', "coalesce(text, '')", 'documents')}
    SELECT id AS doc_id, count(place) AS places, coalesce(string_agg(place || ':' || e, ',' ORDER BY place), '') AS vector, round(any_value(size) / 8, 6) AS norm FROM v_size LEFT JOIN v USING (id) GROUP BY 1""")
def hashing_vectors(spark, sf_dir):
    """The vector of each document, as place:eighths in order, and its length."""
    own = hashing.embedded(table(spark, sf_dir, "documents"), "doc_id")
    shown = F.transform(F.arrays_zip("places", "eighths"), lambda p: F.concat_ws(":", p["places"].cast("string"), p["eighths"].cast("string")))
    return own.select("doc_id", F.size("places").cast("long").alias("places"), F.concat_ws(",", shown).alias("vector"), F.round(hashing.norm(F.col("eighths")), 6).alias("norm"))


@query(f"""WITH {_vectors('v', 'doc_id', "coalesce(text, '')", 'documents')},
    dots AS (SELECT q.id AS query_id, d.id, CAST(sum(q.e * d.e) AS DOUBLE) AS dot FROM v q JOIN v d USING (place) WHERE q.id % 50 = 0 AND d.id <> q.id GROUP BY 1, 2),
    s AS (SELECT q.id AS query_id, d.id AS doc_id, CASE WHEN q.size * d.size > 0 THEN coalesce(dot, 0) / (d.size * q.size) ELSE 0 END AS score
        FROM v_size q JOIN v_size d ON q.id % 50 = 0 AND d.id <> q.id LEFT JOIN dots ON dots.query_id = q.id AND dots.id = d.id)
    SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def hashing_neighbours(spark, sf_dir):
    """The ten nearest documents of each whose id is divisible by 50."""
    # Texts are read and cut into terms once, not for each block of queries.
    own = kept(hashing.embedded(table(spark, sf_dir, "documents"), "doc_id"), "vectors")
    found = hashing.nearest(own, own.where("doc_id % 50 = 0"), 10, first=16)
    return found.withColumn("score", F.round("score", 6))


_HAY = "lower(concat_ws(' ', p_name, p_brand, p_type))"


def _model(n: int) -> str:
    return f"""{_vectors(f'd{n}', 'p_partkey', _HAY, 'part', str(n))}, {_vectors(f'q{n}', 'p_partkey', 'p_name', '(SELECT * FROM part WHERE p_partkey IS NOT NULL)', str(n))},
    o{n} AS (SELECT q.id AS query_id, d.id, CAST(sum(q.e * d.e) AS DOUBLE) AS dot FROM q{n} q JOIN d{n} d USING (place) GROUP BY 1, 2),
    s{n} AS (SELECT q.id AS query_id, d.id, CASE WHEN q.size * d.size > 0 THEN coalesce(dot, 0) / (d.size * q.size) ELSE 0 END AS score
        FROM q{n}_size q CROSS JOIN d{n}_size d LEFT JOIN o{n} o ON o.query_id = q.id AND o.id = d.id),
    r{n} AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s{n} QUALIFY rank <= 10),
    m{n} AS (SELECT 'hashed {n}' AS model, id AS query_id, rank FROM q{n}_size LEFT JOIN (SELECT query_id AS id, rank FROM r{n} WHERE query_id = r{n}.id) USING (id))"""


@query(f"""WITH {_model(64)}, {_model(384)}
    SELECT model, count(*) AS queries, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END), 4) AS recall, round(avg(coalesce(1 / rank, 0)), 4) AS mrr, round(avg(coalesce(1 / log2(rank + 1), 0)), 4) AS ndcg
    FROM (SELECT * FROM m64 UNION ALL SELECT * FROM m384) GROUP BY 1""")
def hashing_models(spark, sf_dir):
    """Two vector models compared: each product is asked by its name, the product itself is what should come back among ten."""
    part = table(spark, sf_dir, "part")
    asked = part.where("p_partkey IS NOT NULL")
    # Products of one text have one vector, and queries of one name one list: each name is asked once, by its lowest id.
    text = haystack(F.col("p_name"), F.col("p_brand"), F.col("p_type"))
    rows, names = hashing.least_copies(part, text, 10, "p_partkey"), hashing.least_copies(asked, F.col("p_name"), 1, "p_partkey")
    found = []
    for places in (64, 384):
        near = hashing.nearest(
            hashing.embedded(rows, "p_partkey", search_tokens(text), places=places), hashing.embedded(names, "p_partkey", text="p_name", places=places), 10, "p_partkey", places, skip_self=False
        )
        named = near.join(names.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("name")), "query_id")
        own = asked.join(named.select("name", F.col("p_partkey").alias("near"), "rank"), F.col("p_name").eqNullSafe(F.col("name")) & (F.col("p_partkey") == F.col("near")), "left")
        found.append(own.select(F.lit(f"hashed {places}").alias("model"), "rank"))
    mean = lambda value: F.round(F.avg(F.coalesce(value, F.lit(0.0))), 4)
    rank = F.col("rank")
    return found[0].unionByName(found[1]).groupBy("model").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg(rank.isNotNull().cast("double")), 4).alias("recall"), mean(1 / rank).alias("mrr"), mean(1 / F.log2(rank + 1)).alias("ndcg")
    )
