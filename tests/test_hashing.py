"""Vectors of hashed terms against plain Python, and neighbours against all pairs."""

import hashlib
import math

from pyspark.sql import functions as F

from vitrine.operators import hashing

TEXTS = ["red wireless headset", None, "", "a", "red wireless headset", "Blue WIRED headset headset", "无线耳机 red", "x1 x2 x3 x4", "headset"]


def plain(terms, places):
    vector = [0.0] * places
    for term in terms:
        digest = hashlib.sha256(term.encode()).digest()
        vector[int.from_bytes(digest[:4], "little") % places] += (1 if digest[4] % 2 == 0 else -1) * (1 + min(len(term), 8) / 8)
    return vector


def rows(spark, parts=3):
    return spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "red")], "doc_id long, text string").withColumn("places", F.lit("clash")).repartition(parts)


def test_vectors(spark):
    terms = F.split(F.coalesce("text", F.lit("")), " ")
    for places in (7, 384):
        found = {r.doc_id: r for r in hashing.embedded(rows(spark), "doc_id", terms, places=places).withColumn("norm", hashing.norm(F.col("eighths"))).collect()}
        assert len(found) == len(TEXTS) + 1
        for i, text in enumerate(TEXTS):
            want = plain(set((text or "").split(" ")), places)
            got = [0.0] * places
            for p, e in zip(found[i].places, found[i].eighths, strict=True):
                got[p] = e / 8
            assert got == want and found[i].places == sorted(found[i].places) and 0 not in found[i].eighths
            assert math.isclose(found[i].norm, math.sqrt(sum(x * x for x in want)))


def test_neighbours(spark, monkeypatch):
    """All rows as queries, in one block and in many: the order by cosine, then id."""
    own = hashing.embedded(rows(spark), "doc_id")
    dense = {r.doc_id: dict(zip(r.places, r.eighths, strict=True)) for r in own.collect()}
    size = {i: math.sqrt(sum(e * e for e in v.values())) for i, v in dense.items()}
    cosine = lambda a, b: sum(e * dense[b].get(p, 0) for p, e in dense[a].items()) / (size[b] * size[a]) if size[a] and size[b] else 0.0
    ids = [i for i in dense if i is not None]
    want = {(q, d, r) for q in ids for r, d in enumerate(sorted((d for d in ids if d != q), key=lambda d: (-cosine(q, d), d))[:4], 1)}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in hashing.nearest(own, own, 4).collect()} == want
    monkeypatch.setattr(hashing, "BLOCK_BYTES", 384 * 8 * 2)
    monkeypatch.setattr(hashing, "CHUNK", 2)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in hashing.nearest(own, own, 4).collect()} == want
    assert hashing.nearest(own.limit(0), own, 4).count() == 0 and hashing.nearest(own, own.limit(0), 4).count() == 0


def test_neighbours_bounded_first(monkeypatch):
    """Cosines that are equal or close, vectors without length and repeated ids: as by exact products, whether or not a bound of some rows is known."""
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(3)
    monkeypatch.setattr(hashing, "CHUNK", 64)
    monkeypatch.setattr(hashing, "QUERIES", 16)
    dense = draw.integers(-1, 2, (700, 12)) * draw.choice([1, 1, 1000], (700, 1))
    dense[::50] = 0
    ids = np.append(np.arange(650), draw.integers(0, 650, 50))

    def lists(rows):
        at = [np.flatnonzero(r) for r in rows]
        offsets = pa.array(np.append(0, np.cumsum([len(a) for a in at])).astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v).astype(np.int32))) for v in (at, [r[a] for r, a in zip(rows, at, strict=True)])]

    size = np.sqrt((dense.astype(float) ** 2).sum(1))
    queries = np.arange(0, 650, 3)
    dot, sizes = (dense[queries] @ dense.T).astype(float), size[queries, None] * size
    score = np.divide(dot, sizes, out=np.zeros_like(dot), where=sizes > 0)
    want = {int(ids[q]): sorted((-s, int(d)) for s, d in zip(score[n], ids, strict=True) if d != ids[q])[:5] for n, q in enumerate(queries)}
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(ids[some]), *lists(dense[some])], names=["doc_id", "places", "eighths"])

    def found(some, least=None):
        out = {}
        for b in hashing._scorer(ids[queries], *lists(dense[queries]), 5, "doc_id", 12, True, least)(iter([batch(some)])):
            for q, d, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.setdefault(q, []).append((-s, d))
        return {q: sorted(v) for q, v in out.items()}

    half = found(np.arange(0, 700, 2))
    assert found(np.arange(700)) == want
    assert found(np.arange(700), np.array([-half[int(i)][-1][0] for i in ids[queries]])) == want


def test_texts_are_read_once(spark, tmp_path, monkeypatch):
    """Queries in many blocks: texts are cut into terms once, and neighbours stay those of all pairs."""
    from vitrine.plans.vectors import hashing_neighbours

    docs = [(i, f"red word{i % 7} word{i % 11} {'blue' * (i % 3)}") for i in range(600)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(tuple(r) for r in hashing_neighbours(spark, str(tmp_path)).collect())
    calls, real, read = [], hashing.embedded, spark.sparkContext.accumulator(0)

    def embedded(rows, *rest, **named):
        calls.append(rows)

        def counted(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return real(rows.mapInArrow(counted, rows.schema), *rest, **named)

    monkeypatch.setattr(hashing, "embedded", embedded)
    monkeypatch.setattr(hashing, "BLOCK_BYTES", 384 * 8 * 3)
    assert sorted(tuple(r) for r in hashing_neighbours(spark, str(tmp_path)).collect()) == want and len(want) == 120
    assert len(calls) == 1 and read.value == 600


def test_models_of_copied_products(spark, tmp_path, monkeypatch):
    """Copies of products add nothing to what is multiplied: the ten lowest ids of a text and one query a name."""
    import duckdb

    from vitrine.plans import SQL
    from vitrine.plans.vectors import hashing_models

    names = [f"{a} {b}" for a in ("big", "old", "red") for b in ("ring", "bolt")]
    parts = [(i, names[i % 6] if i % 97 != 1 else None, f"Brand#{i % 2}", "SMALL") for i in range(1500)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    sizes, real = [], hashing.nearest

    def nearest(rows, queries, *rest, **named):
        sizes.append((rows.count(), queries.count()))
        return real(rows, queries, *rest, **named)

    monkeypatch.setattr(hashing, "nearest", nearest)
    got = sorted(tuple(r) for r in hashing_models(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(db.execute(SQL["hashing_models"]).fetchall())
    assert max(r for r, _ in sizes) <= 14 * 10 and max(q for _, q in sizes) <= 7


def test_models_ask_each_product(spark, tmp_path):
    """Means are over all products, not over those whose id is divisible by 50: of 60 products only the ten lowest ids of one name are found."""
    import duckdb

    from vitrine.plans import SQL
    from vitrine.plans.vectors import hashing_models

    parts = [(i, f"odd word{i}" if i > 40 else "big ring", "Brand", "SMALL") for i in range(1, 61)] + [(None, "odd", "Brand", "SMALL")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.model: r for r in hashing_models(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet' WHERE p_partkey IS NOT NULL")
    assert sorted(tuple(r) for r in got.values()) == sorted(db.execute(SQL["hashing_models"]).fetchall())
    assert {r.queries for r in got.values()} == {60} and got["hashed 384"].recall == 0.5


def test_memory_of_a_task(spark):
    """2,000 rows at once and 3,000 queries: one matrix of 1,024 rows has 24 MB, and there were several."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(7)
    lists = lambda n: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(draw.integers(0, 16, n).astype(np.int32)))
    q, rows = (lists(3000), lists(3000)), pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), lists(2000), lists(2000)], names=["doc_id", "places", "eighths"])
    tracemalloc.start()
    found = list(hashing._scorer(np.arange(3000), *q, 10, "doc_id", 16, True)(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in found) == 30000 and peak < 50e6
