"""The pipeline over tables with nothing in them, and over nulls, repeats, long texts and clashing columns."""

from pyspark.sql import functions as F

import corpus_pipeline

ITEMS = "item_id long, text string"


def tables(docs, labels, items, folder):
    for name, frame in (("documents", docs), ("labels", labels), ("benchmark", items)):
        frame.coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_empty_tables(spark, no_docs, odd_labels, tmp_path):
    folder = tables(no_docs, odd_labels.limit(0), spark.createDataFrame([], ITEMS), tmp_path)
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_odd_tables(spark, odd_docs, odd_labels, tmp_path):
    """Every stage but the last returns the columns of documents; what comes out are whole documents of the input."""
    odd = odd_docs.withColumn("node", F.lit("n")).withColumn("row", F.lit(1)).withColumn("h", F.lit(2)).withColumn("label", F.lit(3))
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six seven eight nine ten"), (None, "hi")], ITEMS)
    folder = tables(odd, odd_labels, items, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.schema(odd.schema).parquet(_stored(stage(spark, docs, folder), f"{tmp_path}/{name}"))
    assert docs.count() <= odd.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    found = pieces.select("doc_id", "length").collect()
    assert {r.doc_id for r in found} <= {r.doc_id for r in odd.select("doc_id").collect()}
    assert all(r.length > 0 for r in found)


def _stored(frame, path):
    assert {"doc_id", "text", "lang", "source", "n_chars", "key", "score", "node", "row", "h", "label"} == set(frame.columns)
    frame.write.parquet(path)
    return path
