"""The corpus pipeline: from raw documents to packed training sequences.

Stages, in order: documents that the quality classifier rejects go; of each class of near
duplicates the document of the least id stays; passages that repeat across documents stay in
the first of them; documents that hold a benchmark item go; what is left is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the
last return the columns of ``docs``, whatever they are. A stage's docstring refers to its
operator's module for nulls, ties, repeated rows and empty tables; none of them drops a row
for another reason than its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import classifier, decontaminate, minhash, packing, suffixes
from vitrine.llm.queries import tokenizer
from vitrine.llm.shared import written
from vitrine.session import table

#: SQL can express neither the classifier nor the packing; tests compare run() to brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what scores 0.3 or more, by a model fitted to the quality labels of these documents."""
    model = classifier.trained(docs, table(spark, sf_dir, "labels"), "quality")
    return classifier.filtered(docs, model, least=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return minhash.first_of_each(docs, least=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words or more that an earlier document has out of the texts."""
    return suffixes.without_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window that matches a benchmark item."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"), least=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their tokens."""
    return packing.packed(docs, tokenizer("word_bpe_49k.json"), end_id=2, window=4096)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
