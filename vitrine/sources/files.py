"""Readers and writers of catalogues, logs and tables."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.text import haystack

PRODUCT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("sub_category", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("stock", T.LongType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("description", T.StringType()),
    ]
)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of products with a fixed schema, missing prices and stock as 0."""
    return spark.read.schema(PRODUCT).json(path, multiLine=True).fillna({"price": 0.0, "stock": 0})


def documents_from_products(products: DataFrame) -> DataFrame:
    """id, text and metadata of each product."""
    fields = [F.col(c) for c in ("name", "category", "sub_category", "brand", "tags", "description") if c in products.columns]
    return products.select("id", haystack(*fields).alias("text"), F.struct(*[c for c in products.columns if c != "id"]).alias("metadata"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lines of JSON; malformed ones are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_jsonl_tail(spark: SparkSession, path: str, schema: T.StructType | str, order: str, last: int) -> DataFrame:
    return read_jsonl(spark, path, schema).orderBy(F.desc(order)).limit(last)


def append_jsonl(rows: DataFrame, path: str, message: str, most: int = 500) -> None:
    """Append rows as lines of JSON, with long messages cut as the log's format asks for."""
    rows.withColumn(message, F.substring(message, 1, most)).write.mode("append").json(path)


def read_products(spark: SparkSession, path: str, locale: str, ids: list[str] | None = None) -> DataFrame:
    """Parquet rows of one locale; the conditions reach the scan."""
    rows = spark.read.parquet(path).where(F.col("product_locale") == locale)
    return rows.where(F.col("product_id").isin(ids)) if ids is not None else rows


def upserted(current: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows after changes: of each key the one that is latest, changes before what was there."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__new"), F.desc(order)))
    return both.withColumn("__place", last).where("__place = 1").drop("__place", "__new")


def write_index(postings: DataFrame, path: str) -> None:
    """An index is its postings, by term ranges, so a term's lookup reads few files."""
    postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The postings that ``write_index`` wrote; a condition on the term passes over the files and row groups without it."""
    return spark.read.parquet(path)


def zipped_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The JSON members of zip archives, a task for each archive."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in sorted(n for n in archive.namelist() if n.endswith(".json")):
                        data = json.loads(archive.read(name))
                        lines = [json.dumps(x) for x in (data if isinstance(data, list) else [data])]
                        yield pa.RecordBatch.from_pydict({"member": [name] * len(lines), "line": lines})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "member string, line string")
    return raw.select("member", F.from_json("line", schema).alias("row")).select("member", "row.*")
