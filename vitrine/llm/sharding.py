"""Two-pass external shuffle into shards.

Pass 1 scatters the records: the shard is the one of the highest seeded hash of (doc_id, shard),
so that with one more shard a record stays or goes to the new one; inside its shard a second
seeded hash, of id and text, deals it to a bucket. There are as many buckets as keep one at about
``bucket_bytes`` and ``BUCKET_ROWS``. The scatter is one exchange. Pass 2 puts each bucket in a fixed order,
shuffles it by Fisher and Yates and writes it to the shard's folder. Step i draws its place from the seeded hash
of (shard, bucket, i), not from a generator of the task. A record's slot is
its place in the bucket after the records of the shard's earlier buckets.

All of it follows from the records' contents and the parameters: a task that is run again, another
order of the input and another number of partitions give the same shards, buckets and places.
Records with the same id and text would all meet in one bucket. Where there are more than
``EQUAL_ROWS`` of them, or more bytes of them than a bucket should have, they are counted first, with partial sums,
and dealt by their number.

Defined cases: null text has size 1 and checksum 0; a null doc_id is hashed as such and is an
ordinary key; repeated rows are all kept; an empty table gives no row; other columns are not
carried, but for those named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import scratch_path


#: Records of one id and text beyond which they are numbered.
EQUAL_ROWS = 1024
#: Records that a bucket has on average at most: a step of its shuffle copies an array of as many places.
BUCKET_ROWS = 2048


def shard_of(doc_id: Column, shards: int, seed: int) -> Column:
    """The shard of the highest hash; ties, of 64-bit hashes, go to the highest shard."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    offers = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*offers)["s"] if shards > 1 else F.lit(0)


def _size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def measured(docs: DataFrame) -> tuple[int, int, int, int]:
    """Bytes (a text's and one more) and number of all records; of those of one id and text, the most and the most bytes where there are several."""
    equal = docs.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(_size()).alias("size"))
    several = F.when(F.col("n") > 1, F.col("size"))
    found = equal.agg(F.sum("size"), F.sum("n"), F.max("n"), F.max(several)).first()
    return tuple(v or 0 for v in found)


def bucket_count(total: int, shards: int, bucket_bytes: int, rows: int = 0) -> int:
    """Buckets a shard: a power of two that keeps a bucket within its bytes and rows on average."""
    need = max(-(-total // (shards * bucket_bytes)), -(-rows // (shards * BUCKET_ROWS)))
    return max(1, 1 << max(0, need - 1).bit_length())


def _numbered(row: DataFrame, bucket_bytes: int) -> DataFrame:
    """``row`` with the column ``copy``: 0, and for each record of too many equal ones its number among these."""
    equal = row.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(_size()).alias("size"))
    too_many = (F.col("n") > EQUAL_ROWS) | ((F.col("n") > 1) & (F.col("size") > bucket_bytes))
    keys = equal.where(too_many).select("doc_id", "h", F.lit(True).alias("many"))
    marked = row.withColumn("h", F.xxhash64("text")).alias("l").join(keys.alias("k"), F.expr("l.doc_id <=> k.doc_id AND l.h = k.h"), "left").select("l.*", "k.many")
    counted = marked.where("many").groupBy(*row.columns).agg(F.count(F.lit(1)).alias("n"))
    many = counted.select(*row.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    return marked.where("many IS NULL").select(*row.columns, F.lit(0).cast("long").alias("copy")).unionByName(many)


def fisher_yates(n: Column, *seeds: Column | int) -> Column:
    """A permutation of 0 to n - 1, from the inside out: step i puts i at a drawn place j <= i and what was there at i."""
    keys = [F.lit(s) if isinstance(s, int) else s for s in seeds]

    def step(a: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*keys, i), i.cast("long") + 1).cast("int")
        swapped = F.concat(F.slice(a, F.lit(1), j), F.array(i), F.slice(a, j + 2, i - j - 1), F.array(F.get(a, j)))
        return F.when(j == i, F.concat(a, F.array(i))).otherwise(swapped)

    # A sequence of 0 to n steps without its last: n = 0 has none.
    return F.aggregate(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), F.array().cast("array<int>"), step)


def shuffled(docs: DataFrame, shards: int = 16, seed: int = 20240601, bucket_bytes: int = 4 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """shard, bucket, place in the bucket, doc_id, text and the columns to keep; not yet written."""
    row = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    total, count, most, most_bytes = measured(row.select("doc_id", "text"))
    buckets = bucket_count(total, shards, bucket_bytes, count)
    fields = row.columns
    row = _numbered(row, bucket_bytes) if most > EQUAL_ROWS or most_bytes > bucket_bytes else row.withColumn("copy", F.lit(0).cast("long"))
    dealt = row.withColumn("shard", shard_of(F.col("doc_id"), shards, seed)).withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text", "copy"), F.lit(buckets)).cast("int")
    )
    # The order before the shuffle: a seeded hash, then all that the row has.
    first = F.xxhash64(F.lit(seed + 2), "doc_id", "text").alias("h")
    scattered = dealt.repartition("shard", "bucket").groupBy("shard", "bucket").agg(
        F.sort_array(F.collect_list(F.struct(first, *fields))).alias("rows")
    )
    order = fisher_yates(F.size("rows"), seed + 3, F.col("shard"), F.col("bucket"))
    mixed = scattered.select("shard", "bucket", F.posexplode(F.transform(order, lambda i: F.get("rows", i))).alias("place", "r"))
    return mixed.select("shard", "bucket", "place", *[F.col(f"r.{f}").alias(f.removeprefix("kept_") if f.startswith("kept_") else f) for f in fields])


def write_shards(spark: SparkSession, docs: DataFrame, folder: str | None = None, **options) -> str:
    """Write the shards as folders shard=0, shard=1 and so on; returns the folder of all."""
    folder = folder or scratch_path(spark, "shards")
    shuffled(docs, **options).write.partitionBy("shard").parquet(folder)
    return folder


def read_shards(spark: SparkSession, folder: str, shown: dict[str, Column] | None = None) -> DataFrame:
    """The written records, with their slots: gapless from 0 in each shard.

    ``shown`` names what to read of a record in place of its text; it is computed in the scan, so texts
    are not dealt again to meet their buckets' counts. These counts are one row a bucket: for 100 TB in
    buckets of 4 MiB 24 million, 1.5 million for each of 16 shards, summed up in that shard's window.
    """
    rows = spark.read.schema("bucket int, place int, doc_id long, text string, shard int").parquet(folder)
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    shown = {"text": F.col("text")} if shown is None else shown
    read = rows.select("doc_id", "shard", "bucket", "place", *[c.alias(n) for n, c in shown.items()])
    return read.join(bases, ["shard", "bucket"]).withColumn("slot", (F.col("base") + F.col("place")).cast("long")).drop("base")


def shard_sizes(rows: DataFrame) -> DataFrame:
    """Records and bytes of each shard."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))


__all__ = ["read_shards", "shard_of", "shard_sizes", "shuffled", "write_shards"]
