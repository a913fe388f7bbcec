"""Work along one global order without a window over all rows: places, least-recently-used stores, sliding percentiles.

Rows are dealt by ranges of their order and written once with their range; the ranges' counts, a
row a range, give each row its place. Places are cut into blocks of equal size. What a block must
know of those before it is small: the most recent keys, or the last rows of a window.

Defined cases: equal rows of the order are told apart by all its columns, so it should end with an id;
rows with a null key are left out of a store; rows with a null value count in no window but get its
percentiles; empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import kept

BLOCK, FAN = 50_000, 8


def placed(rows: DataFrame, order: list[str], block: int = BLOCK) -> DataFrame:
    """Adds ``place``, from 0 along the order, and ``block``, the place by its size; as a written table."""
    n = max(1, -(-rows.count() // block))
    ranged = kept(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range.
    bases = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_range"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    own = ranged.withColumn("_inside", inside).join(bases, "_range").withColumn("place", (F.col("_base") + F.col("_inside")).cast("long"))
    return kept(own.withColumn("block", F.floor(F.col("place") / block).cast("long")).drop("_range", "_n", "_base", "_inside"), "places")


def _recent(rows: DataFrame, by: str, most: int) -> DataFrame:
    """by, key, last: of each group the ``most`` keys with the latest places."""
    last = rows.groupBy(by, "key").agg(F.max("last").alias("last"))
    return last.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("last")))).where(F.col("_r") <= most).drop("_r")


def recent_before(uses: DataFrame, capacity: int, fan: int = FAN) -> DataFrame:
    """block, key, last: the store's keys before each block. uses: block, key, last (a place).

    The most recent keys of two stretches are among the most recent keys of each, so stretches merge. They do
    in a tree of ``fan`` stretches a node; a block merges its earlier siblings at each level.
    """
    level = kept(_recent(uses, "block", capacity), "recent")
    count = (level.agg(F.max("block")).first()[0] or 0) + 1
    blocks = uses.sparkSession.range(count).withColumnRenamed("id", "block")
    parts, width = [], 1
    while width < count:
        # Nodes of this width: the earlier siblings of the block's own node.
        node = F.floor(F.col("block") / width)
        first = node - node % fan
        wanted = blocks.select("block", F.explode(F.when(node > first, F.sequence(first, node - 1)).otherwise(F.array().cast("array<bigint>"))).alias("_node"))
        nodes = level.withColumnRenamed("block", "_node")
        parts.append(wanted.join(nodes, "_node").select("block", "key", "last"))
        width *= fan
        if width < count:
            level = kept(_recent(level.withColumn("block", F.floor(F.col("block") / fan).cast("long")), "block", capacity), "recent")
    if not parts:
        return level.limit(0)
    return _recent(reduce(DataFrame.unionByName, parts), "block", capacity)


def _distances(key: tuple, uses: pa.Table, before: pa.Table) -> pa.Table:
    """For each use of a block, in order: how many other keys were used since the key's last use; null if that is not known."""
    if not uses.num_rows:
        return pa.table({"place": pa.array([], pa.int64()), "last_place": pa.array([], pa.int64()), "distance": pa.array([], pa.int64())})
    uses = uses.sort_by("place")
    old = before.sort_by("last")
    n_old, n = old.num_rows, uses.num_rows
    size = n_old + n
    # A tree of counts over all uses: 1 at the latest use of each key.
    tree = [0] * (size + 1)

    def add(at: int, value: int) -> None:
        at += 1
        while at <= size:
            tree[at] += value
            at += at & -at

    def upto(at: int) -> int:
        total = 0
        while at > 0:
            total += tree[at]
            at -= at & -at
        return total

    latest: dict[str, int] = {}
    where = np.concatenate([np.asarray(old.column("last"), np.int64), np.asarray(uses.column("place"), np.int64)])
    for i, name in enumerate(old.column("key").to_pylist()):
        latest[name] = i
        add(i, 1)
    live, last, distance = n_old, [], []
    for i, name in enumerate(uses.column("key").to_pylist(), n_old):
        at = latest.get(name)
        if at is None:
            last.append(None)
            distance.append(None)
            live += 1
        else:
            last.append(int(where[at]))
            distance.append(live - upto(at + 1))
            add(at, -1)
        latest[name] = i
        add(i, 1)
    return pa.table({"place": uses.column("place"), "last_place": pa.array(last, pa.int64()), "distance": pa.array(distance, pa.int64())})


def least_recently_used(rows: DataFrame, key: str, order: list[str], capacity: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """The rows with place, last_place, distance (other keys used since; null if ``capacity`` or more, or never used) and held.

    ``held``: a store of ``capacity`` keys, which gives up the one that was used longest ago, has the key when the row comes.
    """
    own = placed(rows.where(F.col(key).isNotNull()), order, block)
    uses = own.select("block", F.col(key).cast("string").alias("key"), F.col("place").alias("last"))
    before = recent_before(uses, capacity, fan).select(F.col("block").alias("_of"), "key", "last")
    found = uses.withColumnRenamed("last", "place").groupBy("block").cogroup(before.groupBy("_of")).applyInArrow(_distances, "place long, last_place long, distance long")
    near = F.col("distance") < capacity
    found = found.select("place", F.when(near, F.col("last_place")).alias("last_place"), F.when(near, F.col("distance")).alias("distance"))
    return own.drop("block").join(found, "place").withColumn("held", F.col("distance").isNotNull())


def percentile(ordered: list[float], p: float) -> float | None:
    """With linear interpolation."""
    if not ordered:
        return None
    at = p * (len(ordered) - 1)
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


def sliding_percentiles(rows: DataFrame, value: str, order: list[str], last: int, points: dict[str, float], block: int = BLOCK) -> DataFrame:
    """The rows with place, n and percentiles over the ``last`` rows up to each one.

    Blocks overlap: the last rows of a block are also at the head of the next, so each block slides alone.
    """
    block = max(block, last)
    own = placed(rows, order, block)
    values = own.select("block", "place", F.col(value).cast("double").alias("value"))
    overlap = values.where(F.col("place") % block > block - last).withColumn("block", F.col("block") + 1)

    def slide(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        place, data, number = np.asarray(table.column("place"), np.int64), table.column("value").to_pylist(), table.column("block")[0].as_py()
        ordered: list[float] = []
        out: list[list] = [[] for _ in range(2 + len(points))]
        for i, x in enumerate(data):
            if i >= last and (gone := data[i - last]) is not None:
                del ordered[bisect_left(ordered, gone)]
            if x is not None:
                insort(ordered, x)
            if place[i] // block == number:
                for to, v in zip(out, [int(place[i]), len(ordered), *[percentile(ordered, p) for p in points.values()]], strict=True):
                    to.append(v)
        kinds = [pa.int64(), pa.int64()] + [pa.float64()] * len(points)
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["place", "n", *points])

    schema = "place long, n long, " + ", ".join(f"{p} double" for p in points)
    found = values.unionByName(overlap).groupBy("block").applyInArrow(slide, schema)
    return own.drop("block").join(found, "place")


#: A bucket of the sketch is so many times as wide as the one below it: a percentile is off by ``SKETCH_ERROR`` of itself at most.
SKETCH_ERROR = 0.01
_GROWTH = (1 + SKETCH_ERROR) / (1 - SKETCH_ERROR)


def sketch_bucket(value: Column) -> Column:
    """The bucket of a value above 0: counts of buckets add up, so sketches merge by a sum. Values of 0 and less are in one bucket."""
    return F.when(value > 0, F.ceil(F.log(value) / np.log(_GROWTH)).cast("int"))


def sketch_percentiles(counts: DataFrame, by: list[str], points: dict[str, float]) -> DataFrame:
    """Percentiles (of the value at the rank rounded down) of each group, from counts: by, bucket, n."""
    whole = counts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.col("bucket").asc_nulls_first())
    own = whole.withColumns({"_upto": F.sum("n").over(order), "_all": F.sum("n").over(Window.partitionBy(*by))})
    middle = F.coalesce(F.lit(2.0) * F.pow(F.lit(float(_GROWTH)), F.col("bucket")) / (_GROWTH + 1), F.lit(0.0))
    return own.groupBy(*by).agg(F.sum("n").alias("n"), *[F.min(F.when(F.col("_upto") > F.floor(p * (F.col("_all") - 1)), F.struct(F.coalesce("bucket", F.lit(-(1 << 30))).alias("b"), middle.alias("x"))))["x"].alias(name) for name, p in points.items()])
