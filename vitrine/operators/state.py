"""State that depends on the order of events, folded per key by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamped(rows: DataFrame, key: list[str], order: list[Column], change: str, name: str = "level") -> DataFrame:
    """A running level that is never below 0.

    The fold max(0, level + change) has a closed form: the running sum minus the least running
    sum so far, if that is below 0; so it is two windows and no loop.
    """
    so_far = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = rows.withColumn("__sum", F.sum(change).over(so_far))
    return total.withColumn(name, F.col("__sum") - F.least(F.min("__sum").over(so_far), F.lit(0))).drop("__sum")


def last_writes(rows: DataFrame, key: list[str], order: list[Column], set_to: str, add: str) -> DataFrame:
    """Quantities after a log of sets and adds: the last set and all that was added after it; 0 or less is gone."""
    later = Window.partitionBy(*key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    own = rows.withColumn("__later", F.count(set_to).over(later))
    left = own.where("__later = 0").groupBy(*key).agg(F.sum(F.coalesce(F.col(set_to), F.col(add))).alias("quantity"))
    return left.where("quantity > 0")


def merged_filters(rows: DataFrame, session: str, kind: str, value: str, order: str) -> DataFrame:
    """A session's filters by kind: the last scalar wins, lists keep each value once in order."""
    scalars = ["min_price", "max_price"]
    each = rows.groupBy(session).agg(
        *[F.max_by(F.when(F.col(kind) == k, F.col(value)), F.when(F.col(kind) == k, F.col(order))).alias(k) for k in scalars]
    )
    first = rows.where(~F.col(kind).isin(scalars)).groupBy(session, kind, value).agg(F.min(order).alias("__first"))
    lists = first.groupBy(session, kind).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__first", F.col(value).alias("v")))), lambda s: s["v"]), ",").alias("values"))
    return each.join(lists.groupBy(session).pivot(kind, ["brand", "exclude"]).agg(F.max("values")), session, "left")
