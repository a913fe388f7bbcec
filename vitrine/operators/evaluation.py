"""Offline evaluation of ranked lists, judges and arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def list_metrics(ranked: DataFrame, judged: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, hits, n_relevant, recall, mrr, ndcg of each query.

    ranked: query_id, doc_id, rank. judged: query_id, doc_id of relevant documents in the lists.
    relevant: query_id, n_relevant. Gains are 1; the ideal list has min(n_relevant, k) of them.
    """
    own = ranked.where(F.col("rank") <= k).join(judged.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    found = own.groupBy("query_id").agg(
        F.count("hit").alias("hits"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    return relevant.join(found, "query_id", "left").select(
        "query_id",
        F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
        "n_relevant",
        F.round(F.coalesce("hits", F.lit(0)) / F.col("n_relevant"), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(F.col("n_relevant") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, observed and expected agreement, Cohen's kappa and its band, in one pass."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    stats = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("observed"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    expected = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    value = F.when(expected == 1, 1.0).otherwise((F.col("observed") - expected) / (1 - expected))
    band = F.when(value < 0.2, "slight").when(value < 0.4, "fair").when(value < 0.6, "moderate").when(value < 0.8, "substantial").otherwise("almost perfect")
    return stats.select("n", F.round("observed", 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(value, 6).alias("kappa"), band.alias("band"))


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``by``, n, mean and each named percentile, exact, with linear interpolation.

    Equal values are counted first. A value's place is the count of the whole units before it plus that inside its own
    unit, so no task holds all values of a group.
    """
    counts = rows.groupBy(by, F.floor(value).alias("unit"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    units = counts.groupBy(by, "unit").agg(F.sum("c").alias("in_unit"), F.sum(F.col("c") * F.col("v")).alias("total"))
    whole = Window.partitionBy(by)
    before = F.coalesce(F.sum("in_unit").over(whole.orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = units.select(by, "unit", before.alias("before"), F.sum("in_unit").over(whole).alias("n"), (F.sum("total").over(whole) / F.sum("in_unit").over(whole)).alias("mean"))
    inside = F.sum("c").over(Window.partitionBy(by, "unit").orderBy("v"))
    placed = counts.withColumn("end", inside).join(units, [by, "unit"]).withColumn("end", F.col("before") + F.col("end")).withColumn("start", F.col("end") - F.col("c"))
    at = lambda place: F.max(F.when((F.col("start") <= place) & (place < F.col("end")), F.col("v")))
    found = []
    for name, share in shares.items():
        place = (F.col("n") - 1) * share
        low, high = at(F.floor(place)), at(F.ceil(place))
        found.append(F.round(low + (high - low) * F.max(place - F.floor(place)), 4).alias(name))
    return placed.groupBy(by).agg(F.max("n").alias("n"), F.round(F.max("mean"), 4).alias("mean"), *found)
