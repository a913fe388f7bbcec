"""Commerce logic: as-of prices, history, coupons, totals, inventory, bundles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the order total.
FREE_SHIPPING, SHIPPING = 99.0, 10.0


def latest_as_of(prices: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """key and the value of its latest row. ``max_by`` is summed in parts, so a key's rows never meet in one task."""
    return prices.groupBy(key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def history(prices: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Slowly changing history: each row's end is the next row's start; unchanged values are merged."""
    order = Window.partitionBy(key).orderBy(at)
    changed = prices.withColumn("before", F.lag(value).over(order)).where(F.col("before").isNull() | (F.col("before") != F.col(value))).drop("before")
    return changed.withColumn("effective_to", F.lead(at).over(order)).withColumnRenamed(at, "effective_from")


def discount(total: Column, kind: Column, amount: Column, rate: Column, most: Column, threshold: Column) -> Column:
    """Coupon types 1 and 3 take an amount, type 2 a share up to a cap; never more than the total, nothing below the threshold."""
    share = total * (1 - F.coalesce(rate, F.lit(1.0)))
    value = F.when(kind == 2, F.when(most > 0, F.least(share, most)).otherwise(share)).otherwise(F.coalesce(amount, F.lit(0.0)))
    return F.when(total < threshold, 0.0).otherwise(F.least(value, total))


def shipping(subtotal: Column) -> Column:
    return F.when(subtotal >= FREE_SHIPPING, 0.0).otherwise(SHIPPING)


@dataclass(frozen=True)
class Slot:
    label: str
    weight: float = 1.0
    optional: bool = False


#: Fixed values of the bundle score.
REQUIRED, OPTIONAL, MISSING, IN_RANGE, BEST_USAGE, USAGE_STEP = 10000.0, 3500.0, -2500.0, 60.0, 0.8, 20.0


def bundles(candidates: DataFrame, slots: list[Slot], budget: float, most: int = 5) -> DataFrame:
    """The best choice of one candidate, or none, for each slot; one row with a column for each slot's product.

    candidates: slot, product_id, price, score. Each slot brings its ``most`` best, so there are
    (most + 1) ** slots choices whatever the catalogue's size. Equal scores go to the choice
    that comes first when each slot counts none first and then its candidates by rank.
    """
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "product_id")
    best = candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    chosen = None
    for k, slot in enumerate(slots):
        card = best.where(F.col("slot") == slot.label).select(
            F.struct("place", "product_id", "price", "score").alias(f"s{k}")
        )
        none = best.sparkSession.range(1).select(F.lit(None).cast("struct<place:int,product_id:bigint,price:double,score:double>").alias(f"s{k}"))
        card = F.broadcast(card.unionByName(none))  # most + 1 rows
        chosen = card if chosen is None else chosen.crossJoin(card)
    names = [f"s{k}" for k in range(len(slots))]
    total = sum((F.coalesce(F.col(f"{n}.price"), F.lit(0.0)) for n in names), F.lit(0.0))
    points = F.lit(0.0)
    for n, slot in zip(names, slots, strict=True):
        filled = (OPTIONAL if slot.optional else REQUIRED) + F.col(f"{n}.score") + max(slot.weight, 0.0) * 10
        points = points + F.when(F.col(n).isNull(), 0.0 if slot.optional else MISSING).otherwise(filled)
    usage = F.col("total") / budget
    points = points + F.when((usage >= 0.55) & (usage <= 0.98), IN_RANGE).otherwise(0.0) - F.abs(BEST_USAGE - usage) * USAGE_STEP
    ids = F.array_compact(F.array(*[F.col(f"{n}.product_id") for n in names]))
    kept = chosen.withColumn("total", total).where(F.col("total") <= budget).where(F.size(F.array_distinct(ids)) == F.size(ids)).withColumn("points", F.round(points, 6))
    first = [F.coalesce(F.col(f"{n}.place"), F.lit(0)) for n in names]
    return kept.orderBy(F.desc("points"), *first).limit(1).select("points", "total", *[F.col(f"{n}.product_id").alias(f"{slot.label}_id") for n, slot in zip(names, slots, strict=True)])
