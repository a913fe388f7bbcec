"""The life of orders: all-or-nothing admission against stock, cancelling and paying.

Orders come in one order. An order is taken if every product it names has enough left then; a refused one
takes nothing; a cancelled one gives back at its time. What an order gets depends on all earlier
rivals, but it rarely needs all their answers: what is taken for sure and what could be taken at most
bound what is left. An order that fits even if all open rivals are taken is taken, one that does not
fit beside those taken for sure is refused, and each round that follows has closer bounds. The
first open order of all is decided in every round, so rounds end.

Sums up to a place are made in two levels: for each product and stretch of time, then inside of it.
A product that is in a third of all lines is so many stretches, not one sorted partition.

Defined cases: lines of one order and product are one line; a line whose product has no stock row, or
without quantity, is refused with its order; an order without lines is not there; equal times go
by order id; a cancel before or at its order's own place comes right after it; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import kept


def running(rows: DataFrame, key: str, stretch: str, order: list[str], amounts: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its amount over the key's rows before this one. ``stretch`` never falls along ``order``."""
    sums = rows.groupBy(key, stretch).agg(*[F.sum(a).alias(f"_{n}") for n, a in amounts.items()])
    before = Window.partitionBy(key).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    bases = sums.select(F.col(key).alias("_key"), F.col(stretch).alias("_stretch"), *[F.coalesce(F.sum(f"_{n}").over(before), zero).alias(f"_{n}") for n in amounts])
    inside = Window.partitionBy(key, stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(bases, (F.col(key) == F.col("_key")) & (F.col(stretch) == F.col("_stretch")))
    return joined.withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(a).over(inside), zero) for n, a in amounts.items()}).drop("_key", "_stretch", *[f"_{n}" for n in amounts])


def admitted(lines: DataFrame, stock: DataFrame) -> DataFrame:
    """order_id, accepted: which orders are taken.

    lines: order_id, at (a number or date that orders come by), sku, quantity, and gone_at (null, or
    when the order is cancelled). stock: sku, available, one row a product.
    """
    own = lines.groupBy("order_id", "sku").agg(F.min("at").alias("at"), F.min("gone_at").alias("gone_at"), F.sum("quantity").cast("long").alias("quantity"))
    own = own.join(stock.select("sku", F.col("available").cast("long").alias("available")), "sku", "left")
    late = F.greatest("gone_at", "at")
    # A cancel of the order's own time comes after all orders of that time that come before it, and right after itself.
    move = lambda time, step, quantity: F.struct(time.alias("time"), F.lit(step).alias("step"), quantity.alias("quantity"))
    moves = F.array_compact(F.array(move(F.col("at"), 0, F.col("quantity")), F.when(F.col("gone_at").isNotNull(), move(late, 1, -F.col("quantity")))))
    zero = F.lit(0).cast("long")
    # What is taken for sure before a row is a number of the row, ``base``; a row taken stays for one more round, to be added to those after it.
    open_rows = kept(own.select("sku", "order_id", "available", F.explode(moves).alias("m")).select("sku", "order_id", "m.*", "available", zero.alias("base"), F.lit(False).alias("sure")), "orders-open")
    decided = None
    while not open_rows.where("NOT sure").isEmpty():
        amounts = {"taken": F.when(F.col("sure"), F.col("quantity")).otherwise(0), "most": F.col("quantity")}
        seen = running(open_rows, "sku", "time", ["order_id", "step"], amounts).where("NOT sure")
        seen = kept(seen.select("sku", "order_id", "time", "step", "quantity", "available", (F.col("base") + F.col("taken")).alias("base"), (F.col("base") + F.col("most")).alias("most")), "orders-seen")
        unknown = F.col("available").isNull() | F.col("quantity").isNull()
        mine = seen.where("step = 0").groupBy("order_id").agg(
            F.bool_or(unknown | (F.col("base") + F.col("quantity") > F.col("available"))).alias("refused"),
            F.bool_and(~unknown & (F.col("most") + F.col("quantity") <= F.col("available"))).alias("fits"),
        )
        answers = kept(mine.where("refused OR fits").select("order_id", F.col("fits").alias("accepted")), "orders-decided")
        decided = answers if decided is None else decided.unionByName(answers)
        after = seen.drop("most").join(answers, "order_id", "left").where("accepted IS NULL OR accepted")
        open_rows = kept(after.withColumn("sure", F.col("accepted").isNotNull()).drop("accepted"), "orders-open")
    empty = own.select("order_id", F.lit(True).alias("accepted")).limit(0)
    return empty if decided is None else decided


def reserved(asked: DataFrame, available: int) -> DataFrame:
    """sku, quantity, accepted of ``asked`` (sku, at, order_id, quantity: one product an order): in order, what still fits in ``available`` is taken.

    An order of one product hangs on no other product, so one pass over the sorted rows decides all. A row without quantity is refused.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, 0
        for batch in batches:
            taken = []
            for sku, quantity in zip(batch.column("sku").to_pylist(), batch.column("quantity").to_pylist(), strict=True):
                if sku != current:
                    current, held = sku, 0
                fits = sku is not None and quantity is not None and held + quantity <= available
                held += quantity if fits else 0
                taken.append(fits)
            yield pa.RecordBatch.from_arrays([batch.column("sku"), batch.column("quantity"), pa.array(taken, pa.bool_())], names=["sku", "quantity", "accepted"])

    in_order = asked.repartition("sku").sortWithinPartitions("sku", F.asc_nulls_last("at"), "order_id").select("sku", "quantity")
    return in_order.mapInArrow(decide, "sku long, quantity long, accepted boolean")


def ledger(lines: DataFrame, stock: DataFrame, accepted: DataFrame) -> DataFrame:
    """sku, available, reserved, sold, given_back after all moves.

    lines as for ``admitted`` with paid_at: an order that is taken reserves; the first of paying and
    cancelling ends that: paying sells what was reserved, cancelling gives it back; a later move is refused.
    """
    own = lines.join(accepted.where("accepted").select("order_id"), "order_id", "left_semi")
    paid = F.col("paid_at").isNotNull() & (F.col("gone_at").isNull() | (F.col("paid_at") <= F.col("gone_at")))
    gone = F.col("gone_at").isNotNull() & ~paid
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("quantity"))), F.lit(0)).cast("long")
    moved = own.groupBy("sku").agg(total(~paid & ~gone).alias("reserved"), total(paid).alias("sold"), total(gone).alias("given_back"))
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long"))
    left = F.col("available").cast("long") - zero(F.col("reserved")) - zero(F.col("sold"))
    return stock.join(moved, "sku", "left").select("sku", left.alias("available"), *[zero(F.col(n)).alias(n) for n in ("reserved", "sold", "given_back")])
