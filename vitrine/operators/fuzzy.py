"""Names that are nearly an alias: the ratio of matching blocks, and a join that finds every candidate.

The ratio of two strings is twice the characters in matching blocks (the longest common block, then
the same left and right of it), by their length together. At a ratio of r or more, at most
e = (1 - r) (length together) characters lie outside of the blocks. Blocks keep their order, so if an alias is cut
into e + 1 pieces, one piece lies in a block whole, and stands in the value at most e
characters from its own place. Values and aliases are joined on such pieces: no pair is lost, and none is compared
that shares no piece.

Defined cases: values and aliases of fewer than four characters, or with characters beyond ASCII, after blanks and
signs are taken out, resolve only if equal; nulls resolve to nothing; of equal ratios the first alias in
the order of its text counts, of targets with one alias the least; repeated values give one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import compact

LEAST, SHORTEST = 0.92, 4


def _outside(together: Column, least: float) -> Column:
    """The most characters outside of matching blocks of two strings of that length together."""
    return F.floor(F.lit(1 - least) * together + 1e-9).cast("int")


def _longest(n: Column, least: float) -> Column:
    """The longest string that can match one of n characters."""
    return F.floor(n * F.lit((2 - least) / least) + 1e-9).cast("int")


def _piece(text: Column, size: Column, pieces: Column, i: Column) -> tuple[Column, Column]:
    """Where piece i of ``pieces`` of a string of ``size`` begins, and its length: the first ones are the shorter."""
    short, more = F.floor(size / pieces).cast("int"), size % pieces
    late = F.greatest(i - (pieces - more), F.lit(0))
    return i * short + late, short + (i >= pieces - more).cast("int")


def candidates(values: DataFrame, aliases: DataFrame, least: float = LEAST) -> DataFrame:
    """value, alias (both compact): every pair that can reach the ratio."""
    n = F.length("alias")
    pieces = _outside(n + _longest(n, least), least) + 1
    cut = aliases.select("alias", n.alias("n"), F.least(pieces, n).alias("pieces")).select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("i"))
    at, size = _piece(F.col("alias"), F.col("n"), F.col("pieces"), F.col("i"))
    right = cut.select("alias", "n", "i", F.substring("alias", at + 1, size).alias("piece"))

    m = F.length("value")
    low, high = F.greatest(F.ceil(m * F.lit(least / (2 - least)) - 1e-9).cast("int"), F.lit(SHORTEST)), _longest(m, least)
    sized = values.where(F.length("value") >= SHORTEST).select("value", F.explode(F.sequence(low, F.greatest(low, high))).alias("n"))
    count = F.least(_outside(F.col("n") + _longest(F.col("n"), least), least) + 1, F.col("n"))
    each = sized.select("value", "n", count.alias("pieces")).select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("i"))
    at, size = _piece(F.col("value"), F.col("n"), F.col("pieces"), F.col("i"))
    moved = each.select("value", "n", "i", at.alias("at"), size.alias("size"), F.explode(F.sequence(1 - F.col("pieces"), F.col("pieces") - 1)).alias("by"))
    place = F.col("at") + F.col("by")
    left = moved.where((place >= 0) & (place + F.col("size") <= F.length("value"))).select("value", "n", "i", F.substring("value", place + 1, F.col("size")).alias("piece"))
    return left.join(right, ["n", "i", "piece"]).select("value", "alias").distinct()


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("value").to_pylist(), batch.column("alias").to_pylist(), strict=True)
        ratio = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("alias"), pa.array(ratio, pa.float64())], names=["value", "alias", "ratio"])


def resolved(values: DataFrame, value: str, aliases: DataFrame, least: float = LEAST) -> DataFrame:
    """value, target, alias, ratio of each value that resolves; ``aliases``: alias, target."""
    table = aliases.select(compact(F.col("alias")).alias("alias"), "target").where("alias <> '' AND target IS NOT NULL").groupBy("alias").agg(F.min("target").alias("target"))
    own = values.select(F.col(value).alias("given"), compact(F.col(value)).alias("value")).where("value <> ''").distinct()
    near = F.length("alias") >= SHORTEST
    plain = lambda c: ~F.col(c).rlike(r"[^\x00-\x7f]")
    pairs = candidates(own.where(plain("value")).select("value").distinct(), table.where(near & plain("alias")).select("alias"), least)
    exact = own.select("value").distinct().join(table.select("alias"), F.col("value") == F.col("alias")).select("value", "alias", F.lit(1.0).alias("ratio"))
    scored = pairs.where("value <> alias").mapInArrow(_ratios, "value string, alias string, ratio double").where(F.col("ratio") >= least)
    best = scored.unionByName(exact).groupBy("value").agg(F.min(F.struct((-F.col("ratio")).alias("less"), "alias")).alias("best"))
    return own.join(best, "value").select("given", F.col("best.alias").alias("alias"), F.round(-F.col("best.less"), 6).alias("ratio")).join(table, "alias").select(F.col("given").alias("value"), "target", "alias", "ratio")
