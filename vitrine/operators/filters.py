"""Structured filters: a specification compiled to one Column, and the retrieval pipeline around it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchSpec:
    """AND across facets, OR inside one; an empty facet does not restrict."""

    min_price: float | None = None
    max_price: float | None = None
    types: tuple[str, ...] = ()
    not_types: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    not_categories: tuple[str, ...] = ()
    brands: tuple[str, ...] = ()
    keywords: tuple[tuple[str, ...], ...] = ()
    excluded: tuple[str, ...] = ()
    in_stock: bool = False


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def number(column: Column) -> Column:
    """A number, 0 where it can't be read."""
    return F.coalesce(column.try_cast("double"), F.lit(0.0))


def range_filter(spec: SearchSpec, price: str = "price") -> Column:
    p = number(F.col(price))
    return _all([p >= spec.min_price] * (spec.min_price is not None) + [p <= spec.max_price] * (spec.max_price is not None))


def type_filter(spec: SearchSpec, types: str = "tags") -> Column:
    overlap = lambda names: F.arrays_overlap(F.col(types), F.array(*map(F.lit, names)))
    return _all([overlap(spec.types)] * bool(spec.types) + [~overlap(spec.not_types)] * bool(spec.not_types))


def category_filter(spec: SearchSpec, category: str = "category") -> Column:
    return _all([F.col(category).isin(*spec.categories)] * bool(spec.categories) + [~F.col(category).isin(*spec.not_categories)] * bool(spec.not_categories))


def brand_filter(spec: SearchSpec, canonical: str = "brand") -> Column:
    return F.col(canonical).isin(*spec.brands) if spec.brands else F.lit(True)


def stock_filter(spec: SearchSpec, stock: str = "stock") -> Column:
    return F.floor(number(F.col(stock))) > 0 if spec.in_stock else F.lit(True)


def keyword_filter(spec: SearchSpec, hay: str = "hay") -> Column:
    """Every keyword by any of its synonyms."""
    return _all([_any([F.contains(F.col(hay), F.lit(s)) for s in group]) for group in spec.keywords])


def exclusion_filter(spec: SearchSpec, hay: str = "hay") -> Column:
    return ~_any([F.contains(F.col(hay), F.lit(x)) for x in spec.excluded])


#: The pipeline's filters in their order.
STEPS = (
    ("RangeFilter", range_filter),
    ("BrandFilter", brand_filter),
    ("StockFilter", stock_filter),
    ("ExclusionFilter", exclusion_filter),
    ("ProductTypeFilter", type_filter),
    ("CategoryFilter", category_filter),
    ("KeywordFilter", keyword_filter),
)


def compiled(spec: SearchSpec) -> Column:
    return _all([step(spec) for _, step in STEPS])


def pushed(spec: SearchSpec) -> Column:
    """What a store can answer itself: price, stock, category, type."""
    return range_filter(spec) & stock_filter(spec) & category_filter(spec) & type_filter(spec)


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in a total order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def step_counts(candidates: DataFrame, spec: SearchSpec) -> DataFrame:
    """step, position, count: how many candidates are left after each filter, in one pass."""
    passed, columns = F.lit(True), [F.count(F.lit(1)).alias("c0")]
    for k, (_, step) in enumerate(STEPS, 1):
        passed = passed & step(spec)
        columns.append(F.count(F.when(passed, 1)).alias(f"c{k}"))
    names = ["recall", *(n for n, _ in STEPS)]
    counts = candidates.agg(*columns)
    rows = [F.struct(F.lit(n).alias("step"), F.lit(k).cast("long").alias("position"), F.col(f"c{k}").alias("count")) for k, n in enumerate(names)]
    return counts.select(F.inline(F.array(*rows)))


def zero_cause(steps: DataFrame) -> DataFrame:
    """The step whose count is 0 after one that was not, by the row before."""
    before = F.lag("count").over(Window.orderBy("position"))  # a handful of steps
    return steps.withColumn("before", before).where("count = 0 AND before > 0").select("step", "position", "before")


def rule_bonus(spec: SearchSpec, name_in_query: Column, brand_in_query: Column) -> Column:
    """The rule re-ranking's bonus. Its weights are fixed values."""
    price = number(F.col("price"))
    bonus = F.lit(0.0)
    if spec.types:
        bonus += F.when(F.arrays_overlap("tags", F.array(*map(F.lit, spec.types))), 20.0).otherwise(0.0)
    if spec.categories:
        bonus += F.when(F.col("category").isin(*spec.categories), 12.0).otherwise(0.0)
    for group in spec.keywords:
        bonus += F.when(_any([F.contains(F.col("hay"), F.lit(s)) for s in group]), 6.0).otherwise(0.0)
    if spec.brands:
        bonus += F.when(F.col("brand").isin(*spec.brands), 5.0).otherwise(0.0)
    if spec.max_price is not None:
        closeness = F.least(F.greatest(spec.max_price - price, F.lit(0.0)), F.lit(500.0)) / 500
        bonus += F.when(price <= spec.max_price, 2.0 + closeness).otherwise(0.0)
    if spec.min_price is not None:
        bonus += F.when(price >= spec.min_price, 1.0).otherwise(0.0)
    return bonus + F.when(name_in_query, 8.0).otherwise(0.0) + F.when(brand_in_query, 4.0).otherwise(0.0)
