"""Catalogue records from raw rows, facts with fallbacks, digests as cache keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def clean(text: Column) -> Column:
    """One blank between words, none around; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def public_id(prefix: str, locale: str, raw: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_{locale}_"), F.regexp_replace(raw, "[^A-Za-z0-9]", "_"))


def values_of(values: Column, language: str) -> Column:
    """The values whose language tag begins with ``language``, of an array of (tag, value)."""
    return F.transform(F.filter(values, lambda v: F.startswith(v["tag"], F.lit(language))), lambda v: v["value"])


def query_title(title: Column, brand: Column, generic: tuple[str, ...]) -> Column:
    """A title without its leading bracket, its brand and generic words."""
    text = F.replace(F.regexp_replace(title, r"^\[[^\]]*\]\s*", ""), brand, F.lit(""))
    for word in generic:
        text = F.replace(text, F.lit(word), F.lit(""))
    return F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" ,、-"))


def tags_in(tags: Column, query: Column, most: int = 4, longest: int = 18) -> Column:
    """Distinct tags that the (lower-case) query has in it; long ones only if they are codes, with a colon."""
    usable = F.filter(F.array_distinct(tags), lambda t: (F.length(F.trim(t)) > 0) & ((F.length(t) <= longest) | F.contains(t, F.lit(":"))))
    return F.slice(F.filter(usable, lambda t: F.contains(query, F.lower(t))), 1, most)


def shown_price(price: Column) -> Column:
    """Whole prices without a point, others with two digits at most and no trailing zero."""
    cents = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", price), "0+$", ""), "[.]$", "")
    return F.when(price == F.floor(price), price.cast("long").cast("string")).otherwise(cents)


def with_facts(asked: DataFrame, overrides: DataFrame, sku_overrides: DataFrame) -> DataFrame:
    """price, source and missing of products (product_id, sku, catalogue, brand): of a sku before a product's, before the catalogue's."""
    joined = asked.join(overrides.withColumnRenamed("price", "by_product"), "product_id", "left").join(sku_overrides.withColumnRenamed("price", "by_sku"), ["product_id", "sku"], "left")
    price = F.coalesce("by_sku", "by_product", "catalogue")
    source = F.when(F.col("by_sku").isNotNull(), "override_sku").when(F.col("by_product").isNotNull(), "override").when(F.col("catalogue").isNotNull(), "catalogue").otherwise("none")
    missing = F.array_compact(F.array(F.when(price.isNull(), "price"), F.when(F.col("brand").isNull(), "brand")))
    return joined.select("product_id", F.round(price, 2).alias("price"), source.alias("source"), F.array_join(missing, ",").alias("missing"), "brand")


def through_cache(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted`` rows, one a key, and where each comes from."""
    known = cache.select("key", F.lit(True).alias("__known"))
    return wanted.join(known, "key", "left").withColumn("origin", F.when(F.col("__known"), "cached").otherwise("computed")).drop("__known")


@F.pandas_udf(StringType())
def first_json(text: pd.Series) -> pd.Series:
    """The first JSON object in a text, with all that is nested in it; null if there is none.

    A brace that begins no whole object is passed over, as are braces inside of the object's strings.
    """
    decode = json.JSONDecoder().raw_decode

    def first(value: str | None) -> str | None:
        at = value.find("{") if value else -1
        while at >= 0:
            try:
                return value[at : decode(value, at)[1]]
            except (ValueError, RecursionError):
                at = value.find("{", at + 1)
        return None

    return text.map(first, na_action="ignore")


def mapped(value: Column, names: dict[str, str]) -> Column:
    """A value's name; null for values that have none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)


def tiles(rows: DataFrame, n: int) -> DataFrame:
    """kind, id, place and part: n parts of equal size in order of place, kind and id.

    Rows are counted by the first two digits of ``place``; a row's number is what is before its digits and
    its number among those with the same ones, so each window holds a 256th of the rows.
    """
    own = rows.withColumn("head", F.substring("place", 1, 2))
    counts = own.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("head", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("head").orderBy("place", "kind", "id")) - 1
    # The first parts have one row more where n does not divide the total.
    size, more = F.floor(F.col("total") / n), F.col("total") % n
    edge = more * (size + 1)
    part = F.when(number < edge, F.floor(number / (size + 1))).otherwise(more + F.floor((number - edge) / F.greatest(size, F.lit(1)))) + 1
    return own.join(before, "head").select("kind", "id", "place", part.cast("long").alias("part"))
