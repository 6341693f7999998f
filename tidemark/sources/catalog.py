"""Cleaning of a product catalogue and flattening of its goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_PRICE = 100.0


def clean(products: DataFrame, order: str) -> DataFrame:
    """Products (asin, pricing, customization_options, …): the first row of each usable id, with prices and lower-cased options.

    Ids that are missing, ``nan`` or longer than 20 characters are left out. Without prices there is one of 100; of several the first two count.
    """
    usable = products.where("asin IS NOT NULL AND asin <> 'nan' AND length(asin) <= 20")
    first = usable.withColumn("_n", F.row_number().over(Window.partitionBy("asin").orderBy(order))).where("_n = 1").drop("_n")
    pricing = F.when(F.size(F.coalesce("pricing", F.array().cast("array<double>"))) == 0, F.array(F.lit(DEFAULT_PRICE))).otherwise(F.slice("pricing", 1, 2))
    first = first.withColumn("pricing", pricing)
    tag = F.array_join(F.transform("pricing", lambda p: F.format_string("$%.2f", p)), " to ")

    def option(values: Column) -> Column:
        return F.transform(values, lambda v: v.withField("value", F.replace(F.lower(F.trim(v["value"])), F.lit("/"), F.lit(" | "))))

    return first.withColumn("price_tag", tag).withColumn("customization_options", F.transform_values("customization_options", lambda _, v: option(v)))


def base_price(pricing: Column) -> Column:
    return F.coalesce(F.try_element_at(pricing, F.lit(1)), F.lit(DEFAULT_PRICE))


def goals(products: DataFrame, order: str) -> DataFrame:
    """One goal for each instruction that has attributes, numbered in the order of products and instructions.

    A goal's number is its place among all: counts by product give where a product's begin, and no task numbers all goals.
    """
    kept = F.filter("instructions", lambda i: F.size(F.coalesce(i["attributes"], F.array().cast("array<string>"))) > 0)
    rows = products.select("asin", order, kept.alias("k"))
    # The running total goes over blocks of products, of which there are few.
    block = F.floor(F.col(order) / 10_000)
    totals = rows.groupBy(block.alias("_b")).agg(F.sum(F.size("k")).alias("_n"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.coalesce(F.sum(F.size("k")).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_b", block).withColumn("_own", own).join(totals.select("_b", "_before"), "_b")
    return placed.select("asin", (F.col("_before") + F.col("_own")).alias("_at"), F.posexplode("k").alias("pos", "i")).select((F.col("_at") + F.col("pos")).alias("goal_id"), "asin", "i.*")
