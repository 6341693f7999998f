"""Fail-closed contracts: uniqueness, completeness and closure, as plans that return the offending rows, or raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract."""


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(expected: DataFrame, results: DataFrame, *keys: str) -> DataFrame:
    """Expected keys without a result."""
    return expected.select(*keys).distinct().join(results.select(*keys).distinct(), list(keys), "left_anti")


def require(offending: DataFrame, what: str, show: int = 10) -> None:
    """Raises with some of the rows if there are any."""
    rows = offending.limit(show).collect()
    if rows:
        raise ContractError(f"{what}: {[tuple(r) for r in rows]}")


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    require(duplicates(rows, *keys), f"{', '.join(keys)} must be unique")
    return rows


def require_complete(expected: DataFrame, results: DataFrame, *keys: str) -> None:
    require(missing(expected, results, *keys), "missing results")
    require(missing(results, expected, *keys), "unexpected results")


def require_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    require(a.select(key).intersect(b.select(key)), f"sets share {key}")


def same_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    both = left.join(b.select(key).distinct().withColumn("_b", F.lit(True)), key, "full")
    return both.where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))


def product_gaps(rows: DataFrame, group: str, item: str, slots: int) -> DataFrame:
    """Missing (group, item, slot) of the full product of each group's items and ``slots``; rows hold a ``slot``."""
    wanted = rows.select(group, item).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return wanted.join(rows.select(group, item, "slot").distinct(), [group, item, "slot"], "left_anti")


def closure(intents: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Per key what keeps the log from being closed: an intent without a record, a record without one, or several records."""
    i = intents.groupBy(key).agg(F.count("*").alias("intents"))
    r = records.groupBy(key).agg(F.count("*").alias("records"))
    both = i.join(r, key, "full").na.fill(0, ["intents", "records"])
    fault = F.when(F.col("records") == 0, "open_intent").when(F.col("intents") == 0, "orphan_record").when(F.col("records") != F.col("intents"), "count_mismatch")
    return both.withColumn("fault", fault).where("fault IS NOT NULL")


def reasons(**checks: Column) -> Column:
    """The names of all checks that hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())), lambda x: x.isNotNull())


def first_reason(**checks: Column) -> Column:
    """The name of the first check that holds, else null."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in checks.items()))


def mixed_digests(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys that come with different digests; rows with the same one are copies."""
    return rows.groupBy(key).agg(F.count_distinct(digest).alias("n")).where("n > 1")
