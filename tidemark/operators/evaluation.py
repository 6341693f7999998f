"""Summaries over expected tasks and their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logic import mean_of, rate

#: Outcome types that are always listed.
REWARD_TYPES = (
    "gold_purchase",
    "valid_alternative_purchase",
    "partial_purchase",
    "graceful_abstain",
    "early_abstain",
    "max_steps",
    "repeat_loop",
    "wrong_purchase",
    "reward_unverifiable",
)


def last_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; one shuffle, with per-partition pruning of ranks."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fixed_denominator_summary(expected: DataFrame, results: DataFrame, key: str, success: Column, reward: str) -> DataFrame:
    """One row; rates are by expected tasks, the mean reward by completed ones. ``results`` has one row a task."""
    joined = expected.select(key).join(results.withColumn("_done", F.lit(1)), key, "left")
    return joined.agg(
        F.count("*").alias("expected"),
        F.count("_done").alias("completed"),
        F.count_if(F.col("_done").isNull()).alias("missing"),
        F.count_if(F.coalesce(success, F.lit(False))).alias("successes"),
        rate(F.count_if(F.coalesce(success, F.lit(False))), F.count("*")).alias("success_rate"),
        mean_of(F.col(reward)).alias("mean_reward"),
    )


def type_rates(results: DataFrame, kind: str, types: DataFrame, expected: int | Column) -> DataFrame:
    """Counts and rates for each of a fixed list of types (``types.kind``), zero where there are none."""
    counts = results.groupBy(F.coalesce(F.col(kind), F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))
    joined = types.join(counts, "kind", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select("kind", "n", rate(F.col("n"), expected).alias("rate"))


def nested_counts(rows: DataFrame, array: str) -> DataFrame:
    return rows.select(F.explode(array).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def after_flag(rows: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Rows whose predecessor within the key has the flag."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_before", F.lag(flag).over(w)).where(F.coalesce("_before", F.lit(False))).drop("_before")


def bucketed_success(sessions: DataFrame, bucket: str, success: str) -> DataFrame:
    return sessions.groupBy(bucket).agg(F.count("*").alias("n"), F.count_if(success).alias("successes"), rate(F.count_if(success), F.count("*")).alias("success_rate"))


def two_level_counts(rows: DataFrame, outer: Column, inner: str, values: list[str]) -> DataFrame:
    """A column of counts for each value of ``inner``, zero-filled; missing outer keys are ``unknown``."""
    counts = [F.count_if(F.col(inner) == v).alias(f"n_{v.lower()}") for v in values]
    return rows.groupBy(F.coalesce(F.nullif(outer, F.lit("")), F.lit("unknown")).alias("outer_key")).agg(*counts)


def ids_by_code(rows: DataFrame, code: str, key: str) -> DataFrame:
    """The sorted distinct ids of each code, as text."""
    ids = F.array_sort(F.collect_set(key))
    return rows.groupBy(code).agg(F.array_join(ids.cast("array<string>"), ",").alias("ids"), F.count_distinct(key).alias("n"))


def measures(rows: DataFrame, keys: list[str], cols: dict[str, Column], flags: dict[str, Column]) -> DataFrame:
    """Mean, smallest and largest of measures and rates of flags, in one pass."""
    out = []
    for name, c in cols.items():
        out += [mean_of(c).alias(f"{name}_mean"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    out += [rate(F.count_if(c), F.count("*")).alias(f"{name}_rate") for name, c in flags.items()]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *out)
