"""Groups of rollouts of one task, and of visits of one state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logic import money

TOLERANCE = 1e-8


def reward_varying(rows: DataFrame, group: str, reward: str, invalid: Column, tolerance: float = TOLERANCE) -> DataFrame:
    """Every row with its group's verdict: kept, or dropped as sampling_invalid before constant_reward."""
    w = Window.partitionBy(group)
    spread = F.max(reward).over(w) - F.min(reward).over(w)
    reason = F.when(F.max(invalid).over(w), "sampling_invalid").when(spread <= tolerance, "constant_reward").otherwise("kept")
    return rows.withColumn("verdict", reason)


def group_statistics(rows: DataFrame, group: str, reward: str, success: Column) -> DataFrame:
    """One row over all groups: how many have equal, zero, successful or no successful rewards."""
    each = rows.groupBy(group).agg(
        (F.max(reward) - F.min(reward) <= TOLERANCE).alias("same"),
        (F.max(F.abs(reward)) <= TOLERANCE).alias("zero"),
        F.every(success).alias("all_success"),
        (~F.some(success)).alias("no_success"),
        F.count("*").alias("size"),
    )
    return each.agg(
        F.count("*").alias("groups"),
        F.count_if("same").alias("all_equal"),
        F.count_if("zero").alias("all_zero"),
        F.count_if("all_success").alias("all_success"),
        F.count_if("no_success").alias("no_success"),
        F.max("size").alias("largest"),
    )


def action_outcomes(rows: DataFrame, state: str, action: str, success: Column, utility: str) -> DataFrame:
    return rows.groupBy(state, action).agg(
        F.count("*").alias("visits"),
        F.count_if(success).alias("successes"),
        F.count_if(~success).alias("failures"),
        F.min(utility).alias("lowest"),
        F.max(utility).alias("highest"),
    )


def state_groups(rows: DataFrame, state: str, visitor: str, action: str, success: Column, utility: str) -> DataFrame:
    """Per state over distinct occurrences: visits, mixed outcomes, divergent actions, varying utility."""
    distinct = rows.select(state, visitor, action, success.alias("_s"), utility).distinct()
    return distinct.groupBy(state).agg(
        F.count("*").alias("visits"),
        F.count_distinct(visitor).alias("visitors"),
        (F.some("_s") & ~F.every("_s")).alias("mixed"),
        (F.count_distinct(action) > 1).alias("divergent"),
        (F.max(utility) - F.min(utility) > TOLERANCE).alias("varying"),
    )


def kish_ess(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """Effective sample size (sum w)^2 / sum w^2; zero if all weights are."""
    w = money(F.col(weight))
    total, squares = F.sum(w).cast("double"), F.sum((w * w).cast("decimal(38,8)")).cast("double")
    return rows.groupBy(key).agg(F.round(F.when(squares > 0, total * total / squares).otherwise(0.0), 6).alias("ess"), F.count("*").alias("n"))


def capped_count(rows: DataFrame, outer: str, task: str, cap: int = 2) -> DataFrame:
    """Sum over tasks of min(cap, rows of the task)."""
    return rows.groupBy(outer, task).agg(F.count("*").alias("n")).groupBy(outer).agg(F.sum(F.least("n", F.lit(cap))).alias("capped"), F.count("*").alias("tasks"))


def mixed_groups(rows: DataFrame, group: str, gold: Column, failure: Column) -> DataFrame:
    """Groups with at least one gold row and one that failed."""
    each = rows.groupBy(group).agg(F.count_if(gold).alias("golds"), F.count_if(failure).alias("failures"), F.count("*").alias("n"))
    return each.where("golds > 0 AND failures > 0")


def signals(rows: DataFrame, key: str, policy_version: str) -> DataFrame:
    """(key, reward, utility, success, reasons, fault) of each sampled record: what grouping works on, and why the record itself is unsound.

    ``rows`` has total, terminal_utility, policy_reward_version, purchase_success, infrastructure_invalid, reward_unverifiable,
    sampling_invalid, invalid_reason and valid_for_learning; reasons say why a record is no sample, and valid_for_learning has to agree.
    """

    def finite(c: str):
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    def true(c: str):
        return F.coalesce(F.col(c), F.lit(False))

    own = F.array_compact(F.array(F.when(true("infrastructure_invalid"), F.lit("infrastructure_invalid")), F.when(true("reward_unverifiable"), F.lit("reward_unverifiable"))))
    other = F.array(F.coalesce(F.nullif("invalid_reason", F.lit("")), F.lit("reward_sampling_invalid")))
    r = rows.withColumn("reasons", F.when((F.size(own) == 0) & true("sampling_invalid"), other).otherwise(own))
    fault = (
        F.when(F.col("total").isNull() | F.col("terminal_utility").isNull(), "missing_reward")
        .when(~finite("total") | ~finite("terminal_utility"), "reward_not_finite")
        .when(~F.col("policy_reward_version").eqNullSafe(policy_version), "wrong_policy_version")
        .when(F.col("purchase_success").isNull(), "missing_purchase_success")
        .when(F.col("infrastructure_invalid").isNull(), "missing_infrastructure_invalid")
        .when(true("valid_for_learning") != (F.size("reasons") == 0), "inconsistent_valid_for_learning")
    )
    return r.select(key, F.col("total").alias("reward"), F.col("terminal_utility").alias("utility"), F.col("purchase_success").alias("success"), "reasons", fault.alias("fault"))
