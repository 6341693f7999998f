"""States of sessions by the actions that led to them, and what came of the ways that branch off from one.

A prefix of actions is named by its length and a running digest: each action is hashed with its place, and the hashes are combined by exclusive
or as the window goes on. So a row carries a name of fixed size instead of the prefix, and equal prefixes have equal names in any session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contracts import first_reason


def _digest(text: Column, first: int) -> Column:
    """60 bits of a text's MD5, from a digit on."""
    return F.conv(F.substring(F.md5(text), first, 15), 16, 10).cast("long")


def with_prefix(steps: DataFrame, key: str, order: list[str], accepted: Column, action: Column) -> DataFrame:
    """``steps`` with ``prefix_n`` and ``prefix_id``: how many accepted actions came before each step, and the name of their sequence."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = steps.withColumn("_n", F.coalesce(F.count(F.when(accepted, 1)).over(before), F.lit(0)))
    placed = F.when(accepted, F.concat_ws(":", F.col("_n").cast("string"), action))
    rows = rows.withColumn("_a", _digest(placed, 1)).withColumn("_b", _digest(placed, 16))
    a, b = (F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("long")) for c in ("_a", "_b"))
    name = F.concat_ws("-", F.col("_n").cast("string"), F.lower(F.lpad(F.hex(a), 15, "0")), F.lower(F.lpad(F.hex(b), 15, "0")))
    return rows.withColumn("prefix_n", F.col("_n")).withColumn("prefix_id", name).drop("_n", "_a", "_b")


def ledger_states(ledger: DataFrame, key: str, order: str, action: Column, done: Column, after: Column) -> DataFrame:
    """(key, prefix_n, prefix_id, terminal, current) of every length of a session's ledger of accepted actions, zero to all.

    ``order`` numbers the ledger from 1. ``terminal`` tells whether the session had ended by then, ``current`` what was seen last; null at the beginning.
    """
    rows = ledger.select(key, F.col(order).alias("_at"), action.alias("_action"), done.alias("_done"), after.alias("_after"))
    ends = rows.groupBy(key).agg(F.max("_at").alias("_at"), F.max_by("_done", "_at").alias("_last_done"), F.max_by("_after", "_at").alias("_last_after"))
    beyond = ends.select(key, (F.col("_at") + 1).alias("_at"), F.lit(None).cast("string").alias("_action"), F.lit(None).cast("boolean").alias("_done"), F.lit(None).cast(rows.schema["_after"].dataType).alias("_after"))
    every = rows.unionByName(beyond)
    step = Window.partitionBy(key).orderBy("_at")
    every = every.withColumn("terminal", F.coalesce(F.lag("_done").over(step), F.lit(False))).withColumn("current", F.lag("_after").over(step))
    every = with_prefix(every, key, ["_at"], F.col("_action").isNotNull(), F.col("_action"))
    return every.select(key, "prefix_n", "prefix_id", "terminal", "current")


def bound_events(events: DataFrame, sessions: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Events (key, prefix_action_count, observation) with ``state_id``, or the ``fault`` that keeps them from having one.

    An event is joined to the state of its session's ledger at its own count. ``sessions`` has (key, task, initial): the task and what was seen
    at the beginning. A state is named by its task, its prefix and what was seen.
    """
    rows = events.join(sessions.select(key, F.col("task").alias("_task"), F.col("initial").alias("_initial")), key, "left")
    named = states.select(F.col(key), F.col("prefix_n").alias("prefix_action_count"), "prefix_id", "terminal", "current", F.lit(True).alias("_known"))
    rows = rows.join(named, [key, "prefix_action_count"], "left")
    empty = F.col("prefix_action_count") == 0
    current = F.when(empty, F.col("_initial")).otherwise(F.col("current"))
    fault = first_reason(
        invalid_prefix_action_count=F.col("prefix_action_count").isNull(),
        prefix_action_count_out_of_range=F.col("_known").isNull() & ~empty,
        branch_after_terminal=F.coalesce(F.col("terminal"), F.lit(False)),
        event_observation_hash_mismatch=~F.col("observation").eqNullSafe(current),
    )
    prefix = F.coalesce("prefix_id", F.lit("0-" + "0" * 15 + "-" + "0" * 15))
    state = F.sha2(F.concat_ws("|", F.col("_task").cast("string"), prefix, F.col("observation")), 256)
    return rows.withColumn("fault", fault).withColumn("state_id", F.when(fault.isNull(), state)).drop("_task", "_initial", "_known", "terminal", "current")


def branch_groups(visits: DataFrame, keys: list[str], occurrence: str, action: str, strict: str, utility: str, least: int = 2, training_least: int = 4, tolerance: float = 1e-8) -> DataFrame:
    """One row a state with at least ``least`` visits: how its actions differ and what came of them.

    A visit that comes several times, by its ``occurrence``, counts once. A state whose visits both succeeded and failed after different
    actions, and often enough, is a natural candidate for a group of suffixes.
    """
    once = visits.groupBy(*keys, occurrence).agg(F.min_by(F.struct(action, strict, utility), F.struct(action, strict, utility)).alias("v")).select(*keys, "v.*")
    by_action = once.groupBy(*keys, action).agg(F.count("*").alias("n"), F.count_if(strict).alias("won"), F.min(utility).alias("low"), F.max(utility).alias("high"), F.sum(F.col(utility).cast("decimal(20,6)")).alias("total"))
    groups = by_action.groupBy(*keys).agg(
        F.sum("n").alias("visits"), F.count("*").alias("unique_next_actions"), F.sum("won").alias("_won"), F.min("low").alias("_low"), F.max("high").alias("_high"),
        F.array_sort(F.collect_list(F.struct(F.col(action).alias("action"), F.col("n").alias("visits"), F.col("won").alias("strict"), (F.col("total").cast("double") / F.col("n")).alias("mean_utility")))).alias("action_outcomes"),
    )
    mixed, several = (F.col("_won") > 0) & (F.col("_won") < F.col("visits")), F.col("unique_next_actions") > 1
    varying = F.col("_high") - F.col("_low") > tolerance
    return groups.where(F.col("visits") >= least).select(
        *keys, "visits", "unique_next_actions", mixed.alias("mixed_strict"), varying.alias("utility_varying"), (mixed & several).alias("eligible_mixed_strict"), (varying & several).alias("eligible_mixed_utility"),
        ((F.col("visits") >= training_least) & mixed & several).alias("natural_suffix_group_candidate"), "action_outcomes",
    )
