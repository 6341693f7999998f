"""Repeatable splits and selections by hashes. Nothing ranks a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the hash that a first cut goes by: so many values that what shares one is few.
PREFIX = 3


def stable_hash(seed: str | int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def smallest(rows: DataFrame, group: str, digest: str, quotas: DataFrame) -> DataFrame:
    """``rows`` with ``taken``: whether the row's digest is among the ``quota`` smallest of its group.

    ``quotas`` (group, quota). Counts by prefix of the digest say which prefix the last one taken has; only the
    rows with that prefix are ranked.
    """
    prefix = F.left(F.col(digest), F.lit(PREFIX))
    counts = rows.groupBy(group, prefix.alias("_prefix")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).join(quotas, group)
    cutoff = counts.where("_before < quota").groupBy(group).agg(F.max(F.struct("_prefix", F.col("_before"), "quota")).alias("_cut"))
    marked = rows.join(cutoff, group, "left").withColumn("_prefix", prefix)
    edge = F.col("_prefix") == F.col("_cut._prefix")
    # Other rows get a partition of their own prefix, so that no partition is larger than a prefix's rows.
    rank = F.row_number().over(Window.partitionBy(group, "_prefix").orderBy(digest))
    taken = (F.col("_prefix") < F.col("_cut._prefix")) | (edge & (rank <= F.col("_cut.quota") - F.col("_cut._before")))
    return marked.withColumn("taken", F.coalesce(taken, F.lit(False))).drop("_prefix", "_cut")


def held_out_count(n: Column, ratio: float) -> Column:
    """Rounded half to even, one at least, all but one at most."""
    return F.least(F.greatest(F.lit(1), F.bround(n * F.lit(ratio), 0).cast("bigint")), n - 1)


def hash_split(ids: DataFrame, key: str, seed: int, ratio: float) -> DataFrame:
    """(key, split) of distinct ids: the smallest hashes are held out for validation."""
    each = ids.select(key).distinct().withColumn("_all", F.lit(0)).withColumn("_d", stable_hash(seed, F.col(key)))
    quotas = each.groupBy("_all").agg(held_out_count(F.count("*"), ratio).alias("quota"))
    return smallest(each, "_all", "_d", quotas).select(key, F.when(F.col("taken"), "validation").otherwise("train").alias("split"))


def largest_remainder(sizes: DataFrame, stratum: str, total: int) -> DataFrame:
    """(stratum, quota): whole parts of the proportional shares, then one more each by falling remainder and name."""
    # One row a stratum: the list of strata is short by nature.
    every = Window.partitionBy()
    share = F.col("n") * total / F.sum("n").over(every)
    s = sizes.withColumn("_floor", F.floor(share)).withColumn("_rest", F.round(share - F.floor(share), 9))
    rank = F.row_number().over(every.orderBy(F.desc("_rest"), stratum))
    return s.withColumn("quota", F.col("_floor") + (rank <= total - F.sum("_floor").over(every)).cast("int")).select(stratum, "quota")


def stratified(rows: DataFrame, stratum: str, key: str, seed: int, total: int) -> DataFrame:
    quotas = largest_remainder(rows.groupBy(stratum).agg(F.count("*").alias("n")), stratum, total)
    return smallest(rows.withColumn("_d", stable_hash(seed, F.col(key))), stratum, "_d", quotas).drop("_d")


def round_robin(rows: DataFrame, task: str, key: str, seed: int, cap: int, most: int) -> DataFrame:
    """Every task's first choice before any second one, ``cap`` a task and ``most`` in all."""
    ranked = rows.withColumn("task_rank", F.row_number().over(Window.partitionBy(task).orderBy(stable_hash(seed, F.lit("row"), F.col(key)), key)))
    ranked = ranked.where(F.col("task_rank") <= cap).withColumn("_t", stable_hash(seed, F.lit("task"), F.col(task)))
    return ranked.orderBy("task_rank", "_t", task).limit(most).drop("_t")


def label_quotas(rows: DataFrame, label: str, task: str, key: str, seed: int, quotas: list[tuple[str, int]]) -> DataFrame:
    """For each label in turn, one row of each of the first tasks by hash that no earlier label has used."""
    out = None
    for name, n in quotas:
        left = rows.where(F.col(label) == name)
        if out is not None:
            left = left.join(out.select(task), task, "left_anti")
        first = left.groupBy(task).agg(F.min(F.struct(stable_hash(seed, F.col(key)).alias("d"), F.col(key))).alias("x")).select(task, F.lit(name).alias(label), F.col(f"x.{key}").alias(key))
        chosen = first.orderBy(stable_hash(seed, F.lit(name), F.col(task)), task).limit(n)
        out = chosen if out is None else out.unionByName(chosen)
    return out


def overlap(sets: DataFrame, name: str, key: str) -> DataFrame:
    """Sizes of the intersections of all pairs of named sets."""
    d = sets.select(name, key).distinct()
    a, b = d.withColumnRenamed(name, "set_a"), d.withColumnRenamed(name, "set_b")
    return a.join(b, key).where("set_a <= set_b").groupBy("set_a", "set_b").agg(F.count("*").alias("n"))


def until_target(rows: DataFrame, order: str, accepted: Column, target: int) -> DataFrame:
    """The rows up to that which completes the target, all if it is not reached."""
    last = rows.where(accepted).select(F.col(order).alias("_o")).orderBy("_o").limit(target).agg(F.max("_o").alias("_last"), F.count("*").alias("_n"))
    return rows.join(F.broadcast(last)).where((F.col("_n") < target) | (F.col(order) <= F.col("_last"))).drop("_last", "_n")
