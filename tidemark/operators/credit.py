"""Credit of decisions from nested samples: shrinkage, held-out checks and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Training and gate continuations of a decision, and thresholds of a state.
TRAIN_SLOTS, GATE_SLOTS, LEAST_PROPOSALS, LEAST_DECISIONS, MOST_INVALID = 4, 4, 4, 2, 0.05


def variance_of_mean(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.var_samp(value) / F.count(value), 6).alias("variance_of_mean"))


def covariances(rows: DataFrame, state: str, decision: str, slot: str, value: str) -> DataFrame:
    """(state, d1, d2, covariance of the means) over aligned slots; those of different decisions count half."""
    a = rows.select(state, F.col(decision).alias("d1"), slot, F.col(value).alias("x"))
    b = rows.select(state, F.col(decision).alias("d2"), slot, F.col(value).alias("y"))
    both = a.join(b, [state, slot]).groupBy(state, "d1", "d2").agg((F.covar_samp("x", "y") / F.count("*")).alias("c"))
    return both.withColumn("c", F.when(F.col("d1") == F.col("d2"), F.col("c")).otherwise(F.col("c") * 0.5))


def shrinkage(decisions: DataFrame, samples: DataFrame, state: str = "state", decision: str = "decision", slot: str = "slot", value: str = "reward") -> DataFrame:
    """Per decision its shrunk value and advantage.

    decisions: (state, decision, proposals), the number of proposals that led to a decision; samples: a reward for each training slot.
    Decision means are drawn to the state's mean by the share of their spread that sampling noise does not explain, and
    advantages are scaled so that none exceeds a half.
    """
    w = Window.partitionBy(state)
    q = samples.groupBy(state, decision).agg(F.avg(value).alias("q"))
    p = decisions.withColumn("p", F.col("proposals") / F.sum("proposals").over(w)).select(state, decision, "p")
    cov = covariances(samples, state, decision, slot, value)
    share = p.select(state, F.col(decision).alias("d2"), F.col("p").alias("p2"))
    row = cov.join(share, [state, "d2"]).groupBy(state, F.col("d1").alias(decision)).agg(F.sum(F.col("c") * F.col("p2")).alias("row"), F.sum(F.when(F.col("d1") == F.col("d2"), F.col("c"))).alias("own"))
    d = p.join(q, [state, decision]).join(row, [state, decision])
    d = d.withColumn("mu", F.sum(F.col("p") * F.col("q")).over(w)).withColumn("noise", F.sum(F.col("p") * F.col("row")).over(w))
    d = d.withColumn("var", F.sum(F.col("p") * F.pow(F.col("q") - F.col("mu"), 2)).over(w))
    d = d.withColumn("uncertainty", F.greatest(F.sum(F.col("p") * F.col("own")).over(w) - F.col("noise"), F.lit(0.0)))
    d = d.withColumn("between", F.greatest(F.col("var") - F.col("uncertainty"), F.lit(0.0)))
    d = d.withColumn("kappa", F.col("between") / (F.col("between") + F.greatest(F.col("own") + F.col("noise") - 2 * F.col("row"), F.lit(0.0)) + 1e-8))
    d = d.withColumn("shrunk", F.col("mu") + F.col("kappa") * (F.col("q") - F.col("mu"))).withColumn("v", F.sum(F.col("p") * F.col("shrunk")).over(w))
    largest = F.max(F.abs(F.col("shrunk") - F.col("v"))).over(w)
    scale = F.when(largest == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 0.5 / largest))
    return d.withColumn("advantage", (F.col("shrunk") - F.col("v")) * scale).select(state, decision, "p", "q", "mu", "var", "uncertainty", "between", "kappa", "shrunk", "v", "advantage")


def structural_gate(states: DataFrame) -> DataFrame:
    """``states`` (proposals, decisions, slots_complete, train_valid, gate_valid, invalid_rate) with all failures, in order."""
    from .contracts import reasons

    failures = reasons(
        too_few_proposals=F.col("proposals") < LEAST_PROPOSALS,
        too_few_decisions=F.col("decisions") < LEAST_DECISIONS,
        incomplete_slots=~F.col("slots_complete"),
        invalid_train=~F.col("train_valid"),
        invalid_gate=~F.col("gate_valid"),
        invalid_rate=F.col("invalid_rate") > MOST_INVALID,
    )
    return states.withColumn("failures", F.array_join(failures, ",")).withColumn("eligible", F.size(failures) == 0)


def held_out(decisions: DataFrame, state: str, decision: str, train: str, gate: str) -> DataFrame:
    """Per state the best and worst decision by training mean, and what the difference is on held-out slots."""
    top, bottom = F.max(F.struct(train, decision, gate)), F.min(F.struct(train, decision, gate))
    d = decisions.groupBy(state).agg(top.alias("top"), bottom.alias("bottom"))
    delta = F.col(f"top.{gate}") - F.col(f"bottom.{gate}")
    identifiable = F.col(f"top.{train}") > F.col(f"bottom.{train}")
    return d.select(state, F.round(delta, 6).alias("delta"), identifiable.alias("identifiable"), (identifiable & (delta > 0)).alias("consistent"))


def linear_percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    out = [F.round(F.percentile(value, F.lit(s)), 6).alias(f"p{round(s * 1000)}") for s in shares]
    return rows.groupBy(*keys).agg(*out)
