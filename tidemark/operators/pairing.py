"""Two runs over the same tasks: flips, exact tests and resampling."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logic import mean_of


def transitions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Tasks of both runs with their strict outcomes (``ok``) and the kind of flip."""
    joined = a.select(key, F.col("ok").alias("a_ok")).join(b.select(key, F.col("ok").alias("b_ok")), key)
    flip = F.when(F.col("a_ok") & ~F.col("b_ok"), "loss").when(~F.col("a_ok") & F.col("b_ok"), "gain").when(F.col("a_ok"), "both").otherwise("neither")
    return joined.withColumn("flip", flip)


def mcnemar(gains: Column, losses: Column) -> Column:
    """Exact two-sided p of the discordant pairs: min(1, 2 * sum of C(n, k) / 2^n for k up to the smaller count); 1 without any.

    The terms are a running product, so that no factorial overflows.
    """
    n, m = gains + losses, F.least(gains, losses)
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.pow(F.lit(0.5), n).alias("total"))
    steps = F.when(m > 0, F.sequence(F.lit(1).cast("bigint"), m)).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * (n - k + 1) / k
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(steps, start, step, lambda acc: acc["total"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * total))


def delta_summary(pairs: DataFrame, keys: list[str], delta: Column) -> DataFrame:
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        mean_of(delta).alias("mean_delta"),
        F.count_if(delta > 0).alias("improved"),
        F.count_if(delta == 0).alias("unchanged"),
        F.count_if(delta < 0).alias("worsened"),
    )


def run_pairs(rows: DataFrame, run: str, key: str, ok: str) -> DataFrame:
    """Every two runs over their common tasks; one shuffle on the task, as many rows a task as it has runs."""
    a, b = (rows.select(F.col(run).alias(f"run_{x}"), key, F.col(ok).alias(f"ok_{x}")) for x in "ab")
    joined = a.join(b, key).where("run_a < run_b")
    return joined.groupBy("run_a", "run_b").agg(
        F.count("*").alias("n"), F.count_if(F.expr("ok_a AND NOT ok_b")).alias("losses"), F.count_if(F.expr("NOT ok_a AND ok_b")).alias("gains")
    )


#: Replicates that one digest serves: four numbers of 60 bits, three draws of 20 bits in each.
PER_DIGEST, DRAW_BITS = 12, 20


def poisson_thresholds() -> list[int]:
    """The draws from which on a weight is at least 1, 2, ...: Poisson with mean one."""
    out, term, total = [], exp(-1), 0.0
    for k in range(1, 12):
        total += term
        out.append(int(total * (1 << DRAW_BITS)))
        term /= k
    return [t for t in out if t < 1 << DRAW_BITS]


#: Values are summed up as whole numbers of this part of one, so that sums are exact.
_PART = 1_000_000


def _replicated(clusters: DataFrame, value: str, cluster: str, replicates: int, seed: int, weights: np.ndarray, weighed: bool = True) -> DataFrame:
    """(r, total, weight): sums of the weighted values and of the weights by replicate; ``weights`` has the weight of each draw of 20 bits.

    A cluster's weights are drawn where its row lies, from digests that any engine with SHA-256 repeats: five hexadecimal digits a draw. A task holds
    a number or two for each replicate and gives these sums, whatever the number of its clusters. Values are rounded to six digits. Where the weights' sums are not asked for (``weighed``), zeros are not drawn for.
    """
    groups = -(-replicates // PER_DIGEST)
    weights = weights.astype(np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What all clusters' digests begin with is hashed once.
        begun = [sha256(f"{seed}:{g}:".encode()) for g in range(groups)]
        total, weight = np.zeros((PER_DIGEST, groups), dtype=np.int64), np.zeros((PER_DIGEST, groups), dtype=np.int64)
        draws = np.empty((PER_DIGEST, groups), dtype=np.uint64)
        for b in batches:
            for v, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not v and not weighed:
                    continue
                digests, name = [], c.encode()
                for h in begun:
                    h = h.copy()
                    h.update(name)
                    digests.append(h.digest())
                words = np.ascontiguousarray(np.frombuffer(b"".join(digests), dtype=">u8").reshape(groups, 4).T).astype(np.uint64)
                for r in range(PER_DIGEST):
                    # Of the three draws in a number the last digits come first.
                    k, past = divmod(DRAW_BITS * (r // 3 * 3 + 2 - r % 3), 64)
                    np.left_shift(words[k], np.uint64(past), out=draws[r])
                    if past + DRAW_BITS > 64:
                        draws[r] |= words[k + 1] >> np.uint64(64 - past)
                draws >>= np.uint64(64 - DRAW_BITS)
                w = weights[draws]
                total += np.multiply(w, v, dtype=np.int64)
                weight += w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups * PER_DIGEST)), pa.array(total.T.ravel()), pa.array(weight.T.ravel())], ["r", "total", "weight"])

    whole = (F.col(value).cast("decimal(18,6)") * _PART).cast("bigint")
    # Few rows make much work: they are dealt to all cores, which Spark would not do for their size.
    dealt = clusters.select(whole.alias("v"), F.col(cluster).cast("string").alias("c")).repartition(clusters.sparkSession.sparkContext.defaultParallelism, "c")
    sums = dealt.mapInArrow(run, "r long, total long, weight long").where(F.col("r") < replicates).groupBy("r").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    return sums.select("r", (F.col("total").cast("double") / _PART).alias("total"), F.col("weight").cast("double").alias("weight"))


def _mean(clusters: DataFrame, value: str) -> DataFrame:
    return clusters.agg((F.sum(F.col(value).cast("decimal(18,6)")).cast("double") / F.count(value)).alias("observed"), F.count(value).alias("n"))


def bootstrap_ci(clusters: DataFrame, value: str, cluster: str, replicates: int = 20_000, seed: int = 0) -> DataFrame:
    """(mean_delta, low, high): mean over the clusters, and the linear 2.5 and 97.5 percentiles of its resampled means; one row, nulls if there are none.

    ``clusters`` has a row each, named by ``cluster``. A replicate gives each a Poisson weight with mean one: drawing as many clusters as there are with
    replacement, but for the number drawn, which varies and is divided by. So no replicate has to see all clusters in one place.
    """
    steps = poisson_thresholds()
    rows = clusters.where(F.col(value).isNotNull())
    means = _replicated(rows, value, cluster, replicates, seed, np.searchsorted(np.array(steps), np.arange(1 << DRAW_BITS), side="right"))
    spread = means.where("weight > 0").select((F.col("total") / F.col("weight")).alias("m")).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return _mean(rows, value).join(F.broadcast(spread)).select(F.round("observed", 6).alias("mean_delta"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def sign_flip(clusters: DataFrame, value: str, cluster: str, replicates: int = 20_000, seed: int = 0) -> DataFrame:
    """One-sided p of the mean against sign flips of the clusters, (exceeding + 1) / (replicates + 1), and the null's 95th percentile."""
    rows = clusters.where(F.col(value).isNotNull())
    half = 1 << (DRAW_BITS - 1)
    means = _replicated(rows, value, cluster, replicates, seed, np.where(np.arange(1 << DRAW_BITS) >= half, 1, -1), weighed=False)
    null = means.join(F.broadcast(_mean(rows, value))).select((F.col("total") / F.col("n")).alias("m"), "observed")
    return null.agg(
        F.round(F.first("observed"), 6).alias("observed"),
        F.round((F.count_if(F.col("m") >= F.col("observed")) + 1) / (F.count("*") + 1), 6).alias("p"),
        F.round(F.percentile("m", F.lit(0.95)), 6).alias("null_95"),
    )
