"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; a temporary one only where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes, as JSON, up to which a side that has been measured is broadcast.
BROADCAST_BYTES = 32_000_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast if its rows come to BROADCAST_BYTES at most, which is measured; else left to a shuffled join."""
    measured = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if measured <= BROADCAST_BYTES else df


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """``rows`` with their place by ``order``, from 0, as a column. They are sorted by ranges; only the ranges' row counts reach the driver."""
    rows = cut(rows.orderBy(*order))
    at = F.spark_partition_id()
    counts = {r.at: r.n for r in rows.groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect()}
    first, so_far = [], 0
    for k in range(max(counts, default=0) + 1):
        first.append(F.lit(so_far).cast("long"))
        so_far += counts.get(k, 0)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return cut(rows.withColumn(name, F.get(F.array(*first), at) + within))


class ByteBound(dict):
    """A cache that is emptied when its keys, as characters or bytes, and what an entry takes besides come to ``LIMIT`` bytes; long keys aren't kept."""

    LIMIT, ENTRY, LONGEST = 50_000_000, 150, 1_000

    def __init__(self) -> None:
        super().__init__()
        self._held = 0

    def keep(self, key, value):
        if len(key) <= self.LONGEST:
            self._held += len(key) + self.ENTRY
            if self._held > self.LIMIT:
                self.clear()
                self._held = len(key) + self.ENTRY
            self[key] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the ASCII white space characters (space, \\t to \\r)."""
    return text.encode().lower().split() if text else []


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b long); component is the smallest node reachable.

    Each round sends every node of the contracted graph to its smallest neighbour, halves the paths and
    contracts. All groups are reduced by ``min`` before they are shuffled and the joins have a unique side,
    so that a hub costs no more than its edges and adaptive execution can split it.
    """
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        parent = cut(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")))
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
        parent = cut(parent.join(up, "p").select("u", F.col("q").alias("p")))
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            up = parent.select(F.col("u").alias("component"), F.col("p").alias("q"))
            labels = cut(labels.join(up, "component", "left").select("node", F.coalesce("q", "component").alias("component")))
        a, b = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        e = cut(e.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if e.isEmpty():
            return labels
