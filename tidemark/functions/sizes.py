"""Sizes that are measured before a plan depends on them, and results that several parts of a plan use."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes, as JSON, up to which a side that has been measured is broadcast.
BROADCAST_BYTES = 32_000_000


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast if its rows come to ``limit`` bytes at most, which is measured; else left to a shuffled join."""
    measured = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if measured <= limit else df


def written(df: DataFrame) -> DataFrame:
    """``df``, worked out once for all its uses: checkpointed in spark.checkpoint.dir, in a temporary folder where all runs on this machine.

    A cluster without a shared folder works it out for each use.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                return df
            shared = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
