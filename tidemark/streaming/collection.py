"""Collecting attempts from a stream into a table, each once, with restarts at any point.

Every micro-batch goes to a folder of its own, named by the batch's number, with the attempts that no earlier batch has. A batch that is run again
after a failure finds its folder finished and leaves it as it is, or writes it anew; so the checkpoint and the folders together give each
attempt once, whatever was interrupted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class CollectionStopped(RuntimeError):
    """An attempt failed for want of infrastructure; what had come until then is kept."""


def _batches(spark: SparkSession, folder: str) -> dict[int, bool]:
    """The numbers of the folder's batches, and whether they are finished."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return {int(n[6:]): fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")) for n in names if n.startswith("batch=")}


def collected(spark: SparkSession, folder: str) -> DataFrame:
    """All attempts of the finished batches, with the number of their ``batch``; an error if there is none."""
    done = sorted(k for k, finished in _batches(spark, folder).items() if finished)
    return spark.read.option("basePath", folder).parquet(*(f"{folder}/batch={k}" for k in done))


def collect(
    attempts: DataFrame,
    key: list[str],
    order: list[str],
    folder: str,
    checkpoint: str,
    failed: Column | None = None,
    after_commit: Callable[[DataFrame, int], None] | None = None,
) -> None:
    """Runs the stream over what its source holds now. Of attempts with the same key the first that came stays; within a batch the first by ``order``.

    An attempt for which ``failed`` holds is kept and stops the collection after its batch; the next run goes on behind it.
    ``after_commit`` sees the rows of each batch that was written.
    """
    def commit(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        present = _batches(own, folder)
        if present.get(number):
            return
        before = [f"{folder}/batch={k}" for k, finished in present.items() if finished and k < number]
        first = Window.partitionBy(*key).orderBy(*order)
        fresh = batch.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")
        if before:
            fresh = fresh.join(own.read.parquet(*before).select(*key), key, "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        written = own.read.schema(batch.schema).parquet(f"{folder}/batch={number}")
        if after_commit is not None:
            after_commit(written, number)
        if failed is not None and not written.where(failed).isEmpty():
            raise CollectionStopped(f"batch {number} has an attempt that failed for want of infrastructure")

    try:
        attempts.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    except Exception as e:
        if CollectionStopped.__name__ in str(e):
            raise CollectionStopped(str(e).splitlines()[0]) from e
        raise


def skip_budget(batches: DataFrame, run: str, order: str, useful: Column, generations: int = 3, skips: int = 10) -> DataFrame:
    """(run, update, batch, verdict) of a run's generation batches in their order: an update takes batches until one is useful or ``generations`` have gone.

    The verdict of a batch is used, retried (the update goes on), skipped (it ends without a useful one) or stopped: after ``skips`` skipped updates in
    a row, that of the last one; what comes after it is left out.
    """
    so_far = Window.partitionBy(run).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    rows = batches.select(run, F.col(order).alias("batch"), useful.alias("ok"))
    # Since the last useful batch, every ``generations`` batches are an update.
    rows = rows.withColumn("_since", F.coalesce(F.sum(F.col("ok").cast("int")).over(so_far), F.lit(0)))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(run, "_since").orderBy("batch")))
    full = (F.col("_place") % generations == 0) & ~F.col("ok")
    verdict = F.when(F.col("ok"), "used").when(full & (F.col("_place") >= generations * skips), "stopped").when(full, "skipped").otherwise("retried")
    rows = rows.withColumn("verdict", verdict)
    stopped = F.coalesce(F.max((F.col("verdict") == "stopped").cast("int")).over(so_far), F.lit(0))
    update = F.coalesce(F.sum((F.col("verdict") != "retried").cast("int")).over(so_far), F.lit(0))
    return rows.withColumn("update", update).withColumn("_stopped", stopped).where("_stopped = 0").select(run, "update", "batch", "verdict")
