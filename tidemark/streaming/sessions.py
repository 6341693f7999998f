"""Stateful streams: the evidence tracker of sessions, a lease pool, and late and duplicate events."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Limits of a session.
MOST_REPEATS, MOST_STALLED, MOST_STEPS = 2, 4, 35

_OUT = "user_id long, steps long, streak long, seen long, step long, reason string"
_STATE = "steps long, streak long, repeats long, last string, seen string, step long, reason string"


def _track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    steps, streak, repeats, last, seen_text, step, reason = state.get if state.exists else (0, 0, 0, None, "", None, None)
    seen = set(seen_text.split(",")) if seen_text else set()
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    for tool, k in zip(rows["tool"], rows["k"], strict=True):
        signature = f"{tool}:{k % 3}"
        steps += 1
        repeats = repeats + 1 if signature == last else 0
        last = signature
        streak = streak + 1 if str(k) in seen else 0
        seen.add(str(k))
        if reason is None:
            reason = "repeat_loop" if repeats >= MOST_REPEATS else "no_progress" if streak >= MOST_STALLED else "max_steps" if steps >= MOST_STEPS else None
            step = steps if reason else None
    state.update((steps, streak, repeats, last, ",".join(sorted(seen)), step, reason))
    yield pd.DataFrame({"user_id": [key[0]], "steps": [steps], "streak": [streak], "seen": [len(seen)], "step": pd.array([step], dtype="Int64"), "reason": [reason]})


def track(steps: DataFrame) -> DataFrame:
    """Updates of sessions (user_id, ts, event_id, tool, k): steps so far, stalled steps, evidence seen, and when and why it ended.

    What is kept of a session is bounded by the distinct arguments of its steps.
    """
    return steps.groupBy("user_id").applyInPandasWithState(_track, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def _lease(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    generation, holder, expiry = state.get if state.exists else (0, None, 0)
    out = []
    for r in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples():
        if holder is not None and r.at >= expiry:
            holder = None
        if r.op == "acquire":
            verdict = "recovered" if holder == r.token else "granted" if holder is None else "busy"
            if verdict == "granted":
                generation, holder = generation + 1, r.token
        else:
            verdict = "rejected" if holder != r.token else "released" if r.op == "release" else "ok"
        if verdict in ("granted", "recovered", "ok"):
            expiry = int(r.at) + int(r.ttl)
        if verdict == "released":
            holder = None
        out.append((key[0], int(r.at), r.token, r.op, verdict, generation))
    state.update((generation, holder, expiry))
    yield pd.DataFrame(out, columns=["slot", "at", "token", "op", "verdict", "generation"])


def leases(requests: DataFrame) -> DataFrame:
    """Verdicts on requests (slot, at, token, op, ttl): a slot has one holder at a time, until it is released or its lease runs out.

    Every grant raises the slot's generation; requests with a token that no longer holds the slot are rejected.
    """
    return requests.groupBy("slot").applyInPandasWithState(
        _lease, "slot long, at long, token string, op string, verdict string, generation long", "generation long, holder string, expiry long", "append", GroupStateTimeout.NoTimeout
    )


def once(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once; what comes later than the watermark allows is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by window and keys (an extension: nothing in the reference has windows in time)."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def session_windows(events: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Counts by session windows (an extension)."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def kept_folder(spark: SparkSession) -> str:
    """A folder that the driver and the executors share, until the session's JVM ends: under spark.checkpoint.dir, a temporary one where all runs on
    this machine, else under the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="tidemark-replay-")
    else:
        folder = f"{(shared or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/replay-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def run_to_table(stream: DataFrame, mode: str, **trigger: bool) -> DataFrame:
    """Runs a stream over what its source holds now and returns what it gave, which is kept in files: nothing of it passes the driver.

    In complete mode the last batch's rows count, each of which is all rows. Streams that keep time by the clock never have nothing left to do;
    ``once=True`` ends them after a batch.
    """
    spark: SparkSession = stream.sparkSession
    folder = kept_folder(spark)
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True}))
    if mode == "append":
        out = out.format("parquet").option("path", f"{folder}/out")
    else:

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out/b{0 if mode == 'complete' else number}")

        out = out.foreachBatch(keep)
    out.start().awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema)
    return rows.parquet(f"{folder}/out") if mode == "append" else rows.parquet(f"{folder}/out/b*")
