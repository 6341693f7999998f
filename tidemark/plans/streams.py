"""Streams over the driver's events, replayed to their end."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import collection as C
from ..streaming import running as R
from ..streaming import sessions as S
from .registry import query
from .sequences import PROGRESS, SIGNATURE_SQL, STREAK, W
from .tables import STEPS_SQL, steps, table


def stream(spark, d):
    # A glob, since a stream's source has to be a folder or a pattern.
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return rows.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value")


def replay(df, mode, **trigger):
    return S.run_to_table(df, mode, **trigger)


@query(f"""WITH {STEPS_SQL}, {PROGRESS}, {STREAK}, x AS (SELECT *, CASE WHEN lag({SIGNATURE_SQL}) OVER {W} = {SIGNATURE_SQL} THEN 0 ELSE 1 END AS c FROM r),
y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS j FROM x),
z AS (SELECT *, row_number() OVER {W} AS step, row_number() OVER (PARTITION BY user_id, j ORDER BY ts, event_id) AS run FROM y),
t AS (SELECT *, CASE WHEN run >= 3 THEN 'repeat_loop' WHEN streak >= 4 THEN 'no_progress' WHEN step >= 35 THEN 'max_steps' END AS reason FROM z)
SELECT user_id, count(*) AS steps, arg_max(streak, step) AS streak, count(DISTINCT k) AS seen, min(step) FILTER (WHERE reason IS NOT NULL) AS step, arg_min(reason, step) FILTER (WHERE reason IS NOT NULL) AS reason FROM t GROUP BY user_id""")
def stream_session_tracker(spark, d):
    """The last update of each session."""
    out = replay(S.track(stream(spark, d)), "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("streak", "seen", "step", "reason"), "steps").alias("x"), F.max("steps").alias("steps"))
    return last.select("user_id", "steps", "x.streak", "x.seen", "x.step", "x.reason")


@query()
def stream_lease_pool(spark, d):
    """Events as requests for twenty slots."""
    op = F.when(F.col("tool") == "view", "acquire").when(F.col("tool") == "purchase", "release").otherwise("operate")
    requests = stream(spark, d).select((F.col("user_id") % 20).alias("slot"), F.col("ts").cast("long").alias("at"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("token"), op.alias("op"), F.lit(900).alias("ttl"))
    return replay(S.leases(requests), "append").groupBy("slot", "op", "verdict").agg(F.count("*").alias("n"), F.max("generation").alias("generation"))


@query("SELECT event_type AS tool, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_dedupe_late(spark, d):
    """Every event once, by tool, though each is sent twice."""
    twice = stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return replay(S.once(twice, "event_id", "ts", "40 days"), "append").groupBy("tool").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type AS tool, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_watermark(spark, d):
    out = replay(S.tumbling(stream(spark, d), "ts", "1 day", "40 days", "tool"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "tool", "n")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 hours THEN 0 ELSE 1 END AS c FROM events),
y AS (SELECT user_id, ts, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, i""")
def stream_session_window(spark, d):
    out = replay(S.session_windows(stream(spark, d), "ts", "6 hours", "40 days", "user_id"), "complete")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@contextmanager
def scratch(spark):
    """A folder that the driver and the executors share, while a replay lasts."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a shared folder")
    folder = f"{shared}/replay-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tidemark-replay-")
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@query(f"WITH {STEPS_SQL} SELECT DISTINCT user_id % 7 AS task, k AS attempt, CAST(1 AS BIGINT) AS n FROM steps")
def stream_resumable_collection(spark, d):
    """How many events each task and attempt has, of its own, in a collection from several files that is stopped by failures and run on: one."""
    with scratch(spark) as folder:
        rows = table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("attempt"), F.col("event_type").alias("tool"))
        rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        attempts = stream.select((F.col("user_id") % 7).alias("task"), "attempt", "event_id", "tool")
        for _ in range(8):
            try:
                C.collect(attempts, ["task", "attempt"], ["event_id"], f"{folder}/out", f"{folder}/checkpoint", failed=F.col("tool") == "error")
                break
            except C.CollectionStopped:
                pass
        own = rows.select((F.col("user_id") % 7).alias("task"), "attempt", "event_id")
        found = C.collected(spark, f"{folder}/out").join(own, ["task", "attempt", "event_id"]).groupBy("task", "attempt").agg(F.count("*").alias("n"))
        # The folder goes with the replay, so that the rows are brought together here; there is one a task and attempt.
        return spark.createDataFrame(found.toArrow())


@query(f"""WITH {STEPS_SQL}, s AS (SELECT *, CASE WHEN tool = 'error' THEN 'guard' WHEN tool = 'view' THEN 'seen' ELSE 'opened' END AS kind FROM steps)
SELECT user_id AS session, kind, count(DISTINCT k) AS "distinct", count(*) AS steps, round(sum(value), 2) AS total, max(value) AS largest, bool_or(k > 95) AS flagged FROM s GROUP BY ALL""")
def stream_running_sets(spark, d):
    """What each session has seen by kind, and the sums of its steps, as they stand at the end of the stream."""
    kind = F.when(F.col("tool") == "error", "guard").when(F.col("tool") == "view", "seen").otherwise("opened")
    rows = stream(spark, d).select(F.col("user_id").alias("session"), kind.alias("kind"), F.col("k").cast("string").alias("value"), F.col("value").alias("amount"), (F.col("k") > 95).alias("flag"))
    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, rocks)
    try:
        out = replay(R.running(rows), "update", once=True)
    finally:
        spark.conf.set(name, before)
    last = out.groupBy("session", "kind").agg(F.max_by(F.struct("distinct", "total", "largest", "flagged"), "steps").alias("x"), F.max("steps").alias("steps"))
    return last.select("session", "kind", "x.distinct", "steps", F.round("x.total", 2).alias("total"), "x.largest", "x.flagged")


@query(f"""WITH RECURSIVE {STEPS_SQL}, b AS (SELECT user_id, event_id, tool = 'purchase' AND k > 70 AS ok, row_number() OVER {W} AS n FROM steps),
r AS (SELECT user_id, 0 AS n, CAST(0 AS BIGINT) AS update, 0 AS tries, 0 AS skipped, CAST(NULL AS BIGINT) AS event_id, '' AS verdict, CAST(0 AS BIGINT) AS next FROM (SELECT DISTINCT user_id FROM b)
  UNION ALL SELECT b.user_id, b.n, r.next, CASE WHEN b.ok OR r.tries = 2 THEN 0 ELSE r.tries + 1 END, CASE WHEN b.ok THEN 0 WHEN r.tries = 2 THEN r.skipped + 1 ELSE r.skipped END, b.event_id,
    CASE WHEN b.ok THEN 'used' WHEN r.tries = 2 AND r.skipped = 3 THEN 'stopped' WHEN r.tries = 2 THEN 'skipped' ELSE 'retried' END, r.next + CASE WHEN b.ok OR r.tries = 2 THEN 1 ELSE 0 END
    FROM r JOIN b ON b.user_id = r.user_id AND b.n = r.n + 1 WHERE r.verdict <> 'stopped')
SELECT user_id, update, event_id, verdict FROM r WHERE n > 0""")
def skip_budget(spark, d):
    """Each user's events as generation batches of three an update; four updates in a row without a useful one end the run."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = steps(spark, d).withColumn("n", place).withColumn("ok", (F.col("tool") == "purchase") & (F.col("k") > 70))
    found = C.skip_budget(rows, "user_id", "n", F.col("ok"), generations=3, skips=4)
    return found.withColumnRenamed("batch", "n").join(rows.select("user_id", "n", "event_id"), ["user_id", "n"]).select("user_id", "update", "event_id", "verdict")
