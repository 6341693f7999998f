import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import branches as B
from tidemark.streaming import collection as C

SCHEMA = "task long, attempt int, n long, error string"


def test_each_attempt_once_whatever_was_interrupted(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    batches = [[(1, 0, 1, None), (1, 0, 2, None), (2, 0, 3, "down")], [(2, 0, 4, None), (3, 0, 5, None)], [(3, 1, 6, None), (1, 0, 7, None)]]

    def arrive(k):
        spark.createDataFrame(batches[k], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run(**options):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        C.collect(stream, ["task", "attempt"], ["n"], out, checkpoint, failed=F.col("error").isNotNull(), **options)

    arrive(0)
    with pytest.raises(C.CollectionStopped):
        run()
    assert sorted(r.n for r in C.collected(spark, out).collect()) == [1, 3]
    run()  # goes on behind the failure
    arrive(1)

    def lost(rows, number):
        # The batch was written, but nobody learns of it: as if the driver had died.
        raise OSError("gone")

    with pytest.raises(Exception, match="gone"):
        run(after_commit=lost)
    finished = [k for k, done in C._batches(spark, out).items() if done]
    (tmp_path / "out" / f"batch={max(finished)}" / "_SUCCESS").unlink()  # and the batch is torn
    run()
    arrive(2)
    run()
    rows = C.collected(spark, out).collect()
    assert Counter((r.task, r.attempt) for r in rows) == Counter([(1, 0), (2, 0), (3, 0), (3, 1)])
    assert {(r.task, r.attempt): r.n for r in rows} == {(1, 0): 1, (2, 0): 3, (3, 0): 5, (3, 1): 6}
    shutil.rmtree(tmp_path, ignore_errors=True)


def test_skip_budget(spark):
    rows = [("a", k, k in (4, 5)) for k in range(1, 20)] + [("b", k, False) for k in range(1, 3)]
    df = spark.createDataFrame(rows, "run string, n int, ok boolean").repartition(3)
    got = {(r.run, r.batch): (r.update, r.verdict) for r in C.skip_budget(df, "run", "n", F.col("ok"), generations=3, skips=2).collect()}
    want = [(0, "retried"), (0, "retried"), (0, "skipped"), (1, "used"), (2, "used"), (3, "retried"), (3, "retried"), (3, "skipped"), (4, "retried"), (4, "retried"), (4, "stopped")]
    assert got == {**{("a", k + 1): v for k, v in enumerate(want)}, ("b", 1): (0, "retried"), ("b", 2): (0, "retried")}


def test_names_of_prefixes(spark):
    rows = [("x", 1, "a", True), ("x", 2, "b", False), ("x", 3, "b", True), ("x", 4, "c", True), ("y", 1, "a", True), ("y", 2, "b", True), ("y", 3, "d", True), ("z", 1, "b", True), ("z", 2, "a", True), ("z", 3, "c", True)]
    df = spark.createDataFrame(rows, "s string, n int, a string, ok boolean")
    got = {(r.s, r.n): (r.prefix_n, r.prefix_id) for r in B.with_prefix(df, "s", ["n"], F.col("ok"), F.col("a")).collect()}
    assert got["x", 1] == got["y", 1] == got["z", 1] == (0, "0-" + "0" * 15 + "-" + "0" * 15)
    assert got["x", 2] == got["x", 3] == got["y", 2] != got["z", 2] and got["x", 4] == got["y", 3] != got["z", 3]


def test_branches_of_a_state(spark):
    rows = [("s", 1, "a", True, 1.0), ("s", 1, "a", True, 1.0), ("s", 2, "b", False, 0.0), ("s", 3, "a", False, 0.5), ("s", 4, "a", True, 1.0), ("t", 5, "a", True, 1.0), ("u", 6, "a", True, 1.0), ("u", 7, "a", False, 1.0)]
    df = spark.createDataFrame(rows, "state string, event int, action string, won boolean, u double")
    got = {r.state: r for r in B.branch_groups(df, ["state"], "event", "action", "won", "u").collect()}
    assert set(got) == {"s", "u"} and (got["s"].visits, got["s"].unique_next_actions) == (4, 2)
    assert got["s"].natural_suffix_group_candidate and got["s"].eligible_mixed_strict and got["s"].utility_varying
    assert [(x.action, x.visits, x.strict, x.mean_utility) for x in got["s"].action_outcomes] == [("a", 3, 2, 2.5 / 3), ("b", 1, 0, 0.0)]
    assert got["u"].mixed_strict and not got["u"].eligible_mixed_strict and not got["u"].utility_varying


def test_running_sets_ask_only_for_known_kinds():
    import pandas as pd

    from tidemark.streaming.running import _Running

    class State(dict):
        asked = 0

        def containsKey(self, k):
            self.asked += 1
            return k in self

        def getValue(self, k):
            return self[k]

        def updateValue(self, k, v):
            self[k] = v

    run = _Running(1000)
    run.seen, run.counts = State(), State()
    rows = pd.DataFrame({"kind": ["a", "a", "b", None, "a"], "value": ["x", "x", None, "z", "y"], "amount": [1.0, None, 2.5, 9.0, 3.0], "flag": [False, None, True, True, None]})
    out = next(run.handleInputRows((7,), iter([rows, rows.head(2)]), None))
    assert sorted(map(tuple, out.itertuples(index=False))) == [(7, "a", 2, 5, 5.0, 3.0, False), (7, "b", 0, 1, 2.5, 2.5, True)]
    assert run.seen.asked == 0
    more = pd.DataFrame({"kind": ["a", "a"], "value": ["x", "w"], "amount": [None, 7.0], "flag": [True, False]})
    assert [tuple(r) for r in next(run.handleInputRows((7,), iter([more]), None)).itertuples(index=False)] == [(7, "a", 3, 7, 12.0, 7.0, True)]
    assert run.seen.asked == 2
    assert list(run.handleInputRows((8,), iter([rows[3:4]]), None)) == []
