import pytest
from pyspark.sql import functions as F

from tidemark.operators import turn_spans as T

TURN = "array<struct<turn_id:int,kind:string,generated_token_count:int,credit_eligible:boolean>>"


def materialised(spark, turns, mask):
    turns = [(*t, None) if len(t) == 3 else t for t in turns]
    df = spark.createDataFrame([(turns, mask)], f"turns {TURN}, mask array<int>").withColumn("runs", T.runs(F.col("mask")))
    return df.select("mask", "runs", T.materialised(F.col("turns"), F.col("mask"), F.col("runs")).alias("m"))


def spans(row):
    return [(s.start, s.end, s.observation_end) for s in row.spans]


def test_turns_take_the_runs_of_the_mask(spark):
    turns = [(0, "tool_call", 2), (1, "tool_call", 1), (2, "assistant_termination", 2)]
    m = materialised(spark, turns, [1, 1, 0, 0, 1, 0, 0, 1, 1]).first().m
    assert m.fault is None and spans(m) == [(0, 2, 4), (4, 5, 7), (7, 9, 9)]


def test_only_a_final_turn_is_cut_short(spark):
    assert materialised(spark, [(0, "tool_call", 3)], [1, 1]).first().m.fault == "token_count_mismatch"
    m = materialised(spark, [(0, "tool_call", 2, True), (1, "assistant_termination", 5, False)], [1, 1, 0, 1, 1]).first().m
    assert spans(m)[0] == (0, 2, 3) and m.spans[1].truncated and not m.spans[1].credit_eligible
    m = materialised(spark, [(0, "tool_call", 2, True), (1, "assistant_termination", 5, False)], [1, 1, 0]).first().m
    assert m.fault is None and spans(m) == [(0, 2, 3)] and m.spans[0].credit_eligible


@pytest.mark.parametrize(
    ("turns", "mask", "fault"),
    [
        ([(0, "tool_call", 1)], [0, 1], "mask_begins_without_a_turn"),
        ([(0, "tool_call", 1)], [1, 2], "mask_is_not_binary"),
        ([], [1, 0, 1], "turns_and_runs_differ"),
        ([(0, "tool_call", 1), (1, "tool_call", 1)], [1, 0], "only_a_final_turn_may_be_missing"),
        ([(0, "tool_call", 1), (0, "tool_call", 1)], [1, 0, 1], "repeated_turn"),
        ([(0, "other", 1)], [1], "unknown_kind"),
        ([(0, "assistant_termination", 1), (1, "tool_call", 1)], [1, 0, 1], "turn_after_the_final_one"),
        ([(0, "assistant_termination", 1)], [1, 0], "final_turn_with_observation"),
        ([(0, "tool_call", 1, True)], [1], "observation_missing"),
    ],
)
def test_faults(spark, turns, mask, fault):
    m = materialised(spark, turns, mask).first().m
    assert m.fault == fault and m.spans == []


def test_removal_and_cut(spark):
    turns = [(0, "tool_call", 2), (1, "tool_call", 1), (2, "assistant_termination", 2)]
    df = materialised(spark, turns, [1, 1, 0, 0, 1, 0, 0, 1, 1])
    get = lambda c: df.select(c.alias("x")).first().x
    whole = F.col("m.spans")
    assert [get(T.removable(whole, F.lit(k))) for k in (3, 4, 6, 9)] == [0, 4, 4, 9]
    moved = get(T.rebased(whole, F.lit(4)))
    assert spans(moved) == [(0, 1, 3), (3, 5, 5)] and moved.fault is None
    assert get(T.rebased(whole, F.lit(1))).fault == "span_cut_in_two" and get(T.rebased(whole, F.lit(-1))).fault == "negative_removal"
    after = F.array(*map(F.lit, (1, 0, 0, 1)))
    df = df.select("*", T.rebased(whole, F.lit(4)).alias("r")).withColumn("after", after).withColumn("ends", T.runs(F.col("after")))
    done = df.select(T.finalised(F.col("r.spans"), F.col("after"), F.col("ends")).alias("x")).first().x
    assert done.fault is None and spans(done) == [(0, 1, 3), (3, 4, 4)] and [s.truncated for s in done.spans] == [False, True]
    bad = df.select(T.finalised(F.col("m.spans"), F.col("after"), F.col("ends")).alias("x")).first().x
    assert bad.fault == "spans_are_not_the_runs" and bad.spans == []
    none = spark.createDataFrame([([],)], "mask array<int>").select(T.runs(F.col("mask")).alias("x")).first().x
    assert none == []
