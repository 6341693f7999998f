import hashlib
import json

from pyspark.sql import functions as F

from tidemark.operators import structure as S


def sha(value):
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_digests_are_of_canonical_json(spark):
    parameters = {"b": 'x"\n', "a": "é", "A": ""}
    df = spark.createDataFrame([([1, 22, 333], ("buy", parameters)), ([], ("q\\", {}))], "t array<int>, a struct<tool:string,parameters:map<string,string>>")
    got = [tuple(r) for r in df.coalesce(1).select(S.tokens_sha(F.col("t")), S.action_sha(F.col("a"))).collect()]
    assert got == [(sha([1, 22, 333]), sha({"tool": "buy", "parameters": parameters})), (sha([]), sha({"tool": "q\\", "parameters": {}}))]


def test_partition(spark):
    plan = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 0), (None, 0)], "s string, i int")
    found = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("b", 1), ("c", 0), (None, 0)], "s string, i int")
    got = {(r.s, r.i): r.fault for r in S.partition_faults(plan, found, "s", "i").collect()}
    assert got == {("a", 0): "duplicate", ("a", 1): "missing", ("b", 1): "extra", ("c", 0): "registered_twice"}
    assert S.partition_faults(plan.limit(0), found.limit(0), "s", "i").collect() == []


def test_a_state_is_ruled_out_as_a_whole(spark):
    rows = [("a", 0, None, "d", "1"), ("a", 1, S.REASONS[3], None, None), ("b", 0, None, "d", "1"), ("b", 1, None, "d", "2"), ("c", 0, None, "d", "1"), ("c", 1, None, "e", "2")]
    df = spark.createDataFrame(rows, "state_uid string, suffix_index int, reason string, decision string, evidence string")
    states = S.state_structure(df)
    got = {r.state_uid: (r.proposals, r.reasons, r.eligible) for r in states.collect()}
    assert got == {"a": (2, {S.REASONS[3]: 1}, False), "b": (2, {S.REASONS[7]: 1}, False), "c": (2, {}, True)}
    assert tuple(S.exclusion_counts(states).first()) == (3, 6, 1, 2, 2, 4)
    assert tuple(S.exclusion_counts(states.limit(0)).first()) == (0, 0, 0, 0, 0, 0)
