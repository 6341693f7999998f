import pytest
from pyspark.sql import functions as F

from tidemark.operators import actions as A
from tidemark.operators import recovery as V
from tidemark.operators import rollouts as O
from tidemark.operators import spans as P
from tidemark.operators import trajectories as T
from tidemark.operators import variants as O2

DETAIL = "struct<reward_version:string,reward_type:string,reward_valid:boolean,purchase_success:boolean,termination_reason:string,terminal_utility:double,weighted_score:double>"
PROJECTION = "struct<truncated:boolean,raw_tokens:bigint,visible_tokens:bigint,footer:boolean>"
RAW = (
    "trajectory_id string, task_id long, status string, done boolean, final_reward double, infrastructure_invalid boolean, "
    f"steps array<struct<tool:string,parameters:map<string,string>,env_action:string,observation:string,call_id:string,parse_error:string,error:string,projection:{PROJECTION}>>, "
    "blocked array<struct<step_index:bigint,tool:string,parameters:map<string,string>,reason:string,call_id:string,parse_error:string>>, calls array<struct<call_id:string,content:string>>, "
    f"terminal struct<done:boolean,over:boolean,termination_reason:string,reward_detail:{DETAIL}>, context struct<input_tokens:array<double>,compactions:array<string>,truncations:array<string>>, "
    "trajectory_error string, release_error string"
)


def step(tool, parameters=None, env=None, seen="", call=None):
    return (tool, parameters, env, seen, call, None, None, None)


def raw(spark, steps, blocked, calls=(), status="done"):
    detail = ("v3", "gold_purchase", True, True, "gold_purchase", None, None)
    row = ("t", 1, status, True, 1.0, False, steps, blocked, list(calls), (True, True, None, detail), (None, None, None), None, None)
    return spark.createDataFrame([row], RAW)


def test_blocked_calls_come_before_the_step_of_their_position(spark):
    steps = [step("search_products", {"query": "a"}, call="c1"), step("buy_now")]
    blocked = [(2, "x", None, "late", None, None), (0, "y", None, "", "c1", None), (7, "z", None, "stray", None, None), (None, "w", None, "stray", None, None), (1, "v", None, "r", "c9", None)]
    events = T.normalized(raw(spark, steps, blocked, [("c1", "first"), ("c1", "last")])).first()
    assert [e.tool for e in events.events] == ["y", "search_products", "v", "buy_now", "x", "z", "w"]
    assert [e.event_id for e in events.events][:2] == ["e0001", "e0002"] and events.warnings == 2
    assert [e.executed_step_id for e in events.events] == [None, "s0000", None, "s0001", None, None, None]
    assert [e.assistant_text for e in events.events][:3] == ["last", "last", ""]
    assert events.events[0].guard_reason == "unknown"


def test_measures(spark):
    steps = [
        step("search_products", {"query": " Red  Cup", "note": "1"}, seen="12345678 and 123456789012345 and 87654321"),
        step("search_products", {"query": "red cup", "note": "2"}, seen="12345678"),
        step("open_product", {"asin": "5"}, env="click[ A ]"),
        step("open_product", {"asin": "6"}, env="CLICK[ a  ]"),
    ]
    m = T.metrics(T.normalized(raw(spark, steps, [])), "v3").first()
    assert m.reward_and_outcome.strict_gold_success and m.validity.trajectory_contract_valid and m.validity.judge_eligible
    assert (m.repetition.duplicate_search_query_count, m.repetition.duplicate_canonical_action_count) == (1, 1)
    assert (m.actions_and_efficiency.visible_search_candidate_count, m.actions_and_efficiency.opened_candidate_count) == (2, 2)
    assert m.actions_and_efficiency.tool_counts == {"open_product": 2, "search_products": 2}
    assert (m.context.input_token_turn_count, m.context.max_input_tokens, m.legality.tool_call_truncation_count) == (0, 0, 0)
    empty = T.metrics(T.normalized(raw(spark, None, None, status=None)), "v4").first()
    assert empty.actions_and_efficiency.action_attempts == 0 and empty.validity.trajectory_contract_issues == ["unexpected_reward_version"]


TRACE = "array<struct<tool:string,asin:string,value:string,accepted:boolean,error:string,guard_reason:string>>"
RECORD = f"group_id string, task_id long, reward_type string, valid_for_learning boolean, done boolean, infrastructure_invalid boolean, termination_reason string, guard_rejections int, repeat_actions int, trace {TRACE}, responses int, output_length int, source string"


def event(tool, asin=None, value=None, accepted=True, error=None):
    return (tool, asin, value, accepted, error, None)


def record(task, kind, trace, ended="max_steps", source="s", group="g", **other):
    row = {"guard_rejections": 0, "repeat_actions": 0, "responses": len(trace or []), "infrastructure_invalid": None} | other
    return (group, task, kind, True, True, row["infrastructure_invalid"], ended, row["guard_rejections"], row["repeat_actions"], trace, row["responses"], 9, source)


GOOD = [event("open_product", "1"), event("open_product", "2"), event("select_option", value="Red  Big"), event("buy_now")]


def test_why_a_gold_record_is_not_clean(spark):
    rows = [
        record(1, "gold_purchase", GOOD), record(1, "max_steps", GOOD), record(1, "gold_purchase", []), record(1, "gold_purchase", None), record(1, "gold_purchase", GOOD, guard_rejections=1),
        record(1, "gold_purchase", GOOD, repeat_actions=2), record(1, "gold_purchase", [event("buy_now", error="x")]), record(1, "gold_purchase", GOOD[:2]), record(1, "gold_purchase", GOOD, responses=1),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, RECORD).coalesce(1).select(V.clean_gold_reject_reason()).collect()]
    assert got == [None, "not_gold", "empty_action_trace", "empty_action_trace", "gold_has_guard_rejection", "gold_has_repeat_action", "gold_has_rejected_or_error_action", "gold_does_not_end_in_buy", "tool_response_count_mismatch"]


@pytest.mark.parametrize(
    "trace,ended,bucket,events",
    [
        ([event("buy_now")], "max_steps", 0, [2, 3]),
        ([event("open_product", "2")], "assistant_final", 1, [3]),
        ([event("open_product", "2"), event("select_option", value="red big")], "max_steps", 2, [3]),
        ([event("open_product", "2"), event("select_option", value="blue")], "max_steps", 3, [2, 3]),
        ([event("open_product", "1")], "assistant_final", 4, [2, 3]),
        ([event("open_product", "2", accepted=False)], "max_steps", 5, [1, 2, 3]),
    ],
)
def test_what_a_failure_teaches(spark, trace, ended, bucket, events):
    rows = [record(1, "gold_purchase", GOOD, source="b"), record(1, "gold_purchase", GOOD, source="a"), record(1, "x", trace, ended), record(1, "x", trace, ended, source="copy")]
    ids = spark.createDataFrame([(1,)], "task_id long")
    r = V.recovery_rows(spark.createDataFrame(rows, RECORD), ids, ids.where("false")).collect()
    assert [(x.reason, x.source, x.primary_bucket, x.failures, x.supervised_events) for x in r] == [(None, "a", V.BUCKETS[bucket], 1, events)]


def test_tasks_that_teach_nothing(spark):
    rows = [record(t, "gold_purchase", GOOD if t != 3 else GOOD[:2]) for t in range(1, 5)] + [record(t, "x", GOOD[:1], group="g" if t < 4 else "h") for t in range(1, 5)]
    ids = spark.createDataFrame([(1,), (3,), (4,)], "task_id long")
    r = V.recovery_rows(spark.createDataFrame(rows, RECORD), ids, ids.where("task_id = 1")).collect()
    assert {(x.task_id, x.reason) for x in r} == {(1, "held_out_task"), (2, "missing_prompt"), (3, "no_clean_gold")}
    assert V.recovery_rows(spark.createDataFrame([], RECORD), ids, ids).count() == 0


def test_prices(spark):
    texts = {
        "预算不超过1万2": [("lte", 12000.0)], "1万20以内": [("lte", 10020.0)], "1万20千以内": [("lte", 30000.0)], "价格控制在100-200元之间": [("between", 100.0)], "200到100元": [],
        "至少3千，不超过5k": [("gte", 3000.0), ("lte", 5000.0)], "50元左右": [("approximately", 50.0)], "300+": [("gte", 300.0)], "买3个": [], "": [], None: [],
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [[(s.operator, s.low) for s in r[0]] for r in rows.select(P.price_spans("t")).collect()]
    assert got == list(texts.values())


def test_exact_places(spark):
    rows = spark.createDataFrame([("aAa", "a"), ("x.y.", "."), ("😀红😀红", "红"), ("aaaa", "aa"), ("abc", ""), ("abc", None), (None, "a"), ("", "a")], "t string, v string").coalesce(1)
    got = [[tuple(s) for s in r[0]] for r in rows.select(P.exact_spans(F.col("t"), F.col("v"))).collect()]
    assert got == [[(0, 1), (1, 2), (2, 3)], [(1, 2), (3, 4)], [(1, 2), (3, 4)], [(0, 2), (2, 4)], [], [], [], []]


def test_a_value_on_two_axes_is_not_resolved(spark):
    options = "array<struct<axis:string,values:array<struct<value:string,price:double>>>>"
    row = spark.createDataFrame([([("颜色", [("Red", 1.0), ("red", 2.0)]), ("口味", [("red", None), ("Sweet", None)])], ["red", "sweet", None])], f"o {options}, v array<string>")
    found = row.select(O2.resolve(O2.indexed(F.col("o")), F.col("v")).alias("r"), O2.indexed(F.col("o")).alias("i")).first()
    assert [(r.axis, r.reason) for r in found.r] == [(None, "axis_ambiguous"), ("flavor", None), (None, "axis_not_found")]
    assert [(v.value, v.price) for v in found.i[0]["values"]] == [("red", 2.0)]


def test_actions_of_the_environment(spark):
    rows = [("search_products", {"query": "杯子"}), ("open_product", {"asin": "1"}), ("next_page", {}), ("finish_without_purchase", {"reason": "no"}), ("think", {}), ("open_product", {})]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, p map<string,string>").coalesce(1).select(A.environment_action(F.col("t"), F.col("p"))).collect()]
    assert got == ["search[杯子]", "click[1]", "click[Next >]", "finish[no]", None, None]


def test_secrets(spark):
    with pytest.raises(ValueError, match="a.My-Api_Key"):
        O.reject_secrets(spark.sql("SELECT named_struct('My-Api_Key', 1) AS a"))
    with pytest.raises(Exception, match="forbidden secret"):
        O.reject_secrets(spark.sql("SELECT map('Authorization', 1) AS m"), "m").collect()
    assert O.reject_secrets(spark.sql("SELECT 1 AS authorizations, map('k', 1) AS m"), "m").count() == 1
    assert O.hidden_fields(spark.sql("SELECT array(named_struct('goal', 1)) AS a"), ("goal",)) == ["a[].goal"]


def test_measures_that_nobody_reads_are_not_worked_out(spark):
    from tidemark.plans import trajectories as plan

    made = plan.assembled_results(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "guard_rejection" not in made and "says" not in made
