"""Sessions as raw trajectories, and attempts that failed next to attempts that did not, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recovery as V
from ..operators import trajectories as T
from .registry import query
from .tables import STEPS_SQL, steps

VERSION = "reward-v3"

# A user's events are a trajectory: errors are blocked calls, the others steps. A blocked call stands before the step that follows it,
# or nowhere if its argument is divisible by ten. Calls are numbered by event; the assistant says something in two of three.

TOOLS = {"view": "open_product", "click": "select_option", "signup": "search_products", "purchase": "buy_now", "error": "view_reviews"}
SHOWN_SQL = "CASE tool WHEN 'view' THEN 'open_product' WHEN 'click' THEN 'select_option' WHEN 'signup' THEN 'search_products' WHEN 'purchase' THEN 'buy_now' ELSE 'view_reviews' END"
RAW_SQL = f"""{STEPS_SQL}, e AS (SELECT user_id, event_id, k, value, tool = 'error' AS blocked, {SHOWN_SQL} AS tool, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'says ' || event_id END AS said,
  coalesce(count(*) FILTER (WHERE tool <> 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
  CASE WHEN tool = 'error' AND k % 10 = 0 THEN 1 ELSE 0 END AS stray, CASE WHEN k % 4 = 0 THEN 'schema_x' WHEN k % 4 = 1 THEN '' ELSE 'not_visible' END AS reason FROM steps),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY stray, event_id) AS n FROM e)"""


def _by_event(a, b):
    return F.when(a["event_id"] < b["event_id"], -1).when(a["event_id"] > b["event_id"], 1).otherwise(0)


def raw(spark, d):
    tool, k, i = F.col("tool"), F.col("k"), F.col("event_id")
    shown = F.element_at(F.create_map(*(F.lit(x) for kv in TOOLS.items() for x in kv)), tool)
    value = (k % 5).cast("string")
    parameters = F.when(tool == "view", F.create_map(F.lit("asin"), value)).when(tool == "signup", F.create_map(F.lit("query"), F.concat(F.lit(" Q  "), value), F.lit("note"), i.cast("string"))).otherwise(F.create_map(F.lit("value"), value))
    projection = F.when(k % 2 == 0, F.struct((k > 50).alias("truncated"), k.cast("bigint").alias("raw_tokens"), (k / 2).cast("bigint").alias("visible_tokens"), (k % 6 == 0).alias("footer")))
    none = F.lit(None).cast("string")
    step = F.struct(
        i.alias("event_id"), shown.alias("tool"), parameters.alias("parameters"), none.alias("env_action"), F.concat(F.lit("hit "), (F.lit(10_000_000) + k).cast("string")).alias("observation"), i.cast("string").alias("call_id"),
        F.when(k == 7, "invalid_json").alias("parse_error"), F.when(k == 9, "refused").alias("error"), projection.alias("projection"),
        (k % 2 == 1).alias("latest_observation_truncated"), (k % 6 == 5).alias("done"),
    )
    reason = F.when(k % 4 == 0, "schema_x").when(k % 4 == 1, "").otherwise("not_visible")
    guard = F.struct(i.alias("event_id"), F.when(k % 10 == 0, -1).cast("bigint").alias("step_index"), shown.alias("tool"), parameters.alias("parameters"), reason.alias("reason"), i.cast("string").alias("call_id"), F.when(k == 7, "invalid_json").alias("parse_error"), (k % 3).cast("bigint").alias("guard_consecutive_count"))
    said = F.when(i % 3 != 0, F.struct(i.alias("event_id"), i.cast("string").alias("call_id"), F.concat(F.lit("says "), i.cast("string")).alias("content")))
    rows = steps(spark, d).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.when(tool != "error", step)), _by_event).alias("steps"),
        F.array_sort(F.collect_list(F.when(tool == "error", guard)), _by_event).alias("blocked"),
        F.array_sort(F.collect_list(said)).alias("calls"),
        F.count_if((tool == "purchase") & (k < 4)).alias("buys"),
    )
    before = F.transform("blocked", lambda b: b.withField("step_index", F.coalesce(b["step_index"], F.size(F.filter("steps", lambda s: s["event_id"] < b["event_id"])).cast("bigint"))))
    u = F.col("user_id")
    bought = F.col("buys") > 0
    kind = F.when(bought, "gold_purchase").otherwise("max_steps")
    detail = F.when(u % 11 != 0, F.struct(F.when(u % 13 == 0, "old").otherwise(VERSION).alias("reward_version"), kind.alias("reward_type"), F.lit(True).alias("reward_valid"), bought.alias("purchase_success"), kind.alias("termination_reason"),
        F.col("buys").cast("double").alias("terminal_utility"), F.lit(0.5).alias("weighted_score")))
    return rows.select(
        u.cast("string").alias("trajectory_id"), u.alias("task_id"), F.when(u % 17 == 0, "max_steps").otherwise("done").alias("status"), (u % 5 != 0).alias("done"), F.col("buys").cast("double").alias("final_reward"),
        F.lit(False).alias("infrastructure_invalid"), "steps", before.alias("blocked"), "calls", F.struct(F.lit(True).alias("done"), (u % 7 != 0).alias("over"), none.alias("termination_reason"), detail.alias("reward_detail")).alias("terminal"),
        F.struct(F.transform("steps", lambda s: s["projection"]["raw_tokens"].cast("double")).alias("input_tokens"), F.array(F.lit("x")).alias("compactions"), F.array().cast("array<string>").alias("truncations")).alias("context"),
        F.when(u % 19 == 0, "TimeoutError").when(u % 23 == 0, "ValueError").alias("trajectory_error"), F.when(u % 29 == 0, "Closed").alias("release_error"),
    )


@query(f"""WITH {RAW_SQL} SELECT user_id AS task_id, printf('e%04d', n) AS event_id, printf('a%04d', n) AS action_attempt_id, CASE WHEN blocked THEN '' ELSE printf('s%04d', place) END AS executed_step_id,
  CASE WHEN blocked THEN 'guard_rejection' ELSE 'tool_step' END AS event_type, CASE WHEN stray = 1 THEN -1 ELSE place END AS source_index, tool, said AS assistant_text,
  CASE WHEN NOT blocked THEN '' WHEN reason = '' THEN 'unknown' ELSE reason END AS guard_reason FROM o""")
def normalised_trajectories(spark, d):
    """Steps and blocked calls as one stream, each with the assistant's text that made it."""
    # explode() would have the optimizer work the events out once more, in a filter on their number.
    events = T.normalized(raw(spark, d)).select("task_id", F.explode_outer("events").alias("e")).where("e IS NOT NULL")
    blank = F.lit("")
    return events.select("task_id", "e.event_id", "e.action_attempt_id", F.coalesce("e.executed_step_id", blank).alias("executed_step_id"), "e.event_type", "e.source_index", "e.tool", "e.assistant_text", F.coalesce("e.guard_reason", blank).alias("guard_reason"))


METRICS_SQL = f"""{RAW_SQL}, g AS (SELECT *, CASE WHEN tool = 'search_products' THEN tool || ':q ' || k % 5 ELSE tool || ':' || k % 5 END AS sig FROM o),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, sig ORDER BY n) > 1 AS again, lag(sig) OVER (PARTITION BY user_id ORDER BY n) = sig AS same FROM g),
q AS (SELECT user_id, n, sig, row_number() OVER (PARTITION BY user_id, sig ORDER BY n) > 1 AS again, lag(sig) OVER (PARTITION BY user_id ORDER BY n) = sig AS same FROM g WHERE tool = 'search_products' AND NOT blocked),
qs AS (SELECT user_id, count_if(again) AS qa, count_if(same) AS qb FROM q GROUP BY 1),
x AS (SELECT user_id AS u, count(*) AS attempts, count_if(NOT blocked) AS steps, count_if(blocked) AS guards, count_if(again) AS dup, count_if(same) AS seq, count_if(stray = 1) AS strays, count_if(NOT blocked AND tool = 'buy_now' AND k < 4) AS buys,
  count_if(NOT blocked AND tool = 'search_products') AS searches, count_if(NOT blocked AND tool = 'open_product') AS opens, count(DISTINCT CASE WHEN NOT blocked AND tool = 'open_product' THEN k % 5 END) AS opened,
  count(DISTINCT CASE WHEN NOT blocked AND tool = 'search_products' THEN k END) AS seen, count_if(k = 7) AS malformed, count_if(blocked AND reason = 'schema_x') AS schema_rejections, count_if(NOT blocked AND k = 9) AS step_errors,
  count_if(NOT blocked AND k % 2 = 0) AS shown, count_if(NOT blocked AND k % 2 = 0 AND k > 50) AS cut, coalesce(sum(k) FILTER (WHERE NOT blocked AND k % 2 = 0), 0) AS raw_tokens, count_if(NOT blocked AND k % 2 = 0 AND k % 6 <> 0) AS footers,
  coalesce(max(k) FILTER (WHERE NOT blocked AND k % 2 = 0), 0) AS most, count_if(blocked AND reason = '') AS unknown FROM s GROUP BY 1),
y AS (SELECT *, u % 17 <> 0 AS fin, u % 11 <> 0 AS detailed FROM x LEFT JOIN qs ON u = user_id)"""


@query(f"""WITH {METRICS_SQL} SELECT u AS task_id, CASE WHEN NOT detailed THEN 'unknown' WHEN buys > 0 THEN 'gold_purchase' ELSE 'max_steps' END AS reward_type,
  CASE WHEN detailed THEN CASE WHEN buys > 0 THEN 'gold_purchase' ELSE 'max_steps' END WHEN fin THEN 'done' ELSE 'max_steps' END AS termination_reason, CAST(buys AS DOUBLE) AS terminal_utility,
  fin AND detailed AND u % 13 <> 0 AND u % 5 <> 0 AND u % 7 <> 0 AND buys > 0 AS strict_gold_success, NOT fin OR (detailed AND buys = 0) AS max_steps_termination,
  attempts AS action_attempts, steps AS executed_tool_steps, searches AS search_count, opens AS open_product_count, opened AS opened_candidate_count, seen AS visible_search_candidate_count,
  dup AS duplicate_actions, seq AS consecutive_actions, coalesce(qa, 0) AS duplicate_searches, coalesce(qb, 0) AS consecutive_searches, guards AS guard_rejections, unknown AS unknown_guards, schema_rejections, malformed, step_errors,
  shown AS projections, cut AS truncated, CAST(raw_tokens AS BIGINT) AS raw_tokens, footers AS footer_failures, CAST(raw_tokens AS BIGINT) AS input_tokens, CAST(most AS BIGINT) AS max_input_tokens,
  u % 19 = 0 OR u % 29 = 0 AS infrastructure_invalid, concat_ws(',', CASE WHEN fin AND u % 5 = 0 THEN 'done_status_without_trajectory_done' END, CASE WHEN fin AND u % 7 = 0 THEN 'done_status_without_terminal_over' END,
    CASE WHEN fin AND NOT detailed THEN 'done_status_without_reward_detail' END, CASE WHEN detailed AND u % 13 = 0 THEN 'unexpected_reward_version' END, CASE WHEN strays > 0 THEN 'normalization_warnings' END) AS issues FROM y""")
def trajectory_metrics(spark, d):
    """The recorded measures of every session."""
    m = T.metrics(T.normalized(raw(spark, d)), VERSION)
    o, a, p, g, c, v = "reward_and_outcome", "actions_and_efficiency", "repetition", "legality", "context", "validity"
    texts = {"reward_type": o, "termination_reason": o, "terminal_utility": o, "strict_gold_success": o, "max_steps_termination": o, "infrastructure_invalid": v}
    counts = {
        "action_attempts": f"{a}.action_attempts", "executed_tool_steps": f"{a}.executed_tool_steps", "search_count": f"{a}.search_count", "open_product_count": f"{a}.open_product_count",
        "opened_candidate_count": f"{a}.opened_candidate_count", "visible_search_candidate_count": f"{a}.visible_search_candidate_count", "duplicate_actions": f"{p}.duplicate_canonical_action_count",
        "consecutive_actions": f"{p}.consecutive_duplicate_action_count", "duplicate_searches": f"{p}.duplicate_search_query_count", "consecutive_searches": f"{p}.consecutive_duplicate_search_count",
        "guard_rejections": f"{g}.guard_rejection_count", "unknown_guards": f"coalesce({g}.guard_reason_counts['unknown'], 0)", "schema_rejections": f"{g}.schema_rejection_count",
        "malformed": f"{g}.malformed_tool_call_count", "step_errors": f"{g}.step_error_count", "projections": f"{c}.projection_count", "truncated": f"{c}.truncated_observation_count",
        "raw_tokens": f"{c}.raw_observation_tokens", "footer_failures": f"{c}.critical_footer_failures", "input_tokens": f"{c}.input_tokens_sum", "max_input_tokens": f"{c}.max_input_tokens",
    }
    issues = F.array_join(f"{v}.trajectory_contract_issues", ",").alias("issues")
    return m.select("task_id", *(F.col(f"{s}.{f}") for f, s in texts.items()), *(F.expr(e).cast("bigint").alias(f) for f, e in counts.items()), issues)


@query(f"""WITH {RAW_SQL}, t AS (SELECT *, CASE WHEN blocked THEN 'guard_rejection:' ELSE 'tool_step:' END || tool || ':' || said || ':' || event_id || printf(':e%04d:a%04d:', n, n) || CASE WHEN blocked THEN '' ELSE printf('s%04d', place) END
    || CASE WHEN k = 7 THEN ':invalid_json' ELSE ':' END || ':' || CASE WHEN NOT blocked THEN '' WHEN reason = '' THEN 'unknown' ELSE reason END || ':' || CASE WHEN blocked THEN CAST(k % 3 AS VARCHAR) ELSE '' END
    || ':' || CASE WHEN blocked THEN '::' ELSE (k % 2 = 1) || ':hit ' || (10000000 + k) || ':' || (k % 6 = 5) END || CASE WHEN NOT blocked AND k = 9 THEN ':refused' ELSE ':' END || ':' || (k % 5) AS line FROM o),
x AS (SELECT user_id, sha256(string_agg(line, ',' ORDER BY n)) AS events, count_if(blocked) AS guards FROM t GROUP BY 1)
SELECT user_id AS task_id, events, guards, user_id % 7 <> 0 AS over, CASE WHEN user_id % 17 = 0 THEN 'max_steps' ELSE 'done' END AS status, user_id % 5 <> 0 AS done FROM x WHERE user_id % 19 <> 0 AND user_id % 29 <> 0""")
def judge_payload(spark, d):
    """What a judge sees of each valid session."""
    sessions = T.normalized(raw(spark, d))
    seen = T.judge_view(sessions, T.metrics(sessions, VERSION))
    texts = ("event_type", "tool_name", "assistant_text", "tool_call_id", "event_id", "action_attempt_id", "executed_step_id", "tool_call_parse_error", "guard_reason", "guard_consecutive_count", "latest_observation_truncated", "actor_visible_observation", "done", "step_error")
    argument = lambda e: F.substring(F.trim(F.coalesce(e["parameters"]["asin"], e["parameters"]["query"], e["parameters"]["value"])), -1, 1)
    line = F.transform("events", lambda e: F.concat_ws(":", *(F.coalesce(e[f].cast("string"), F.lit("")) for f in texts), argument(e)))
    return seen.select("task_id", F.sha2(F.array_join(line, ","), 256).alias("events"), F.col("legality.guard_rejection_count").cast("bigint").alias("guards"), "terminal.over", "status", "done")


@query(f"""WITH {STEPS_SQL}, u AS (SELECT DISTINCT user_id FROM steps)
SELECT user_id AS task_id, CASE WHEN user_id % 3 = 0 THEN 'rubric_missing' WHEN user_id % 8 = 5 THEN 'rubric_duplicate' WHEN user_id % 4 = 0 THEN 'judge_missing' WHEN user_id % 14 = 3 THEN 'judge_duplicate' WHEN user_id % 10 = 1 THEN 'judge_of_another_task'
  WHEN (user_id % 19 = 0 OR user_id % 29 = 0) AND user_id % 2 = 0 THEN 'invalid_run_judged' ELSE 'ok' END AS fault, user_id % 3 <> 0 AND user_id % 8 <> 5 AS has_rubric FROM u""")
def assembled_results(spark, d):
    """Sessions with their measures, rubrics and judgements, and why they don't belong together; some of these come twice."""
    sessions = T.normalized(raw(spark, d))
    t = F.col("task_id")
    rubrics = sessions.where(t % 3 != 0).select("task_id", F.lit("v3").alias("rubric_version"))
    judged = sessions.where(t % 4 != 0).select("trajectory_id", F.when(t % 10 == 1, t + 1).otherwise(t).alias("task_id"), F.when(t % 2 == 0, "judged").otherwise("not_judged").alias("judge_status"))
    rubrics = rubrics.unionByName(rubrics.where(t % 8 == 5))
    judged = judged.unionByName(judged.where(F.col("trajectory_id").cast("long") % 14 == 3))
    return T.assembled(sessions, T.metrics(sessions, VERSION), rubrics, judged).select("task_id", F.coalesce("fault", F.lit("ok")).alias("fault"), F.col("rubric").isNotNull().alias("has_rubric"))


# A user's events among a thousand are an attempt of the user's task; it is a good one if it ends in a purchase.

RECORDS_SQL = f"""{STEPS_SQL}, rec AS (SELECT user_id AS task, event_id // 1000 AS rec, (event_id // 1000) % 2 AS grp, count(*) AS n, count_if(tool = 'error') AS guards, min(k) AS low, max(k) AS high, arg_max(tool, event_id) AS last,
  list({{'t': {SHOWN_SQL}, 'v': CAST(k % 5 AS VARCHAR), 'ok': tool <> 'error'}} ORDER BY event_id) AS trace FROM steps GROUP BY ALL),
r AS (SELECT *, CASE WHEN last = 'purchase' THEN 'gold_purchase' WHEN last = 'view' THEN 'assistant_final' ELSE 'max_steps' END AS kind, low > 1 AS valid, rec % 7 <> 0 AS done, high >= 99 AS infra, n - CASE WHEN rec % 5 = 0 THEN 1 ELSE 0 END AS responses FROM rec),
f AS (SELECT *, kind = 'gold_purchase' AND valid AND done AND NOT infra AS gold, kind <> 'gold_purchase' AND valid AND NOT infra AS failed FROM r),
why AS (SELECT *, CASE WHEN NOT gold THEN 'not_gold' WHEN guards % 3 = 2 THEN 'gold_has_guard_rejection' WHEN guards > 0 THEN 'gold_has_rejected_or_error_action' WHEN responses <> n THEN 'tool_response_count_mismatch' END AS reason FROM f),
mixed AS (SELECT grp, task FROM why GROUP BY ALL HAVING bool_or(gold) AND bool_or(failed)), cand AS (SELECT why.* FROM why JOIN mixed USING (grp, task) WHERE gold OR failed)"""


def attempts(spark, d):
    tool, k, i = F.col("tool"), F.col("k"), F.col("event_id")
    shown = F.element_at(F.create_map(*(F.lit(x) for kv in TOOLS.items() for x in kv)), tool)
    value, none = (k % 5).cast("string"), F.lit(None).cast("string")
    event = F.struct(i.alias("event_id"), shown.alias("tool"), F.when(tool == "view", value).alias("asin"), F.when(tool != "view", value).alias("value"), (tool != "error").alias("accepted"), none.alias("error"), none.alias("guard_reason"))
    rec = (i - i % 1000) / 1000
    rows = steps(spark, d).groupBy(F.col("user_id").alias("task_id"), rec.cast("bigint").alias("rec")).agg(
        F.array_sort(F.collect_list(event)).alias("trace"), F.count_if(tool == "error").alias("guards"), F.min("k").alias("low"), F.max("k").alias("high"), F.max_by(tool, "event_id").alias("last"), F.count("*").alias("n")
    )
    kind = F.when(F.col("last") == "purchase", "gold_purchase").when(F.col("last") == "view", "assistant_final").otherwise("max_steps")
    return rows.select(
        (F.col("rec") % 2).alias("group_id"), "task_id", kind.alias("reward_type"), (F.col("low") > 1).alias("valid_for_learning"), (F.col("rec") % 7 != 0).alias("done"), (F.col("high") >= 99).alias("infrastructure_invalid"),
        kind.alias("termination_reason"), F.when(F.col("guards") % 3 == 2, F.col("guards")).otherwise(0).alias("guard_rejections"), F.lit(0).alias("repeat_actions"), "trace",
        (F.col("n") - F.when(F.col("rec") % 5 == 0, 1).otherwise(0)).cast("int").alias("responses"), F.lit(0).alias("output_length"), F.col("rec").alias("source"), "rec",
    )


@query(f"WITH {RECORDS_SQL} SELECT task AS task_id, reason, count(*) AS n FROM cand WHERE gold AND reason IS NOT NULL GROUP BY ALL")
def clean_gold_rejects(spark, d):
    return V.gold_reject_counts(attempts(spark, d))


RECOVERY_SQL = f"""{RECORDS_SQL}, best AS (SELECT task, count_if(gold) AS golds, arg_min(trace, (n, rec)) FILTER (WHERE gold AND reason IS NULL) AS t, arg_min(rec, (n, rec)) FILTER (WHERE gold AND reason IS NULL) AS source FROM cand GROUP BY 1),
buy AS (SELECT *, list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].ok AND t[i].t = 'buy_now')) AS buy FROM best),
op AS (SELECT *, list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].ok AND t[i].t = 'open_product' AND i < buy)) AS opened FROM buy),
ref AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: t[i].t = 'select_option' AND t[i].ok AND i > opened AND i < buy) AS chosen FROM op),
bad AS (SELECT DISTINCT task, kind, trace FROM cand WHERE failed),
dia AS (SELECT b.task, len(list_filter(trace, lambda e: e.ok AND e.t = 'buy_now')) > 0 AS bought, len(list_filter(trace, lambda e: e.ok AND e.t = 'open_product' AND e.v = r.t[r.opened].v)) > 0 AS reached,
  len(list_filter(trace, lambda e: e.ok AND e.t = 'select_option' AND list_contains(list_transform(r.chosen, lambda i: r.t[i].v), e.v))) > 0 AS matched, kind FROM bad b JOIN ref r USING (task) WHERE opened IS NOT NULL),
bu AS (SELECT task, CASE WHEN bought THEN 0 WHEN kind = 'assistant_final' THEN CASE WHEN reached THEN 1 ELSE 4 END WHEN reached AND matched THEN 2 WHEN reached THEN 3 ELSE 5 END AS b FROM dia),
pr AS (SELECT task, min(b) AS b, count(*) AS failures FROM bu GROUP BY 1),
res AS (SELECT ref.task, golds, source, failures, CASE WHEN task % 10 = 3 THEN 'held_out_task' WHEN task % 10 = 4 THEN 'missing_prompt' WHEN t IS NULL THEN 'no_clean_gold' WHEN opened IS NULL THEN 'gold_reference_missing' END AS reason, b, opened, chosen, buy FROM ref LEFT JOIN pr USING (task)),
out AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN b IN (1, 2) THEN 'commit_only' WHEN b = 5 THEN 'candidate_options_commit' ELSE 'options_commit' END END AS mode FROM res)"""


def recovered(spark, d):
    rows, t = attempts(spark, d), F.col("task_id")
    tasks = rows.select("task_id").distinct()
    return rows, V.recovery_rows(rows, tasks.where(t % 10 != 4), tasks.where(t % 10 == 3))


@query(f"""WITH {RECOVERY_SQL} SELECT task AS task_id, reason, golds, source, failures, mode AS supervision_mode,
  CASE b {" ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(V.BUCKETS))} END AS primary_bucket,
  CASE WHEN reason IS NULL THEN array_to_string(list_transform(CASE mode WHEN 'commit_only' THEN [buy] WHEN 'options_commit' THEN list_concat(chosen, [buy]) ELSE list_concat([opened], chosen, [buy]) END, lambda i: i - 1), ',') END AS supervised FROM out""")
def recovery_rows(spark, d):
    """What each task teaches that was solved and failed within a group."""
    rows = recovered(spark, d)[1]
    return rows.select("task_id", "reason", "golds", "source", "failures", "supervision_mode", "primary_bucket", F.array_join(F.transform("supervised_events", lambda i: i.cast("string")), ",").alias("supervised"))


@query(f"""WITH {RECOVERY_SQL}, seen AS (SELECT grp, task, count(*) AS n, bool_or(gold) AND bool_or(failed) AS mixed FROM why GROUP BY ALL)
SELECT * FROM (SELECT CAST(sum(n) AS BIGINT) AS input_records, count(*) AS prompt_groups, count_if(mixed) AS mixed_success_groups FROM seen),
  (SELECT count(*) AS mixed_success_tasks, count_if(reason IS NULL) AS recovery_rows, count_if(reason IS NOT NULL) AS rejected_tasks, count_if(mode = 'candidate_options_commit') AS candidate_options_commit,
    count_if(mode = 'commit_only') AS commit_only, count_if(mode = 'options_commit') AS options_commit FROM out)""")
def recovery_summary(spark, d):
    return V.recovery_summary(*recovered(spark, d))


def run_of(rows, first: bool):
    """One attempt a task: the first or the last."""
    pick = (F.min_by if first else F.max_by)(F.struct(*rows.columns), "rec")
    one = rows.groupBy("task_id").agg(pick.alias("r")).select("task_id", "r.reward_type", "r.termination_reason", "r.trace")
    gold = F.col("reward_type") == "gold_purchase"
    asin = F.try_element_at(F.filter("trace", lambda e: e["tool"] == "open_product"), F.lit(-1))["asin"]
    return one.select("*", gold.alias("success"), F.when(gold, asin).alias("purchased_asin"), F.create_map(F.lit("steps"), F.size("trace").cast("double"), F.lit("guards"), F.size(F.filter("trace", lambda e: ~e["accepted"])).cast("double")).alias("measures"))


@query(f"""WITH {RECORDS_SQL}, s AS (SELECT * FROM why QUALIFY row_number() OVER (PARTITION BY task ORDER BY rec) = 1), t AS (SELECT * FROM why QUALIFY row_number() OVER (PARTITION BY task ORDER BY rec DESC) = 1),
b AS (SELECT s.task, CASE WHEN t.kind = 'gold_purchase' THEN 'gain' ELSE 'loss' END AS transition, CASE WHEN t.kind = 'gold_purchase' THEN t.trace ELSE s.trace END AS good, CASE WHEN t.kind = 'gold_purchase' THEN s.trace ELSE t.trace END AS bad,
  CASE WHEN t.kind = 'gold_purchase' THEN s.kind ELSE t.kind END AS kind, len(t.trace) - len(s.trace) AS steps, t.guards - s.guards AS guards FROM s JOIN t USING (task) WHERE (s.kind = 'gold_purchase') <> (t.kind = 'gold_purchase')),
x AS (SELECT *, list_filter(good, lambda e: e.t = 'open_product')[-1].v AS asin FROM b),
y AS (SELECT *, coalesce(len(list_filter(bad, lambda e: e.ok AND e.t = 'open_product' AND e.v = asin)), 0) > 0 AS reached, len(list_filter(bad, lambda e: e.ok AND e.t = 'buy_now')) > 0 AS bought,
  len(list_filter(bad, lambda e: e.ok AND e.t = 'select_option' AND len(list_filter(good, lambda g: g.ok AND g.t = 'select_option' AND g.v = e.v)) > 0)) > 0 AS matched FROM x),
z AS (SELECT *, CASE WHEN bought THEN 0 WHEN kind = 'assistant_final' THEN CASE WHEN reached THEN 1 ELSE 4 END WHEN reached AND matched THEN 2 WHEN reached THEN 3 ELSE 5 END AS b FROM y),
p AS (SELECT transition, 'reward_type' AS measure, kind AS name, 1 AS v FROM z UNION ALL SELECT transition, 'termination_reason', kind, 1 FROM z UNION ALL SELECT transition, 'cases', 'all', 1 FROM z
  UNION ALL SELECT transition, 'bucket', CASE b {" ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(V.BUCKETS))} END, 1 FROM z UNION ALL SELECT transition, 'bridge', 'reached_reference', 1 FROM z WHERE reached
  UNION ALL SELECT transition, 'bridge', 'matched_option', 1 FROM z WHERE matched UNION ALL SELECT transition, 'bridge', 'attempted_purchase', 1 FROM z WHERE bought
  UNION ALL SELECT transition, 'delta', 'steps', steps FROM z UNION ALL SELECT transition, 'delta', 'guards', guards FROM z)
SELECT transition, measure, name, CAST(sum(v) AS DOUBLE) AS total, count(*) AS n FROM p GROUP BY ALL""")
def transition_summary(spark, d):
    """Gains and losses between the first and the last attempt of each task."""
    rows = attempts(spark, d)
    return V.transition_summary(V.transition_cases(run_of(rows, True), run_of(rows, False)))
