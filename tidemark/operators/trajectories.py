"""Raw trajectories as one stream of events each, and what is measured on them. A trajectory is a row, so nothing here shuffles.

A raw trajectory has ``steps`` (tool, parameters as a map of texts, env_action, observation, call_id, parse_error, error, projection),
``blocked`` (step_index, tool, parameters, reason, call_id, parse_error), ``calls`` (call_id, content: the assistant's text, in order),
status, done, final_reward, infrastructure_invalid, terminal (done, over, termination_reason, reward_detail), context (input_tokens,
compactions, truncations) and error types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logic import strictly, text_or
from ..functions.text import collapsed

#: Errors of the infrastructure, tools that show a page of a product, and a product's id.
INFRASTRUCTURE_ERRORS = ("ContextBudgetError", "RemoteDisconnected", "ShopHttpError", "TimeoutError", "URLError")
INFORMATION_PAGES = ("view_attributes", "view_description", "view_features", "view_reviews")
PRODUCT_ID = r"(?<!\d)(\d{8,12})(?!\d)"

EVENT = (
    "event_id string, event_type string, action_attempt_id string, executed_step_id string, source_index bigint, assistant_text string, tool string, "
    "parameters map<string,string>, env_action string, parse_error string, guard_reason string, observation string, error string, "
    "tool_call_id string, guard_consecutive_count bigint, latest_observation_truncated boolean, done boolean, "
    "projection struct<truncated:boolean,raw_tokens:bigint,visible_tokens:bigint,footer:boolean>"
)


def text_of_call(calls: Column, call_id: Column) -> Column:
    """The assistant's text that made a call: the last one with its id, an empty one if there is none."""
    return F.coalesce(F.try_element_at(F.filter(calls, lambda c: c["call_id"] == call_id), F.lit(-1))["content"], F.lit(""))


def interleaved(steps: Column, blocked: Column) -> Column:
    """(pos, kind, idx) of every event in order: calls that were blocked at a position come before its step, those without a valid position last."""
    n = F.size(steps).cast("bigint")
    place = F.transform(
        blocked,
        lambda b, i: F.struct(
            F.when(F.coalesce(b["step_index"].between(0, n), F.lit(False)), b["step_index"]).otherwise(n + 1).cast("bigint").alias("pos"), F.lit(0).alias("kind"), i.alias("idx")
        ),
    )
    own = F.transform(steps, lambda s, i: F.struct(i.cast("bigint").alias("pos"), F.lit(1).alias("kind"), i.alias("idx")))
    return F.array_sort(F.concat(place, own))


def normalized(raw: DataFrame) -> DataFrame:
    """``raw`` with ``events`` in place of steps, blocked and calls, and ``warnings``: the blocked calls without a valid position.

    Missing arrays count as empty ones. Every event is an attempt; only steps are executed, and numbered by their place among the steps.
    """
    none = F.lit(None).cast("string")
    filled = raw
    for name in ("steps", "blocked", "calls"):
        filled = filled.withColumn(name, F.coalesce(F.col(name), F.array().cast(raw.schema[name].dataType)))

    def event(key: Column, i: Column) -> Column:
        step, guard = F.get("steps", key["idx"]), F.get("blocked", key["idx"])
        is_step = key["kind"] == 1

        def either(name: str) -> Column:
            return F.when(is_step, step[name]).otherwise(guard[name])

        def own(side: str, name: str, kind: str) -> Column:
            """A field that not every source records."""
            known = name in raw.schema[side].dataType.elementType.names
            return F.when(is_step == (side == "steps"), (step if side == "steps" else guard)[name].cast(kind)) if known else F.lit(None).cast(kind)

        return F.struct(
            F.format_string("e%04d", i + 1).alias("event_id"),
            F.when(is_step, "tool_step").otherwise("guard_rejection").alias("event_type"),
            F.format_string("a%04d", i + 1).alias("action_attempt_id"),
            F.when(is_step, F.format_string("s%04d", key["idx"])).alias("executed_step_id"),
            F.when(is_step, key["pos"]).otherwise(guard["step_index"]).alias("source_index"),
            text_of_call(F.col("calls"), either("call_id")).alias("assistant_text"),
            either("tool").alias("tool"),
            either("parameters").alias("parameters"),
            F.when(is_step, step["env_action"]).otherwise(none).alias("env_action"),
            either("parse_error").alias("parse_error"),
            F.when(is_step, none).otherwise(text_or(guard["reason"], F.lit("unknown"))).alias("guard_reason"),
            F.when(is_step, F.coalesce(step["observation"], F.lit(""))).otherwise("").alias("observation"),
            F.when(is_step, step["error"]).otherwise(none).alias("error"),
            either("call_id").alias("tool_call_id"),
            own("blocked", "guard_consecutive_count", "bigint").alias("guard_consecutive_count"),
            own("steps", "latest_observation_truncated", "boolean").alias("latest_observation_truncated"),
            own("steps", "done", "boolean").alias("done"),
            F.when(is_step, step["projection"]).alias("projection"),
        )

    keyed = filled.withColumn("_keys", interleaved(F.col("steps"), F.col("blocked")))
    lost = F.size(F.filter("_keys", lambda k: (k["kind"] == 0) & (k["pos"] > F.size("steps"))))
    return keyed.withColumn("events", F.transform("_keys", event).cast(f"array<struct<{_nested(EVENT)}>>")).withColumn("warnings", lost).drop("_keys", "steps", "blocked", "calls")


def _nested(fields: str) -> str:
    """A list of columns as the fields of a struct."""
    return ",".join(":".join(f.split(" ", 1)) for f in fields.split(", "))


def action_signature(event: Column) -> Column:
    """What tells an action apart: the environment's form of it, white space and case aside; else the tool and its sorted parameters without the note."""
    named = F.array_sort(F.map_entries(F.map_filter(event["parameters"], lambda k, _: k != "note")))
    call = F.to_json(F.struct(F.lower(F.coalesce(event["tool"], F.lit(""))).alias("tool"), F.coalesce(named, F.array().cast("array<struct<key:string,value:string>>")).alias("parameters")))
    action = collapsed(F.lower(event["env_action"]))
    return F.when(F.coalesce(action, F.lit("")) != "", F.concat(F.lit("env:"), action)).otherwise(call)


def repeated(signatures: Column) -> Column:
    """(duplicates, consecutive) of an array: values seen before, and values that equal the one before."""
    after = F.transform(signatures, lambda s, i: F.when(i > 0, s == F.get(signatures, i - 1)).otherwise(False))
    return F.struct((F.size(signatures) - F.size(F.array_distinct(signatures))).alias("duplicates"), F.size(F.filter(after, lambda x: x)).alias("consecutive"))


def infrastructure_invalid(flag: Column, trajectory_error: Column, release_error: Column) -> Column:
    """Flagged, or any error on release, or an error of the infrastructure."""
    return F.coalesce(flag, F.lit(False)) | release_error.isNotNull() | F.coalesce(trajectory_error.isin(*INFRASTRUCTURE_ERRORS), F.lit(False))


def contract_issues(status: Column, done: Column, terminal: Column, warnings: Column, reward_version: str) -> Column:
    """Codes of what a finished trajectory lacks, in a fixed order."""
    detail, finished = terminal["reward_detail"], F.coalesce(status == "done", F.lit(False))
    version = detail["reward_version"]
    found = {
        "done_status_without_trajectory_done": finished & ~strictly(done),
        "done_status_without_terminal_done": finished & ~strictly(terminal["done"]),
        "done_status_without_terminal_over": finished & ~strictly(terminal["over"]),
        "done_status_without_reward_detail": finished & detail.isNull(),
        "unexpected_reward_version": version.isNotNull() & (version != reward_version),
        "normalization_warnings": F.coalesce(warnings > 0, F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(code)) for code, c in found.items())))


def metrics(trajectories: DataFrame, reward_version: str, keys: tuple[str, ...] = ("trajectory_id", "task_id")) -> DataFrame:
    """Measures of each normalised trajectory, in seven sections; what is not recorded is null. ``reward_version`` is the one that a strict success has."""
    rows = trajectories.withColumn("events", F.coalesce("events", F.array().cast(f"array<struct<{_nested(EVENT)}>>")))
    rows = rows.withColumn("_run", F.filter("events", lambda e: e["event_type"] == "tool_step")).withColumn("_no", F.filter("events", lambda e: e["event_type"] == "guard_rejection"))
    rows = rows.withColumn("_tools", F.transform("_run", lambda e: text_or(e["tool"], F.lit("unknown")))).withColumn("_reasons", F.transform("_no", lambda e: text_or(e["guard_reason"], F.lit("unknown"))))
    rows = rows.withColumn("_search", F.filter("_run", lambda e: e["tool"] == "search_products")).withColumn("_shown", F.filter(F.transform("_run", lambda e: e["projection"]), lambda p: p.isNotNull()))
    detail, terminal, context = F.col("terminal.reward_detail"), F.col("terminal"), F.col("context")
    kind = text_or(detail["reward_type"], F.lit("unknown"))
    ended = text_or(detail["termination_reason"], terminal["termination_reason"], F.col("status"), F.lit("unknown"))
    queries = F.transform("_search", lambda e: F.coalesce(collapsed(F.lower(e["parameters"]["query"])), F.lit("")))
    seen = F.array_distinct(F.flatten(F.transform("_search", lambda e: F.regexp_extract_all(e["observation"], F.lit(PRODUCT_ID), 1))))
    opened = F.array_distinct(F.filter(F.transform(F.filter("_run", lambda e: e["tool"] == "open_product"), lambda e: e["parameters"]["asin"]), lambda a: a.isNotNull()))
    tokens = F.filter(context["input_tokens"], lambda t: t.isNotNull() & ~F.isnan(t.cast("double")) & (t >= 0) & (t.cast("double") < float("inf")))
    tokens = F.transform(F.coalesce(tokens, F.array().cast("array<double>")), lambda t: t.cast("bigint"))

    def counted(values: str) -> Column:
        names = F.array_sort(F.array_distinct(F.col(values)))
        return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.size(F.filter(values, lambda v: v == n)))))

    def of(*names: str) -> Column:
        return F.size(F.filter("_tools", lambda t: t.isin(*names)))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v, F.lit(0)).cast("bigint"))

    def size(values: Column) -> Column:
        return F.greatest(F.size(values), F.lit(0))

    invalid = infrastructure_invalid(F.col("infrastructure_invalid"), F.col("trajectory_error"), F.col("release_error"))
    issues = contract_issues(F.col("status"), F.col("done"), terminal, F.col("warnings"), reward_version)
    gold = strictly(detail["reward_version"] == reward_version, F.col("status") == "done", F.col("done"), terminal["done"], terminal["over"], detail["reward_type"] == "gold_purchase", detail["reward_valid"],
                    detail["purchase_success"], detail["termination_reason"] == "gold_purchase")
    reward, null_long, null_double = F.coalesce("final_reward", F.lit(0.0)), F.lit(None).cast("bigint"), F.lit(None).cast("double")
    actions, searches = repeated(F.transform("events", action_signature)), repeated(queries)
    cut = F.size(F.filter("_shown", lambda p: F.coalesce(p["truncated"], F.lit(False))))
    loop = (kind == "repeat_loop") | (ended == "repeat_loop")
    status = F.coalesce("status", F.lit("unknown"))
    return rows.select(
        *keys,
        F.struct(
            detail["reward_version"].alias("reward_version"), kind.alias("reward_type"), detail["reward_valid"].alias("reward_valid"), reward.alias("final_reward"),
            F.coalesce(detail["terminal_utility"], reward).alias("terminal_utility"), F.coalesce(detail["weighted_score"], F.lit(0.0)).alias("weighted_score"),
            strictly(detail["purchase_success"]).alias("purchase_success"), gold.alias("strict_gold_success"), strictly(F.col("done")).alias("done"), strictly(terminal["done"]).alias("terminal_done"),
            strictly(terminal["over"]).alias("terminal_over"), ended.alias("termination_reason"), ((kind == "max_steps") | (ended == "max_steps") | (status == "max_steps")).alias("max_steps_termination"),
            loop.alias("repeat_loop_termination"),
        ).alias("reward_and_outcome"),
        F.struct(
            F.size("_run").alias("executed_tool_steps"), F.size("events").alias("action_attempts"), counted("_tools").alias("tool_counts"), F.size("_search").alias("search_count"),
            of("open_product").alias("open_product_count"), of(*INFORMATION_PAGES).alias("information_page_count"), of("select_option").alias("select_option_count"), of("buy_now").alias("buy_count"),
            of("finish_without_purchase").alias("finish_without_purchase_count"), F.size(seen).alias("visible_search_candidate_count"), F.size(opened).alias("opened_candidate_count"),
        ).alias("actions_and_efficiency"),
        F.struct(
            searches["duplicates"].alias("duplicate_search_query_count"), searches["consecutive"].alias("consecutive_duplicate_search_count"), actions["duplicates"].alias("duplicate_canonical_action_count"),
            actions["consecutive"].alias("consecutive_duplicate_action_count"), loop.alias("environment_repeat_loop"),
        ).alias("repetition"),
        F.struct(
            F.size("_no").alias("guard_rejection_count"), counted("_reasons").alias("guard_reason_counts"), F.size(F.filter("events", lambda e: F.coalesce(e["parse_error"], F.lit("")) != "")).alias("malformed_tool_call_count"),
            F.size(F.filter("_reasons", lambda r: F.startswith(r, F.lit("schema_")))).alias("schema_rejection_count"), F.size(F.filter("_run", lambda e: F.coalesce(e["error"], F.lit("")) != "")).alias("step_error_count"),
            (status == "invalid_action_limit").alias("invalid_action_limit"), size(context["truncations"]).alias("tool_call_truncation_count"),
        ).alias("legality"),
        F.struct(
            F.size("_shown").alias("projection_count"), cut.alias("truncated_observation_count"), (cut > 0).alias("any_observation_truncated"), total(F.transform("_shown", lambda p: p["raw_tokens"])).alias("raw_observation_tokens"),
            total(F.transform("_shown", lambda p: p["visible_tokens"])).alias("visible_observation_tokens"), F.size(F.filter("_shown", lambda p: ~F.coalesce(p["footer"], F.lit(False)))).alias("critical_footer_failures"),
            size(context["compactions"]).alias("context_compaction_count"), F.size(tokens).alias("input_token_turn_count"), total(tokens).alias("input_tokens_sum"), F.coalesce(F.array_max(tokens), F.lit(0)).alias("max_input_tokens"),
            null_long.alias("completion_tokens"), null_long.alias("total_tokens"), null_long.alias("cached_tokens"),
        ).alias("context"),
        F.struct(null_double.alias("trajectory_duration_seconds"), null_double.alias("model_latency_seconds"), null_double.alias("tool_latency_seconds")).alias("timing"),
        F.struct(
            invalid.alias("infrastructure_invalid"), F.col("trajectory_error").alias("trajectory_error_type"), F.col("release_error").alias("release_error_type"),
            F.coalesce(F.col("trajectory_error") == "ContextBudgetError", F.lit(False)).alias("context_hard_limit"), (F.size(issues) == 0).alias("trajectory_contract_valid"),
            issues.alias("trajectory_contract_issues"), (~invalid).alias("judge_eligible"),
        ).alias("validity"),
    )


#: What a judge may see of an event, by the name it has there, and the sections of the measures.
JUDGED_EVENT = {
    "event_id": "event_id",
    "event_type": "event_type",
    "action_attempt_id": "action_attempt_id",
    "executed_step_id": "executed_step_id",
    "assistant_text": "assistant_text",
    "tool_call_id": "tool_call_id",
    "tool_name": "tool",
    "parameters": "parameters",
    "tool_call_parse_error": "parse_error",
    "guard_reason": "guard_reason",
    "guard_consecutive_count": "guard_consecutive_count",
    "latest_observation_truncated": "latest_observation_truncated",
    "env_action": "env_action",
    "actor_visible_observation": "observation",
    "done": "done",
    "step_error": "error",
}
JUDGED_SECTIONS = ("actions_and_efficiency", "repetition", "legality", "context")


def judge_view(trajectories: DataFrame, measured: DataFrame, keys: tuple[str, ...] = ("trajectory_id", "task_id")) -> DataFrame:
    """What a judge may see of each trajectory: events and measures without rewards or outcomes. Trajectories of invalid runs are left out."""
    events = F.transform("events", lambda e: F.struct(*(e[f].alias(name) for name, f in JUDGED_EVENT.items())))
    ended = F.struct(F.col("terminal.done").alias("done"), F.col("terminal.over").alias("over")).alias("terminal")
    seen = trajectories.select(*keys, "status", "done", events.alias("events"), ended)
    return seen.join(measured.where("validity.judge_eligible").select(*keys, *JUDGED_SECTIONS), list(keys))


def _single(rows: DataFrame, key: str, *payload: Column) -> DataFrame:
    """A row a key: its payload as columns, so that what nobody reads isn't worked out, and ``_n``, how many rows it had. The payload of several rows is mixed."""
    names = [f"_{i}" for i in range(len(payload))]
    one = rows.select(key, *(c.alias(n) for c, n in zip(payload, names, strict=True)))
    return one.groupBy(key).agg(*(F.first(n).alias(n) for n in names), F.count("*").alias("_n"))


def assembled(trajectories: DataFrame, measured: DataFrame, rubrics: DataFrame, judged: DataFrame, task: str = "task_id", run: str = "trajectory_id") -> DataFrame:
    """One row a trajectory with its measures, its task's rubric and its judgement, and ``fault``: the first reason that the four don't belong together.

    Rubrics have one row a task; measures and judgements carry (task, run). A run without one of them stays, with its fault; where one comes several
    times the run has that fault and none of its rows. The parts carry nothing else by the key that they are joined by, so that no row is doubled.
    """
    def parts(rows: DataFrame, *keys: str) -> Column:
        return F.struct(*(c for c in rows.columns if c not in keys))

    m = _single(measured, run, F.col(task), F.col("validity.infrastructure_invalid"), parts(measured, run, task)).toDF(run, "_m_task", "_m_invalid", "_m", "_mn")
    r = _single(rubrics, task, parts(rubrics, task)).toDF(task, "_r", "_rn")
    j = _single(judged, run, F.col(task), F.col("judge_status"), parts(judged, run, task)).toDF(run, "_j_task", "_j_status", "_j", "_jn")
    both = trajectories.join(m, run, "left").join(r, task, "left").join(j, run, "left")
    fault = (
        F.when(F.col("_mn").isNull(), "metrics_missing")
        .when(F.col("_mn") > 1, "metrics_duplicate")
        .when(F.col("_m_task") != F.col(task), "metrics_of_another_task")
        .when(F.col("_rn").isNull(), "rubric_missing")
        .when(F.col("_rn") > 1, "rubric_duplicate")
        .when(F.col("_jn").isNull(), "judge_missing")
        .when(F.col("_jn") > 1, "judge_duplicate")
        .when(F.col("_j_task") != F.col(task), "judge_of_another_task")
        .when(F.col("_m_invalid") & (F.col("_j_status") != "not_judged"), "invalid_run_judged")
    )
    once = lambda n, c: F.when(F.col(n) == 1, F.col(c))
    found = both.withColumns({"metrics": once("_mn", "_m"), "rubric": once("_rn", "_r"), "judge": once("_jn", "_j"), "fault": fault})
    return found.drop("_m_task", "_m_invalid", "_m", "_mn", "_r", "_rn", "_j_task", "_j_status", "_j", "_jn")
