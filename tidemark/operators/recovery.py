"""Attempts that failed next to attempts of the same task that did not: why, and what of the good one to learn from.

A record is an attempt: group_id, task_id, reward_type, valid_for_learning, done, infrastructure_invalid, termination_reason,
guard_rejections, repeat_actions, trace (an array of tool, asin, value, accepted, error, guard_reason), responses, output_length, source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logic import strictly
from ..functions.text import collapsed

#: What went wrong, the most telling first, and what is then learnt.
BUCKETS = (
    "purchase_selection_regression",
    "premature_finish_after_reference_candidate",
    "reached_reference_candidate_and_option_but_failed_to_commit",
    "reached_reference_candidate_but_option_or_commit_failed",
    "premature_finish_before_reference_candidate",
    "failed_to_reach_reference_candidate",
)
SUPERVISION = {
    "purchase_selection_regression": "options_commit",
    "premature_finish_after_reference_candidate": "commit_only",
    "reached_reference_candidate_and_option_but_failed_to_commit": "commit_only",
    "reached_reference_candidate_but_option_or_commit_failed": "options_commit",
    "premature_finish_before_reference_candidate": "options_commit",
    "failed_to_reach_reference_candidate": "candidate_options_commit",
}
FINISHED_EARLY = ("assistant_final", "assistant_finished_without_environment_done")


def _lookup(values: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def _places(trace: Column, holds) -> Column:
    """Indices of the events for which a condition holds."""
    return F.filter(F.transform(trace, lambda e, i: F.when(F.coalesce(holds(e), F.lit(False)), i)), lambda i: i.isNotNull())


def canonical_option(value: Column) -> Column:
    """An option's text, white space and case aside."""
    return F.lower(collapsed(F.coalesce(value, F.lit(""))))


def is_gold() -> Column:
    return strictly(F.col("reward_type") == "gold_purchase", F.col("valid_for_learning"), F.col("done")) & ~strictly(F.col("infrastructure_invalid"))


def is_learning_failure() -> Column:
    return ~strictly(F.col("reward_type") == "gold_purchase") & strictly(F.col("valid_for_learning")) & ~strictly(F.col("infrastructure_invalid"))


def clean_gold_reject_reason() -> Column:
    """Why a record is no clean demonstration, the first reason that holds; null if it is one."""
    trace = F.col("trace")
    unclean = F.exists(trace, lambda e: ~strictly(e["accepted"]) | (F.coalesce(e["error"], F.lit("")) != ""))
    last = F.try_element_at(trace, F.lit(-1))["tool"]
    return (
        F.when(~is_gold(), "not_gold")
        .when(F.coalesce(F.size(trace), F.lit(0)) <= 0, "empty_action_trace")
        .when(F.coalesce("guard_rejections", F.lit(0)) != 0, "gold_has_guard_rejection")
        .when(F.coalesce("repeat_actions", F.lit(0)) != 0, "gold_has_repeat_action")
        .when(unclean, "gold_has_rejected_or_error_action")
        .when(~strictly(last == "buy_now"), "gold_does_not_end_in_buy")
        .when(~F.col("responses").eqNullSafe(F.size(trace)), "tool_response_count_mismatch")
    )


def reference_view(trace: Column) -> Column:
    """(asin, open, options, option_events, buy): the last purchase, the last opening before it and the selections between; null without these."""
    buy = F.array_max(_places(trace, lambda e: e["accepted"] & (e["tool"] == "buy_now")))
    opened = F.array_max(F.filter(_places(trace, lambda e: e["accepted"] & (e["tool"] == "open_product") & e["asin"].isNotNull()), lambda i: i < buy))
    chosen = F.filter(_places(trace, lambda e: e["accepted"] & (e["tool"] == "select_option") & e["value"].isNotNull()), lambda i: (i > opened) & (i < buy))
    view = F.struct(
        F.get(trace, opened)["asin"].alias("asin"), opened.alias("open"), F.transform(chosen, lambda i: F.get(trace, i)["value"]).alias("options"), chosen.alias("option_events"), buy.alias("buy")
    )
    return F.when(buy.isNotNull() & opened.isNotNull(), view)


def failure_signature(termination: Column, trace: Column) -> Column:
    """Equal for failures that ended alike after the same actions."""
    actions = F.transform(trace, lambda e: F.struct(*(e[f].alias(f) for f in ("tool", "asin", "value", "accepted", "guard_reason"))))
    return F.sha2(F.to_json(F.struct(termination.alias("termination_reason"), actions.alias("actions")), {"ignoreNullFields": "false"}), 256)


def diagnosis(trace: Column, termination: Column, asin: Column, options: Column, early: tuple[str, ...] = FINISHED_EARLY) -> Column:
    """(bucket, reached, matching, bought): how far a failure came, against the product and the options of a success, in the latter's order."""
    done = F.filter(trace, lambda e: strictly(e["accepted"]))
    reached = F.exists(done, lambda e: strictly(e["tool"] == "open_product", e["asin"] == asin))
    picked = F.transform(F.filter(done, lambda e: strictly(e["tool"] == "select_option") & e["value"].isNotNull()), lambda e: canonical_option(e["value"]))
    matching = F.filter(options, lambda o: F.array_contains(picked, canonical_option(o)))
    bought = F.exists(done, lambda e: strictly(e["tool"] == "buy_now"))
    bucket = (
        F.when(bought, BUCKETS[0])
        .when(F.coalesce(termination.isin(*early), F.lit(False)), F.when(reached, BUCKETS[1]).otherwise(BUCKETS[4]))
        .when(reached & (F.size(matching) > 0), BUCKETS[2])
        .when(reached, BUCKETS[3])
        .otherwise(BUCKETS[5])
    )
    return F.struct(bucket.alias("bucket"), reached.alias("reached"), matching.alias("matching"), bought.alias("bought"))


def supervised_events(mode: Column, reference: Column) -> Column:
    """Indices of the good attempt's events that are learnt from."""
    buy, chosen = F.array(reference["buy"]), reference["option_events"]
    return F.when(mode == "candidate_options_commit", F.concat(F.array(reference["open"]), chosen, buy)).when(mode == "options_commit", F.concat(chosen, buy)).otherwise(buy)


def mixed(records: DataFrame) -> DataFrame:
    """The gold and failed records of the groups that have both. A group is a (group_id, task_id)."""
    keys = ["group_id", "task_id"]
    both = records.groupBy(*keys).agg(F.bool_or(is_gold()).alias("_g"), F.bool_or(is_learning_failure()).alias("_f")).where("_g AND _f").select(*keys)
    return records.where(is_gold() | is_learning_failure()).join(both, keys, "left_semi")


def recovery_rows(records: DataFrame, prompts: DataFrame, held_out: DataFrame) -> DataFrame:
    """One row a task that was solved and failed within a group: ``reason`` why it is left out, or what to learn from its best clean attempt.

    The best is the one with the fewest actions, then the shortest output, then the first source. Failures that are alike count once. The
    primary bucket is the most telling one of the task's failures. ``prompts`` and ``held_out`` hold a task_id a row. Only aggregates
    and one attempt a task are shuffled beyond the records themselves.
    """
    candidates = mixed(records)
    order = F.struct(F.size("trace"), "output_length", "source")
    clean = is_gold() & clean_gold_reject_reason().isNull()
    best = F.min_by(F.struct("trace", "source"), F.when(clean, order))
    tasks = candidates.groupBy("task_id").agg(F.when(F.count_if(clean) > 0, best).alias("best"), F.count_if(is_gold()).alias("golds"))
    tasks = tasks.withColumn("reference", reference_view(F.col("best.trace")))
    reference = tasks.where("reference IS NOT NULL").select("task_id", "reference")
    failed = candidates.where(is_learning_failure()).select("task_id", "termination_reason", "trace", failure_signature(F.col("termination_reason"), F.col("trace")).alias("_s"))
    judged = failed.dropDuplicates(["task_id", "_s"]).join(reference, "task_id").select("task_id", diagnosis(F.col("trace"), F.col("termination_reason"), F.col("reference.asin"), F.col("reference.options"))["bucket"].alias("bucket"))
    counts = judged.groupBy("task_id", "bucket").agg(F.count("*").alias("n"))
    rank = F.element_at(_lookup({b: k for k, b in enumerate(BUCKETS)}), F.col("bucket"))
    found = counts.groupBy("task_id").agg(F.min_by("bucket", rank).alias("primary_bucket"), F.sum("n").alias("failures"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n")))).alias("bucket_counts"))
    out = tasks.join(found, "task_id", "left")
    out = out.join(held_out.select("task_id").distinct().withColumn("_h", F.lit(True)), "task_id", "left").join(prompts.select("task_id").distinct().withColumn("_p", F.lit(True)), "task_id", "left")
    reason = F.when(F.col("_h"), "held_out_task").when(F.col("_p").isNull(), "missing_prompt").when(F.col("best").isNull(), "no_clean_gold").when(F.col("reference").isNull(), "gold_reference_missing")
    mode = F.when(F.col("reason").isNull(), F.element_at(_lookup(SUPERVISION), F.col("primary_bucket")))
    out = out.withColumn("reason", reason).withColumn("supervision_mode", mode)
    return out.select(
        "task_id", "reason", "golds", F.col("best.source").alias("source"), "reference", "primary_bucket", "failures", "bucket_counts", "supervision_mode",
        F.when(F.col("reason").isNull(), supervised_events(F.col("supervision_mode"), F.col("reference"))).alias("supervised_events"),
    )


def gold_reject_counts(records: DataFrame) -> DataFrame:
    """Per task of a mixed group: how many of its gold records each reason turns down."""
    rows = mixed(records).where(is_gold()).withColumn("reason", clean_gold_reject_reason()).where("reason IS NOT NULL")
    return rows.groupBy("task_id", "reason").agg(F.count("*").alias("n"))


def recovery_summary(records: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of counters over all records and the rows made of them."""
    seen = records.groupBy("group_id", "task_id").agg(F.count("*").alias("n"), (F.bool_or(is_gold()) & F.bool_or(is_learning_failure())).alias("mixed"))
    totals = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input_records"), F.count("*").alias("prompt_groups"), F.count_if("mixed").alias("mixed_success_groups"))
    modes = [F.count_if(F.col("supervision_mode") == m).alias(m) for m in sorted(set(SUPERVISION.values()))]
    made = rows.agg(F.count("*").alias("mixed_success_tasks"), F.count_if(F.col("reason").isNull()).alias("recovery_rows"), F.count_if(F.col("reason").isNotNull()).alias("rejected_tasks"), *modes)
    return totals.join(F.broadcast(made))


def transition_cases(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tasks that one of two runs solves and the other does not, with the failure held against the success.

    Both have one row a task: task_id, success, reward_type, termination_reason, trace, purchased_asin, and measures under ``measures`` (a map).
    """
    a, b = (x.select("task_id", F.struct(*(c for c in x.columns if c != "task_id")).alias(side)) for x, side in ((source, "s"), (target, "t")))
    gain = F.col("t.success") & ~F.col("s.success")
    both = a.join(b, "task_id").withColumn("transition", F.when(gain, "gain").when(F.col("s.success") & ~F.col("t.success"), "loss")).where("transition IS NOT NULL")
    both = both.withColumn("good", F.when(gain, F.col("t")).otherwise(F.col("s"))).withColumn("bad", F.when(gain, F.col("s")).otherwise(F.col("t")))
    options = F.array_distinct(F.transform(F.filter("good.trace", lambda e: strictly(e["accepted"], e["tool"] == "select_option") & e["value"].isNotNull()), lambda e: e["value"]))
    found = diagnosis(F.col("bad.trace"), F.col("bad.termination_reason"), F.col("good.purchased_asin"), options, FINISHED_EARLY[:1])
    deltas = F.map_zip_with("t.measures", "s.measures", lambda _, t, s: F.coalesce(t, F.lit(0.0)) - F.coalesce(s, F.lit(0.0)))
    return both.select("task_id", "transition", F.col("bad.reward_type").alias("reward_type"), F.col("bad.termination_reason").alias("termination_reason"), found.alias("d"), deltas.alias("deltas"))


def transition_summary(cases: DataFrame) -> DataFrame:
    """(transition, measure, name, n): counts of cases by what the failures were, and totals and means of the measures' differences."""
    flags = [F.when(F.col("d.reached"), "reached_reference"), F.when(F.size("d.matching") > 0, "matched_option"), F.when(F.col("d.bought"), "attempted_purchase")]
    parts = [("reward_type", F.col("reward_type")), ("termination_reason", F.col("termination_reason")), ("bucket", F.col("d.bucket")), ("cases", F.lit("all")), *(("bridge", f) for f in flags)]
    counted = F.filter(F.array(*(F.struct(F.lit(m).alias("measure"), v.alias("name"), F.lit(1.0).alias("x")) for m, v in parts)), lambda p: p["name"].isNotNull())
    moved = F.transform(F.map_entries("deltas"), lambda e: F.struct(F.lit("delta").alias("measure"), e["key"].alias("name"), e["value"].alias("x")))
    each = cases.select("transition", F.explode(F.concat(counted, moved)).alias("p")).select("transition", "p.*")
    return each.groupBy("transition", "measure", "name").agg(F.round(F.sum(F.col("x").cast("decimal(28,6)")).cast("double"), 6).alias("total"), F.count("*").alias("n"))
