"""Whether proposals have the structure that a plan registered for them, without a look at their outcomes.

First the records are proved to be the plan's partition: one for each registered place, no other, none twice. Then each is classified by the first
defect it has, and a state is ruled out as a whole by any defect of any of its proposals; nothing takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contracts import first_reason

#: Why a state is ruled out, in the order in which a proposal is looked at; the last one is about several proposals.
REASONS = (
    "stage1_plan_identity_invalid",
    "stage1_task_identity_invalid",
    "pre_action_prompt_invalid",
    "first_decision_tensors_invalid",
    "first_decision_span_invalid",
    "first_decision_action_invalid",
    "first_request_provenance_invalid",
    "duplicate_decision_old_logprobs_mismatch",
)
#: What a record has to have from its plan.
IDENTITIES = ("suffix_uid", "parent_branch_uid", "replay_state_id", "actor_checkpoint_sha256", "decoding_config_sha256", "sampling_backend_contract_sha256", "prompt_token_sha256")


def partition_faults(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """(keys, fault) of the keys that are missing among ``found``, extra, or there twice on either side; none proves a partition.

    Both sides are counted in one aggregate, so that nothing is joined. Null keys are keys.
    """
    sides = expected.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(found.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = sides.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    fault = first_reason(registered_twice=F.col("a") > 1, missing=F.col("b") == 0, extra=F.col("a") == 0, duplicate=F.col("b") > 1)
    return counts.withColumn("fault", fault).where("fault IS NOT NULL").select(*keys, "fault")


def tokens_sha(tokens: Column) -> Column:
    """SHA-256 of the canonical JSON of an array of numbers."""
    return F.sha2(F.to_json(tokens), 256)


def action_sha(action: Column) -> Column:
    """SHA-256 of the canonical JSON of an action (tool, parameters as a map of texts)."""
    entries = F.transform(F.array_sort(F.map_entries(action["parameters"])), lambda e: F.regexp_extract(F.to_json(F.create_map(e["key"], e["value"])), r"(?s)^\{(.*)\}$", 1))
    name = F.regexp_extract(F.to_json(F.array(action["tool"])), r"(?s)^\[(.*)\]$", 1)
    return F.sha2(F.concat(F.lit('{"parameters":{'), F.array_join(entries, ","), F.lit('},"tool":'), name, F.lit("}")), 256)


def classified(plan: DataFrame, records: DataFrame, state: str = "state_uid", place: str = "suffix_index") -> DataFrame:
    """(state, place, reason, decision, evidence) of every record of a partition: its first defect, or its decision and what was measured on it.

    ``plan`` has a row a place with IDENTITIES, task_id, prompt_tokens and seed; ``records`` have IDENTITIES, task_id, prompt_token_ids, response_ids,
    old_logprobs, response_mask, first_action_span, first_action (tool, parameters), first_action_sha256, request_prompt_sha256 and request_seeds.
    """
    registered = plan.select(state, place, F.struct(*IDENTITIES, "task_id", "prompt_tokens", "seed").alias("p"))
    rows = records.join(registered, [state, place])
    same = F.lit(True)
    for name in IDENTITIES:
        same = same & F.col(name).eqNullSafe(F.col(f"p.{name}"))
    n = F.size("response_ids")
    finite = F.forall("old_logprobs", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda tokens: F.coalesce(F.forall(tokens, lambda t: t.isNotNull() & (t >= 0)), F.lit(False))
    tensors = whole("response_ids") & F.coalesce((F.size("old_logprobs") == n) & finite & (F.size("response_mask") == n) & F.forall("response_mask", lambda m: m.isNotNull() & m.isin(0, 1)), F.lit(False))
    end = F.get("first_action_span", 1)
    span = F.coalesce((F.size("first_action_span") == 2) & (F.get("first_action_span", 0) == 0) & end.between(1, n) & F.forall(F.slice("response_mask", 1, F.greatest(end, F.lit(0))), lambda m: m == 1), F.lit(False))
    action = F.coalesce(action_sha(F.col("first_action")) == F.col("first_action_sha256"), F.lit(False)) & F.col("first_action.tool").isNotNull()
    asked = F.get("request_prompt_sha256", 0).eqNullSafe(F.col("p.prompt_token_sha256")) & F.get("request_seeds", 0).eqNullSafe(F.col("p.seed"))
    prompt = whole("prompt_token_ids") & F.col("prompt_token_ids").eqNullSafe(F.col("p.prompt_tokens")) & (tokens_sha(F.col("prompt_token_ids")) == F.col("prompt_token_sha256"))
    task = F.col("task_id").eqNullSafe(F.col("p.task_id"))
    checks = dict(zip(REASONS, (~same, ~task, ~prompt, ~tensors, ~span, ~action, ~asked), strict=False))
    rows = rows.withColumn("reason", first_reason(**checks))
    first = F.when(F.col("reason").isNull(), F.slice("response_ids", 1, end))
    decision = F.sha2(F.concat_ws("|", F.col(state).cast("string"), "prompt_token_sha256", F.to_json(first), "first_action_sha256"), 256)
    sound = F.col("reason").isNull()
    return rows.select(state, place, "reason", F.when(sound, decision).alias("decision"), F.when(sound, F.sha2(F.to_json(F.slice("old_logprobs", 1, end)), 256)).alias("evidence"))


def state_structure(proposals: DataFrame, state: str = "state_uid") -> DataFrame:
    """(state, proposals, reasons, eligible) of ``classified`` proposals; reasons is a map of code to how often it holds, a decision with two measurements counting once."""
    single = proposals.where("reason IS NOT NULL").groupBy(state, "reason").agg(F.count("*").alias("n"))
    twice = proposals.where("decision IS NOT NULL").groupBy(state, "decision").agg((F.min("evidence") != F.max("evidence")).alias("differ")).where("differ")
    several = twice.groupBy(state).agg(F.count("*").alias("n")).select(state, F.lit(REASONS[-1]).alias("reason"), "n")
    total = proposals.groupBy(state, F.lit(None).cast("string").alias("reason")).agg(F.count("*").alias("n"))
    every = single.unionByName(several).unionByName(total).groupBy(state).agg(
        F.sum(F.when(F.col("reason").isNull(), F.col("n"))).alias("proposals"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("reasons")
    )
    return every.withColumn("eligible", F.size("reasons") == 0)


def exclusion_counts(states: DataFrame) -> DataFrame:
    """One row: states and proposals that were registered, that are left and that are ruled out."""
    left, n = F.col("eligible"), F.col("proposals")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return states.agg(
        F.count("*").alias("registered_states"), zero(F.sum(n)).alias("registered_proposals"), F.count_if(left).alias("eligible_states"), zero(F.sum(F.when(left, n))).alias("eligible_proposals"),
        F.count_if(~left).alias("excluded_states"), zero(F.sum(F.when(~left, n))).alias("excluded_proposals"),
    )
