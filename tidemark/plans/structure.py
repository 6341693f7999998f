"""Proposals against their plan, over the driver's events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import structure as S
from .registry import query
from .tables import STEPS_SQL, steps

# A user's events of one tool are the proposals of a state, numbered in their order. Events whose number is divisible by a prime have the defect of that prime;
# two proposals of one action and one response are a decision, and each 53rd event measured something else on it.

PRIMES = (23, 29, 31, 37, 41, 43, 47)
CASE_SQL = "CASE " + " ".join(f"WHEN event_id % {p} = 0 THEN '{r}'" for p, r in zip(PRIMES, S.REASONS, strict=False)) + " END"


def proposals(spark, d):
    place = F.row_number().over(Window.partitionBy("user_id", "tool").orderBy("event_id")) - 1
    rows = steps(spark, d).withColumn("state_uid", F.concat_ws("-", F.col("user_id").cast("string"), "tool")).withColumn("suffix_index", place)
    e, k = F.col("event_id"), F.col("k")
    prompt = F.array(F.col("user_id").cast("int"), F.lit(7))
    bad = {r: e % p == 0 for p, r in zip(PRIMES, S.REASONS, strict=False)}
    identity = {n: F.concat_ws(":", F.lit(n), "state_uid") for n in S.IDENTITIES[:-1]} | {"prompt_token_sha256": S.tokens_sha(prompt)}
    plan = rows.select("state_uid", "suffix_index", *(c.alias(n) for n, c in identity.items()), "user_id", prompt.alias("prompt_tokens"), e.alias("seed"))
    plan = plan.withColumnRenamed("user_id", "task_id")
    action = F.struct(F.col("tool").alias("tool"), F.create_map(F.lit("b"), (k % 2).cast("string"), F.lit("a"), F.lit('"x"')).alias("parameters"))
    response = F.array((k % 2).cast("int"), F.lit(4), F.lit(5))
    found = rows.select(
        "state_uid", "suffix_index", *((F.when(bad[S.REASONS[0]], "other").otherwise(c) if n == "suffix_uid" else c).alias(n) for n, c in identity.items()),
        F.when(bad[S.REASONS[1]], -1).otherwise(F.col("user_id")).alias("task_id"), F.when(bad[S.REASONS[2]], F.array(F.lit(1))).otherwise(prompt).alias("prompt_token_ids"), response.alias("response_ids"),
        F.when(bad[S.REASONS[3]], F.array(F.lit(float("nan")), F.lit(0.5), F.lit(0.5))).when(e % 53 == 0, F.array(F.lit(-2.0), F.lit(0.5), F.lit(0.5))).otherwise(F.array(F.lit(-1.0), F.lit(0.5), e.cast("double"))).alias("old_logprobs"),
        F.array(F.lit(1), F.lit(1), F.lit(0)).alias("response_mask"), F.when(bad[S.REASONS[4]], F.array(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0), F.lit(2))).alias("first_action_span"), action.alias("first_action"),
        F.when(bad[S.REASONS[5]], "0").otherwise(S.action_sha(action)).alias("first_action_sha256"), F.array(identity["prompt_token_sha256"]).alias("request_prompt_sha256"),
        F.when(bad[S.REASONS[6]], F.array().cast("array<bigint>")).otherwise(F.array(e)).alias("request_seeds"),
    )
    return plan, found


STATES_SQL = f"""{STEPS_SQL}, r AS (SELECT user_id || '-' || tool AS state_uid, event_id, k % 2 AS side, {CASE_SQL} AS reason FROM steps),
twice AS (SELECT state_uid, count(*) AS n FROM (SELECT state_uid, side FROM r WHERE reason IS NULL GROUP BY ALL HAVING count(DISTINCT event_id % 53 = 0) > 1) GROUP BY 1),
s AS (SELECT state_uid, count(*) AS proposals, count(reason) AS bad FROM r GROUP BY 1),
why AS (SELECT state_uid, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL UNION ALL SELECT state_uid, '{S.REASONS[-1]}', n FROM twice)"""


@query(f"""WITH {STATES_SQL}, l AS (SELECT state_uid, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM why GROUP BY 1)
SELECT state_uid, proposals, coalesce(reasons, '') AS reasons, reasons IS NULL AS eligible FROM s LEFT JOIN l USING (state_uid)""")
def structure_classification(spark, d):
    """The states of the plan, and what rules them out."""
    found = S.state_structure(S.classified(*proposals(spark, d)))
    reasons = F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.select("state_uid", "proposals", reasons.alias("reasons"), "eligible")


@query(f"""WITH {STATES_SQL} SELECT count(*) AS registered_states, CAST(sum(proposals) AS BIGINT) AS registered_proposals, count(*) FILTER (WHERE NOT out) AS eligible_states, CAST(coalesce(sum(proposals) FILTER (WHERE NOT out), 0) AS BIGINT) AS eligible_proposals,
  count(*) FILTER (WHERE out) AS excluded_states, CAST(coalesce(sum(proposals) FILTER (WHERE out), 0) AS BIGINT) AS excluded_proposals FROM (SELECT *, state_uid IN (SELECT state_uid FROM why) AS out FROM s)""")
def structure_exclusions(spark, d):
    return S.exclusion_counts(S.state_structure(S.classified(*proposals(spark, d))))


@query(f"""WITH {STEPS_SQL}, r AS (SELECT user_id, tool, event_id, row_number() OVER (PARTITION BY user_id, tool ORDER BY event_id) - 1 AS i FROM steps)
SELECT user_id || '-' || tool AS state_uid, CAST(i + CASE WHEN event_id % 59 = 0 THEN 100000 ELSE 0 END AS INTEGER) AS suffix_index, CASE WHEN event_id % 59 = 0 THEN 'extra' ELSE 'duplicate' END AS fault FROM r WHERE event_id % 59 = 0 OR event_id % 61 = 0
UNION ALL SELECT user_id || '-' || tool, CAST(i AS INTEGER), 'missing' FROM r WHERE event_id % 59 = 0""")
def partition_proof(spark, d):
    """Where records fall short of their plan: each 59th is at another place, and each 61st of the others comes twice."""
    plan, found = proposals(spark, d)
    rows = found.select("state_uid", "suffix_index").join(plan.select("state_uid", "suffix_index", F.col("seed").alias("e")), ["state_uid", "suffix_index"])
    moved = F.when(F.col("e") % 59 == 0, F.col("suffix_index") + 100_000).otherwise(F.col("suffix_index"))
    rows = rows.select("state_uid", moved.alias("suffix_index"), "e")
    rows = rows.unionByName(rows.where("e % 61 = 0 AND e % 59 > 0"))
    return S.partition_faults(plan, rows, "state_uid", "suffix_index")
