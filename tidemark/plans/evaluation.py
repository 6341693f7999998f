"""Summaries, groups and paired runs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.logic import mean_of, rate
from ..operators import evaluation as E
from ..operators import groups as G
from ..operators import pairing as P
from .registry import query
from .tables import LAST_ORDERS_SQL, STEPS_SQL, last_orders, steps, table


@query(f"""WITH {LAST_ORDERS_SQL}
SELECT count(*) AS expected, count(o.task_id) AS completed, count_if(o.task_id IS NULL) AS missing, count_if(coalesce(ok, false)) AS successes,
       round(count_if(coalesce(ok, false)) / count(*), 6) AS success_rate,
       round(CAST(sum(CAST(reward AS DECIMAL(18,4))) AS DOUBLE) / count(reward), 6) AS mean_reward
FROM customer LEFT JOIN last_orders o ON c_custkey = task_id""")
def fixed_denominator_summary(spark, d):
    """Customers as expected tasks, their last order as the result."""
    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"))
    return E.fixed_denominator_summary(expected, last_orders(spark, d), "task_id", F.col("ok"), "reward")


KINDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "unknown"]


@query(f"""WITH {LAST_ORDERS_SQL}, kinds AS (SELECT unnest({KINDS}) AS kind)
SELECT k.kind, count(o.task_id) AS n, round(count(o.task_id) / (SELECT count(*) FROM customer), 6) AS rate
FROM kinds k LEFT JOIN last_orders o ON k.kind = coalesce(o.kind, 'unknown') GROUP BY k.kind""")
def reward_type_rates(spark, d):
    """Result types of a fixed list by all expected tasks."""
    kinds = spark.createDataFrame([(k,) for k in KINDS], "kind string")
    expected = table(spark, d, "customer").count()
    return E.type_rates(last_orders(spark, d), "kind", kinds, F.lit(expected))


@query(f"WITH {STEPS_SQL} SELECT tool AS item, count(*) AS n FROM steps GROUP BY tool")
def nested_counters(spark, d):
    """Tools counted from the array that each session holds."""
    sessions = steps(spark, d).groupBy("user_id").agg(F.collect_list("tool").alias("tools"))
    return E.nested_counts(sessions, "tools")


@query(f"""WITH {STEPS_SQL}, s AS (SELECT tool, lag(tool) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM steps)
SELECT tool, count(*) AS n FROM s WHERE before = 'error' GROUP BY tool""")
def lag_conditioned_count(spark, d):
    """Steps right after an error, by tool."""
    return E.after_flag(steps(spark, d), "user_id", ["ts", "event_id"], F.col("tool") == "error").groupBy("tool").agg(F.count("*").alias("n"))


@query(f"""WITH {STEPS_SQL}, s AS (SELECT user_id, count_if(tool = 'error') > 13 AS truncated, count_if(tool = 'purchase') > 13 AS success FROM steps GROUP BY user_id)
SELECT truncated, count(*) AS n, count_if(success) AS successes, round(count_if(success) / count(*), 6) AS success_rate FROM s GROUP BY truncated""")
def bucketed_success(spark, d):
    """Sessions with many purchases, by whether they have many errors."""
    many = steps(spark, d).groupBy("user_id").agg((F.count_if(F.col("tool") == "error") > 13).alias("truncated"), (F.count_if(F.col("tool") == "purchase") > 13).alias("success"))
    return E.bucketed_success(many, "truncated", "success")


@query(f"WITH {STEPS_SQL} SELECT user_id, max(CASE WHEN tool = 'view' THEN k ELSE 0 END) AS deepest FROM steps GROUP BY user_id")
def nested_max(spark, d):
    """The largest argument among a session's views, 0 without any."""
    sessions = steps(spark, d).groupBy("user_id").agg(F.collect_list(F.struct("tool", "k")).alias("s"))
    deepest = F.array_max(F.transform(F.filter("s", lambda x: x["tool"] == "view"), lambda x: x["k"]))
    return sessions.select("user_id", F.greatest(F.coalesce(deepest, F.lit(0)), F.lit(0)).alias("deepest"))


@query("""SELECT count(*) AS expected, count(l.doc_id) AS judged, round(count(l.doc_id) / count(*), 6) AS coverage,
  round(coalesce(sum(quality), 0) / count(l.doc_id), 6) AS mean_quality, round(coalesce(sum(toxic), 0) / count(*), 6) AS toxic_rate,
  round(CAST(sum(CAST(n_chars AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS mean_chars
FROM documents LEFT JOIN labels l USING (doc_id)""")
def four_panel_summary(spark, d):
    """Judged scores by valid judges, everything else by all expected."""
    joined = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").withColumn("_j", F.lit(1)), "doc_id", "left")
    n, judged = F.count("*"), F.count("_j")
    return joined.agg(
        n.alias("expected"),
        judged.alias("judged"),
        rate(judged, n).alias("coverage"),
        rate(F.coalesce(F.sum("quality"), F.lit(0)), judged).alias("mean_quality"),
        rate(F.coalesce(F.sum("toxic"), F.lit(0)), n).alias("toxic_rate"),
        mean_of(F.col("n_chars")).alias("mean_chars"),
    )


@query("""SELECT coalesce(nullif(o_orderpriority, ''), 'unknown') AS outer_key, count_if(o_orderstatus = 'F') AS n_f, count_if(o_orderstatus = 'O') AS n_o,
  count_if(o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1""")
def status_by_hardness(spark, d):
    """Order status by priority."""
    return E.two_level_counts(table(spark, d, "orders"), F.col("o_orderpriority"), "o_orderstatus", ["F", "O", "P"])


@query("""SELECT lang, count_if(quality + toxic = 0) AS score_0, count_if(quality + toxic = 1) AS score_1, count_if(quality + toxic = 2) AS score_2
FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def score_distribution(spark, d):
    """Scores 0, 1 and 2 of the labels by language."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").withColumn("score", F.col("quality") + F.col("toxic"))
    return rows.groupBy("lang").agg(*(F.count_if(F.col("score") == s).alias(f"score_{s}") for s in range(3)))


@query(f"""WITH {STEPS_SQL}, e AS (SELECT DISTINCT k % 5 AS code, user_id FROM steps WHERE tool = 'error')
SELECT code, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS ids, count(*) AS n FROM e GROUP BY code""")
def ids_by_error(spark, d):
    """Sessions with an error of each code."""
    return E.ids_by_code(steps(spark, d).where("tool = 'error'").withColumn("code", F.col("k") % 5), "code", "user_id")


@query("""SELECT c_mktsegment, count(*) AS n, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) / count(c_acctbal), 6) AS balance_mean,
  min(c_acctbal) AS balance_min, max(c_acctbal) AS balance_max, round(count_if(c_acctbal < 0) / count(*), 6) AS negative_rate FROM customer GROUP BY c_mktsegment""")
def training_step_metrics(spark, d):
    return E.measures(table(spark, d, "customer"), ["c_mktsegment"], {"balance": F.col("c_acctbal")}, {"negative": F.col("c_acctbal") < 0})


@query(f"""WITH {STEPS_SQL}, s AS (SELECT user_id, count(*) AS n, bool_or(tool = 'purchase') AS ok FROM steps GROUP BY user_id)
SELECT count(*) AS trajectories, count_if(ok) AS successes, CAST(sum(n) AS BIGINT) AS steps, round(sum(n) / count(*), 6) AS mean_steps FROM s""")
def offline_summary(spark, d):
    each = steps(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.some(F.col("tool") == "purchase").alias("ok"))
    return each.agg(F.count("*").alias("trajectories"), F.count_if("ok").alias("successes"), F.sum("n").alias("steps"), rate(F.sum("n"), F.count("*")).alias("mean_steps"))


# Groups of rollouts: the lines of an order.

LINES_SQL = "rollouts AS (SELECT l_orderkey AS uid, l_linenumber, floor(l_quantity / 25) AS reward, l_returnflag = 'R' AND l_quantity > 45 AS invalid, l_quantity >= 25 AS success FROM lineitem)"


def rollouts(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("uid"), "l_linenumber", F.floor(q / 25).cast("double").alias("reward"), ((F.col("l_returnflag") == "R") & (q > 45)).alias("invalid"), (q >= 25).alias("success")
    )


@query(f"""WITH {LINES_SQL}, v AS (SELECT *, CASE WHEN bool_or(invalid) OVER w THEN 'sampling_invalid' WHEN max(reward) OVER w - min(reward) OVER w <= 1e-8 THEN 'constant_reward' ELSE 'kept' END AS verdict
  FROM rollouts WINDOW w AS (PARTITION BY uid))
SELECT verdict, count(*) AS n, count(DISTINCT uid) AS groups, CAST(sum(uid * 31 + l_linenumber) AS BIGINT) AS digest FROM v GROUP BY verdict""")
def reward_varying_groups(spark, d):
    """Rows of groups that are kept, or why they are not."""
    rows = G.reward_varying(rollouts(spark, d), "uid", "reward", F.col("invalid"))
    return rows.groupBy("verdict").agg(F.count("*").alias("n"), F.count_distinct("uid").alias("groups"), F.sum(F.col("uid") * 31 + F.col("l_linenumber")).alias("digest"))


@query(f"""WITH {LINES_SQL}, g AS (SELECT uid, max(reward) - min(reward) <= 1e-8 AS same, max(abs(reward)) <= 1e-8 AS zero, bool_and(success) AS every_ok, NOT bool_or(success) AS none_ok, count(*) AS size FROM rollouts GROUP BY uid)
SELECT count(*) AS groups, count_if(same) AS all_equal, count_if(zero) AS all_zero, count_if(every_ok) AS all_success, count_if(none_ok) AS no_success, max(size) AS largest FROM g""")
def group_statistics(spark, d):
    return G.group_statistics(rollouts(spark, d), "uid", "reward", F.col("success"))


@query(f"""WITH {STEPS_SQL} SELECT k AS state, tool, count(*) AS visits, count_if(value > 50) AS successes, count_if(NOT value > 50) AS failures, min(value) AS lowest, max(value) AS highest FROM steps GROUP BY k, tool""")
def action_outcome_table(spark, d):
    return G.action_outcomes(steps(spark, d).withColumnRenamed("k", "state"), "state", "tool", F.col("value") > 50, "value")


@query(f"""WITH {STEPS_SQL}, o AS (SELECT DISTINCT k AS state, user_id, tool, value > 50 AS s, value FROM steps)
SELECT state, count(*) AS visits, count(DISTINCT user_id) AS visitors, bool_or(s) AND NOT bool_and(s) AS mixed, count(DISTINCT tool) > 1 AS divergent, max(value) - min(value) > 1e-8 AS varying FROM o GROUP BY state""")
def pivotal_state_groups(spark, d):
    return G.state_groups(steps(spark, d).withColumnRenamed("k", "state"), "state", "user_id", "tool", F.col("value") > 50, "value")


@query("""SELECT o_custkey, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) * CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE)
  / CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS DECIMAL(19,4)) * CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE), 6) AS ess, count(*) AS n FROM orders GROUP BY o_custkey""")
def kish_ess(spark, d):
    return G.kish_ess(table(spark, d, "orders"), "o_custkey", "o_totalprice")


@query("""WITH t AS (SELECT c_mktsegment, o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_mktsegment, CAST(sum(least(n, 2)) AS BIGINT) AS capped, count(*) AS tasks FROM t GROUP BY 1""")
def task_capped_count(spark, d):
    rows = table(spark, d, "orders").select("o_custkey").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return G.capped_count(rows, "c_mktsegment", "o_custkey", 2)


@query(f"""WITH {LINES_SQL} SELECT uid, count_if(reward >= 1) AS golds, count_if(reward < 1 AND NOT invalid) AS failures, count(*) AS n FROM rollouts GROUP BY uid
HAVING count_if(reward >= 1) > 0 AND count_if(reward < 1 AND NOT invalid) > 0""")
def recovery_mixed_groups(spark, d):
    return G.mixed_groups(rollouts(spark, d), "uid", F.col("reward") >= 1, (F.col("reward") < 1) & ~F.col("invalid"))


# Paired runs: a customer's orders before and from 1998 on.

RUNS_SQL = """runs AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'a' ELSE 'b' END AS run, o_custkey AS task_id,
  count_if(o_orderstatus = 'F') > count_if(o_orderstatus = 'O') AS ok, count_if(o_orderstatus = 'F') AS score FROM orders GROUP BY 1, 2),
pairs AS (SELECT task_id, a.ok AS a_ok, b.ok AS b_ok, b.score - a.score AS delta,
  CASE WHEN a.ok AND NOT b.ok THEN 'loss' WHEN NOT a.ok AND b.ok THEN 'gain' WHEN a.ok THEN 'both' ELSE 'neither' END AS flip
  FROM (FROM runs WHERE run = 'a') a JOIN (FROM runs WHERE run = 'b') b USING (task_id))"""


def runs(spark, d):
    status = F.col("o_orderstatus")
    run = F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), "a").otherwise("b")
    return table(spark, d, "orders").groupBy(run.alias("run"), F.col("o_custkey").alias("task_id")).agg(
        (F.count_if(status == "F") > F.count_if(status == "O")).alias("ok"), F.count_if(status == "F").alias("score")
    )


def _ab(spark, d):
    rows = runs(spark, d)
    return rows.where("run = 'a'"), rows.where("run = 'b'")


def deltas(spark, d):
    a, b = _ab(spark, d)
    return a.select("task_id", F.col("score").alias("s")).join(b.select("task_id", "score"), "task_id").select("task_id", (F.col("score") - F.col("s")).alias("delta"))


@query(f"WITH {RUNS_SQL} SELECT task_id, a_ok, b_ok, flip FROM pairs")
def paired_transitions(spark, d):
    return P.transitions(*_ab(spark, d), "task_id")


@query(f"""WITH {RUNS_SQL}, c AS (SELECT count_if(flip = 'gain') AS gains, count_if(flip = 'loss') AS losses FROM pairs)
SELECT gains, losses, round(CASE WHEN gains + losses = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(gains + losses + 1) - lgamma(i + 1) - lgamma(gains + losses - i + 1) - (gains + losses) * ln(2)))
  FROM range(0, 100000) t(i) WHERE i <= least(gains, losses))) END, 6) AS p FROM c""")
def mcnemar_exact(spark, d):
    flips = P.transitions(*_ab(spark, d), "task_id").agg(F.count_if(F.col("flip") == "gain").alias("gains"), F.count_if(F.col("flip") == "loss").alias("losses"))
    return flips.withColumn("p", F.round(P.mcnemar(F.col("gains"), F.col("losses")), 6))


@query(f"""WITH {RUNS_SQL} SELECT c_mktsegment, count(*) AS n, round(CAST(sum(CAST(delta AS DECIMAL(18,4))) AS DOUBLE) / count(delta), 6) AS mean_delta, count_if(delta > 0) AS improved,
  count_if(delta = 0) AS unchanged, count_if(delta < 0) AS worsened FROM pairs JOIN customer ON task_id = c_custkey GROUP BY 1""")
def paired_delta_summary(spark, d):
    rows = deltas(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), "c_mktsegment"), "task_id")
    return P.delta_summary(rows, ["c_mktsegment"], F.col("delta"))


@query("""WITH r AS (SELECT year(o_orderdate) AS run, o_custkey AS task_id, bool_or(o_orderstatus = 'F') AS ok FROM orders GROUP BY 1, 2)
SELECT a.run AS run_a, b.run AS run_b, count(*) AS n, count_if(a.ok AND NOT b.ok) AS losses, count_if(NOT a.ok AND b.ok) AS gains FROM r a JOIN r b USING (task_id) WHERE a.run < b.run GROUP BY 1, 2""")
def pairwise_runs(spark, d):
    """Years as runs; all pairs of them over common customers."""
    rows = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("run"), F.col("o_custkey").alias("task_id")).agg(F.some(F.col("o_orderstatus") == "F").alias("ok"))
    return P.run_pairs(rows, "run", "task_id", "ok")


#: The draws of all replicates in DuckDB: u of 20 bits by r and task, twelve for a digest.
DRAWS_SQL = """v AS (SELECT task_id, CAST(delta AS DECIMAL(18, 6)) AS delta FROM pairs),
h AS (SELECT task_id, delta, g, sha256('{seed}:' || g || ':' || task_id) AS h FROM v, range(0, 1667) a(g)),
u AS (SELECT g * 12 + 3 * k + j AS r, delta, (('0x' || substr(h, 1 + 15 * CAST(k AS INT), 15))::BIGINT >> CAST(20 * j AS INT)) & 1048575 AS u FROM h, range(0, 4) b(k), range(0, 3) c(j))"""


@query(f"""WITH {RUNS_SQL}, {DRAWS_SQL.format(seed=20260809)}, w AS (SELECT r, delta, {" + ".join(f"(u >= {t})::INT" for t in P.poisson_thresholds())} AS w FROM u WHERE r < 20000),
m AS (SELECT CAST(sum(w * delta) AS DOUBLE) / sum(w) AS m FROM w GROUP BY r HAVING sum(w) > 0)
SELECT round((SELECT CAST(sum(delta) AS DOUBLE) / count(*) FROM v), 6) AS mean_delta, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def paired_bootstrap_ci(spark, d):
    """20,000 resamples of all paired tasks, with weights from a hash."""
    return P.bootstrap_ci(deltas(spark, d), "delta", "task_id", 20_000, 20260809)


@query(f"""WITH {RUNS_SQL}, {DRAWS_SQL.format(seed=20260811)}, o AS (SELECT CAST(sum(delta) AS DOUBLE) / count(*) AS o, count(*) AS n FROM v),
m AS (SELECT CAST(sum(CASE WHEN u >= 524288 THEN delta ELSE -delta END) AS DOUBLE) / any_value(n) AS m, any_value(o) AS o FROM u, o WHERE r < 20000 GROUP BY r)
SELECT round(any_value(o), 6) AS observed, round((count_if(m >= o) + 1) / (count(*) + 1), 6) AS p, round(quantile_cont(m, 0.95), 6) AS null_95 FROM m""")
def signflip_permutation(spark, d):
    return P.sign_flip(deltas(spark, d), "delta", "task_id", 20_000, 20260811)


@query(f"""WITH {RUNS_SQL}, c AS (SELECT c_nationkey AS task_id, avg(delta) AS delta FROM pairs JOIN customer ON task_id = c_custkey GROUP BY 1), pairs_ AS (SELECT * FROM c),
{DRAWS_SQL.format(seed=20260813).replace("FROM pairs)", "FROM pairs_)")}, w AS (SELECT r, delta, {" + ".join(f"(u >= {t})::INT" for t in P.poisson_thresholds())} AS w FROM u WHERE r < 20000),
m AS (SELECT CAST(sum(w * delta) AS DOUBLE) / sum(w) AS m FROM w GROUP BY r HAVING sum(w) > 0)
SELECT round((SELECT CAST(sum(delta) AS DOUBLE) / count(*) FROM v), 6) AS mean_delta, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def cluster_bootstrap_ci(spark, d):
    """20,000 resamples of nations, each with the mean of its tasks."""
    nations = deltas(spark, d).join(table(spark, d, "customer"), F.col("task_id") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.avg("delta").alias("delta"))
    return P.bootstrap_ci(nations, "delta", "c_nationkey", 20_000, 20260813)


@query(f"""WITH {RUNS_SQL} SELECT flip, c_mktsegment, count(*) AS n, CAST(sum(delta) AS BIGINT) AS total_delta, min(task_id) AS first_task FROM pairs JOIN customer ON task_id = c_custkey
WHERE flip IN ('gain', 'loss') GROUP BY 1, 2""")
def flip_audit(spark, d):
    """Gains and losses by segment."""
    flips = P.transitions(*_ab(spark, d), "task_id").where("flip IN ('gain', 'loss')").join(deltas(spark, d), "task_id")
    rows = flips.join(table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), "c_mktsegment"), "task_id")
    return rows.groupBy("flip", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("delta").alias("total_delta"), F.min("task_id").alias("first_task"))
