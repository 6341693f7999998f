"""Views, options, plans and audits of rollouts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import search_query
from ..operators import rollouts as R
from .records import NESTED_SQL, nested
from .registry import query
from .tables import STEPS_SQL, steps, table


@query(f"WITH {STEPS_SQL} SELECT event_id, tool, CAST(NULL AS DOUBLE) AS reward FROM steps")
def outcome_blind_view(spark, d):
    return R.outcome_blind(steps(spark, d).select("event_id", "tool", F.col("value").alias("reward")))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown_tool' WHEN event_id % 11 = 0 THEN 'arguments_missing' WHEN event_id % 13 = 0 THEN 'arguments_not_json'
  WHEN event_id % 17 = 0 THEN 'action_mismatch' END AS reason FROM events""")
def step_validity(spark, d):
    allowed, i = F.array(*map(F.lit, ("view", "click", "purchase", "signup"))), F.col("event_id")
    arguments = F.when(i % 11 == 0, F.lit(None)).when(i % 13 == 0, "{k:").otherwise(F.col("props"))
    action = F.when(i % 17 == 0, "other").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", R.step_validity(F.col("event_type"), allowed, arguments, action, F.col("event_type")).alias("reason"))


@query(r"""SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'own ' || conv_id ELSE trim(text, e' \n') END AS query FROM (SELECT conv_id, replace(text, e'\n', ' ') AS text FROM conversations WHERE turn = 0)""")
def query_recovery(spark, d):
    own = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("own "), F.col("conv_id").cast("string"))).otherwise(" ")
    first = F.concat(F.lit(" instruction:  "), F.replace("text", F.lit("\n"), F.lit(" ")))
    return table(spark, d, "conversations").where("turn = 0").select("conv_id", R.recovered_query(own, first).alias("query"))


@query("SELECT item_id, trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[,;:!?|]+', ' ', 'g'), '[ \t\n]+', ' ', 'g')) AS query FROM benchmark")
def query_normaliser(spark, d):
    return table(spark, d, "benchmark").select("item_id", search_query(F.col("text")).alias("query"))


@query("SELECT p_partkey, array_to_string(list_filter([p_type, p_brand], lambda x: x <> ''), ',') AS kept FROM part")
def list_cleaner(spark, d):
    values = F.array(F.concat(F.lit("  "), F.col("p_type")), F.lit(" "), F.col("p_brand"), F.col("p_type"), F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(R.cleaned_list(values), ",").alias("kept"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN CAST(trunc(c_acctbal) AS BIGINT) ELSE -1 END AS kept FROM customer")
def token_value_filter(spark, d):
    kept = R.token_values(F.array(F.col("c_acctbal"), F.lit(float("nan")), F.lit(None).cast("double"), F.lit(float("inf"))))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.get(kept, F.lit(0)), F.lit(-1)).alias("kept"))


@query("SELECT conv_id, turn, least(500, 1200 - length(text), 100 + 500 - length(text)) AS room FROM conversations")
def remaining_budget(spark, d):
    n = F.length("text").cast("bigint")
    return table(spark, d, "conversations").select("conv_id", "turn", R.remaining_budget(F.lit(500), F.lit(1200), n, F.lit(100)).alias("room"))


@query("""WITH a AS (SELECT DISTINCT p_brand, p_type AS axis, CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'size' ELSE lower(p_type) END AS canonical FROM part)
SELECT p_brand, canonical, count(*) AS n, string_agg(axis, ',' ORDER BY axis) AS axes FROM a GROUP BY 1, 2 HAVING count(*) > 1""")
def option_axis_collisions(spark, d):
    canonical = F.when(F.col("axis").isin("SMALL", "MEDIUM", "LARGE"), "size").otherwise(F.lower("axis"))
    return R.axis_collisions(table(spark, d, "part").select("p_brand", F.col("p_type").alias("axis")), "p_brand", "axis", canonical)


@query("""WITH r AS (SELECT DISTINCT o_orderkey AS id, a.axis, CASE a.axis WHEN 'flag' THEN 'N' ELSE 'O' END AS value FROM orders, (SELECT unnest(['flag', 'status']) AS axis) a),
s AS (SELECT l_orderkey AS id, 'flag' AS axis, min(l_returnflag) AS chosen FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'status', min(l_linestatus) FROM lineitem WHERE l_linenumber < 4 GROUP BY 1),
x AS (SELECT r.id, max(CASE WHEN chosen IS NULL THEN 2 WHEN chosen <> value THEN 1 ELSE 0 END) AS s, count(*) AS n FROM r LEFT JOIN s ON r.id = s.id AND r.axis = s.axis GROUP BY r.id)
SELECT id, n, CASE s WHEN 2 THEN 'unverifiable' WHEN 1 THEN 'fail' ELSE 'pass' END AS status FROM x""")
def required_options(spark, d):
    wanted = F.array(F.struct(F.lit("flag").alias("axis"), F.lit("N").alias("value")), F.struct(F.lit("status").alias("axis"), F.lit("O").alias("value")))
    required = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.explode(wanted).alias("x")).select("id", "x.axis", "x.value")
    lines = table(spark, d, "lineitem")
    chosen = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_returnflag").alias("flag"), F.min(F.when(F.col("l_linenumber") < 4, F.col("l_linestatus"))).alias("status"))
    chosen = chosen.unpivot("id", ["flag", "status"], "axis", "value").where("value IS NOT NULL")
    return R.required_options(required, chosen, "id")


@query(f"WITH {STEPS_SQL}, s AS (SELECT DISTINCT user_id FROM steps) SELECT user_id, CAST(i AS INTEGER) AS branch, sha256('9:' || user_id || ':' || i) AS uid FROM s, (SELECT unnest(range(0, 4)) AS i)")
def branch_plan(spark, d):
    return R.branch_plan(steps(spark, d), "user_id", 4, 9)


@query("""SELECT l_orderkey, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous,
  bool_or(l_quantity > 25) AND NOT bool_and(l_quantity > 25) AS mixed, count(DISTINCT l_returnflag) > 1 AS divergent FROM lineitem GROUP BY 1""")
def suffix_group_summary(spark, d):
    rows = table(spark, d, "lineitem").withColumn("i", F.col("l_linenumber") - 1)
    return R.suffix_groups(rows, "l_orderkey", "i", "l_returnflag", F.col("l_quantity") > 25)


@query("""SELECT o_custkey % 16 AS bucket, count(*) FILTER (WHERE o_orderstatus <> 'P') AS eligible, count(*) FILTER (WHERE o_orderstatus = 'P') AS excluded,
  sha256(coalesce(string_agg(CASE WHEN o_orderstatus = 'P' THEN CAST(o_custkey AS VARCHAR) END, ',' ORDER BY o_custkey), '')) AS digest FROM orders GROUP BY 1""")
def exclusion_audit(spark, d):
    return R.exclusion_audit(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "P")


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' END AS fault FROM orders LEFT JOIN n ON l_orderkey = o_orderkey AND l_linenumber = 1 + o_orderkey % 7""")
def selection_locator(spark, d):
    selection = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("l_orderkey"), (1 + F.col("o_orderkey") % 7).cast("int").alias("l_linenumber"))
    return R.located(selection, table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("o_orderkey", "fault")


@query("""WITH s AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS "end" FROM conversations),
e AS (SELECT DISTINCT conv_id, p AS place FROM conversations, (SELECT unnest([0, 150, 900, 100000]) AS p))
SELECT conv_id, place, CAST(coalesce((SELECT CASE WHEN count(*) = 1 THEN min(start) END FROM s WHERE s.conv_id = e.conv_id AND start <= place AND place < "end"), -1) AS BIGINT) AS span_start FROM e""")
def turn_spans(spark, d):
    from pyspark.sql import Window

    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    end = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    spans = turns.select("conv_id", (end - F.col("n")).alias("start"), end.alias("end"))
    events = turns.select("conv_id").distinct().withColumn("place", F.explode(F.array(*map(F.lit, (0, 150, 900, 100000)))))
    return R.spans_of(events, spans, "conv_id", "place").select("conv_id", "place", F.coalesce("span_start", F.lit(-1)).alias("span_start"))


@query(f"""WITH {NESTED_SQL}, x AS (SELECT state, decision, avg(reward) FILTER (WHERE slot < 4) - avg(reward) FILTER (WHERE slot >= 4) AS delta FROM samples GROUP BY 1, 2)
SELECT state % 10 AS task, round(avg(delta), 6) AS mean_delta, round(avg(CASE WHEN delta > 0 THEN 1e0 ELSE 0e0 END), 6) AS consistency, count(*) AS weight FROM x GROUP BY 1""")
def task_cluster_deltas(spark, d):
    first = F.avg(F.when(F.col("slot") < 4, F.col("reward")))
    rows = nested(spark, d).groupBy("state", "decision").agg((first - F.avg(F.when(F.col("slot") >= 4, F.col("reward")))).alias("delta"))
    return R.cluster_deltas(rows.withColumn("task", F.col("state") % 10).withColumn("ok", F.col("delta") > 0), "task", "delta", "ok")


@query(f"WITH {STEPS_SQL} SELECT user_id, max(event_id) AS event_id FROM steps WHERE tool = 'purchase' GROUP BY 1")
def terminal_call(spark, d):
    return R.last_call(steps(spark, d).select("user_id", "event_id", "tool"), "user_id", "event_id", F.col("tool") == "purchase").select("user_id", "event_id")
