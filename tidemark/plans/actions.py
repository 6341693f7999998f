"""Single actions, pages and lookups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import seed63
from ..operators import actions as A
from ..operators import scoring as S
from ..operators import search as R
from .registry import query
from .tables import STEPS_SQL, steps, table


@query(f"""WITH {STEPS_SQL} SELECT event_id, CASE WHEN tool = 'error' THEN 'unknown_tool' WHEN k % 7 = 0 THEN 'no_observation' WHEN tool = 'view' AND NOT contains('page ' || CAST(k AS VARCHAR), '3') THEN 'not_visible'
  WHEN tool = 'click' AND k % 5 = 0 THEN 'missing_target' END AS reason FROM steps""")
def action_guard(spark, d):
    tool, k = F.col("tool"), F.col("k")
    page = F.when(k % 7 != 0, F.concat(F.lit("page "), k.cast("string")))
    target = F.when(tool == "view", "3").when(k % 5 == 0, "").otherwise("x")
    known = F.array(*map(F.lit, ("open", "click", "purchase", "signup", "view")))
    as_open = F.when(tool == "view", "open").otherwise(tool)
    return steps(spark, d).select("event_id", A.guard(page, as_open, target, known).alias("reason"))


@query(f"""WITH {STEPS_SQL} SELECT event_id, array_to_string(list_sort(list_filter(['k', tool, 'note'], lambda x: x NOT IN ('k', 'view'))), ',') AS extra FROM steps""")
def schema_extra_args(spark, d):
    args = F.create_map(F.lit("k"), F.lit("1"), F.col("tool"), F.lit("1"), F.lit("note"), F.lit("1"))
    return steps(spark, d).select("event_id", F.array_join(A.extra_args(args, F.array(F.lit("k"), F.lit("view"))), ",").alias("extra"))


@query("SELECT p_partkey, 'a=' || left(p_name, 5) || ';b=' || left(p_brand, 5) AS args FROM part")
def bounded_parameters(spark, d):
    args = A.bounded_parameters(F.create_map(F.lit("c"), F.col("p_type"), F.lit("a"), F.col("p_name"), F.lit("b"), F.col("p_brand")), 2, 5)
    return table(spark, d, "part").select("p_partkey", F.concat_ws(";", F.concat(F.lit("a="), args["a"]), F.concat(F.lit("b="), args["b"])).alias("args"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'P' OR o_orderpriority IN ('1-URGENT') OR o_totalprice > 400000) AS failures FROM orders GROUP BY 1""")
def infrastructure_failures(spark, d):
    failed = A.infrastructure_failure(F.when(F.col("o_orderstatus") == "P", "x"), F.when(F.col("o_orderpriority") == "1-URGENT", "TimeoutError"), F.when(F.col("o_totalprice") > 400000, "lost connection"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(failed).alias("failures"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND o_orderpriority <> '5-LOW') AS strict, count(*) AS n FROM orders")
def strict_success(spark, d):
    ok = A.strict_success(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F"), F.col("o_totalprice") > 1000, F.col("o_orderpriority") != "5-LOW")
    return table(spark, d, "orders").agg(F.count_if(ok).alias("strict"), F.count("*").alias("n"))


@query("""SELECT conv_id, role || '[' || coalesce(nullif(CASE WHEN turn % 2 = 0 THEN '' ELSE left(sha256(text), 8) END, ''), CAST(turn AS VARCHAR)) || ']' AS head, turn,
  CASE WHEN turn = 1 THEN 'REJECTED ' || role || '[' || left(sha256(text), 8) || '] [first]' ELSE '' END AS rejected FROM conversations""")
def action_summary(spark, d):
    digest = F.left(F.sha2("text", 256), F.lit(8))
    fields = [F.when(F.col("turn") % 2 == 0, "").otherwise(digest), F.col("turn").cast("string")]
    rows = table(spark, d, "conversations")
    none = F.lit(None).cast("string")
    return rows.select("conv_id", A.summary_line(F.col("role"), fields, none).alias("head"), "turn", F.when(F.col("turn") == 1, A.summary_line(F.col("role"), fields, F.lit("first"))).otherwise("").alias("rejected"))


@query("SELECT p_partkey, array_to_string(list_transform(range(0, 4), lambda i: CAST((floor(p_retailprice / 10) + 1) * 10 + 10 * i AS BIGINT)), ',') AS ladder FROM part")
def price_ladder(spark, d):
    steps_ = F.transform(A.price_ladder(F.col("p_retailprice"), 4), lambda x: x.cast("bigint").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(steps_, ",").alias("ladder"))


@query(f"""WITH {STEPS_SQL} SELECT event_id, last_value(CASE WHEN tool <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS observed FROM steps""")
def previous_observation(spark, d):
    return A.previous_value(steps(spark, d), "user_id", ["ts", "event_id"], F.when(F.col("tool") != "error", F.col("value")), "observed").select("event_id", "observed")


@query("""WITH c AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM conversations)
SELECT conv_id, CAST(coalesce(min(e) FILTER (WHERE e >= 700), -1) AS BIGINT) AS trim_at FROM c GROUP BY conv_id""")
def aligned_trim(spark, d):
    lengths = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("bigint").alias("n")))), lambda x: x["n"])
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(lengths.alias("n"))
    ends = F.transform("n", lambda x, i: F.aggregate(F.slice("n", 1, i + 1), F.lit(0).cast("bigint"), lambda a, y: a + y))
    return rows.select("conv_id", F.coalesce(A.aligned_trim(ends, F.lit(700)), F.lit(-1)).alias("trim_at"))


@query("SELECT sha256(text) AS content, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def copied_rollouts(spark, d):
    return A.copied(table(spark, d, "documents").select("doc_id", "text"), F.col("text"), "doc_id")


@query("""SELECT state, count(*) AS n FROM (SELECT CASE WHEN f.l_orderkey IS NULL THEN 'open' WHEN f.accepted THEN 'accepted' ELSE 'rejected' END AS state
  FROM orders o LEFT JOIN (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS accepted FROM lineitem GROUP BY 1) f ON o_orderkey = l_orderkey) GROUP BY 1""")
def attempt_outcomes(spark, d):
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.every(F.col("l_returnflag") != "R").alias("accepted"))
    return A.outcomes_of(table(spark, d, "orders").select("o_orderkey"), found, ["o_orderkey"]).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT p_brand, arg_min(p_partkey, (p_size, p_name, p_partkey)) AS p_partkey, min(p_size) AS p_size FROM part GROUP BY p_brand")
def gold_demonstration(spark, d):
    rows = table(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_name")
    return A.demonstration(rows, "p_brand", F.col("p_size"), F.col("p_name"), F.col("p_partkey")).select("p_brand", "p_partkey", "p_size")


@query("SELECT c_custkey, CAST(('0x' || substr(sha256('7:' || c_custkey || ':0'), 1, 16))::UBIGINT % 9223372036854775808 AS BIGINT) AS seed FROM customer")
def suffix_seeds(spark, d):
    return table(spark, d, "customer").select("c_custkey", seed63(F.concat(F.lit("7:"), F.col("c_custkey").cast("string"), F.lit(":0"))).alias("seed"))


@query("SELECT c_custkey, i AS suffix, sha256('plan:' || c_custkey || ':' || i) AS slot FROM customer, (SELECT unnest(range(0, 4)) AS i)")
def slot_expansion(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("suffix"))
    return rows.withColumn("slot", F.sha2(F.concat_ws(":", F.lit("plan"), F.col("c_custkey").cast("string"), F.col("suffix").cast("string")), 256))


@query("""WITH r AS (SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank, p_type FROM part)
SELECT p_partkey, p_type, CAST(CASE WHEN rank BETWEEN 21 AND 40 THEN rank - 20 WHEN rank < 21 THEN rank + 20 ELSE rank END AS INTEGER) AS rank FROM r""")
def block_shift(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    ranked = table(spark, d, "part").select("p_partkey", "p_type", F.row_number().over(w).alias("rank"))
    return R.in_blocks(ranked)


@query("""SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 0
ORDER BY -ln((CAST(('0x' || substr(sha256('7:' || p_partkey), 1, 13)) AS BIGINT) + 0.5e0) / 4503599627370496e0) / p_retailprice, p_partkey LIMIT 100""")
def weighted_sample(spark, d):
    """A hundred parts by price."""
    return R.weighted_sample(table(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("p_retailprice"), "p_partkey", 100, 7)


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#' || (1 + p_size % 25) THEN 'pass' ELSE 'fail' END AS brand, CASE WHEN contains(p_name, 'ring') AND NOT contains(p_name, 'spring') THEN 'pass' ELSE 'fail' END AS model FROM part")
def brand_and_model(spark, d):
    wanted = F.concat(F.lit("Brand#"), (1 + F.col("p_size") % 25).cast("string"))
    return table(spark, d, "part").select("p_partkey", S.brand_match(F.array(wanted), F.array("p_brand")).alias("brand"), S.model_match(F.array(F.lit("ring")), F.col("p_name")).alias("model"))


@query("SELECT o_custkey, o_orderkey, CASE WHEN n >= 2 AND m >= 12 AND p = 0 THEN 'graceful_abstain' ELSE 'early_abstain' END AS outcome FROM (SELECT o_custkey, max(o_orderkey) AS o_orderkey, count(DISTINCT o_orderstatus) AS n, count(*) AS m, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS p FROM orders GROUP BY 1)")
def abstain_outcome(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.count_distinct("o_orderstatus").alias("n"), F.count("*").alias("m"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("p"))
    return rows.select("o_custkey", "o_orderkey", S.abstain(F.col("n"), F.col("m") - 10, F.col("p")).alias("outcome"))


@query(f"""WITH {STEPS_SQL} SELECT event_id, CASE tool WHEN 'view' THEN 'click[' || k || ']' WHEN 'click' THEN 'click[Next >]' WHEN 'signup' THEN 'search[' || k || ']' WHEN 'purchase' THEN 'click[Buy Now]' END AS action FROM steps""")
def environment_action(spark, d):
    tool, k = F.col("tool"), F.col("k").cast("string")
    name = F.when(tool == "view", "open_product").when(tool == "click", "next_page").when(tool == "signup", "search_products").when(tool == "purchase", "buy_now").otherwise("think")
    args = F.when(tool == "view", F.create_map(F.lit("asin"), k)).otherwise(F.create_map(F.lit("query"), k))
    return steps(spark, d).select("event_id", A.environment_action(name, args).alias("action"))


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 5 = 0 AS bad, o_orderstatus = 'P' AS unsure, o_orderpriority = '5-LOW' AS out FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN bad THEN 'infrastructure_invalid' END, CASE WHEN unsure THEN 'reward_unverifiable' END, CASE WHEN out AND NOT bad AND NOT unsure THEN 'reward_sampling_invalid' END) AS reasons,
  CASE WHEN o_orderkey % 11 = 0 THEN 'missing_reward' WHEN o_orderkey % 13 = 0 THEN 'wrong_policy_version' WHEN (o_orderkey % 3 <> 0) <> NOT (bad OR unsure OR out) THEN 'inconsistent_valid_for_learning' END AS fault FROM x""")
def group_signals(spark, d):
    from ..operators import groups as G

    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(key % 11 != 0, F.col("o_totalprice")).alias("total"), F.col("o_totalprice").alias("terminal_utility"), F.when(key % 13 == 0, "old").otherwise("v1").alias("policy_reward_version"),
        (state == "F").alias("purchase_success"), (key % 5 == 0).alias("infrastructure_invalid"), (state == "P").alias("reward_unverifiable"), (F.col("o_orderpriority") == "5-LOW").alias("sampling_invalid"),
        F.lit("").alias("invalid_reason"), (key % 3 != 0).alias("valid_for_learning"),
    )
    return G.signals(rows, "o_orderkey", "v1").select("o_orderkey", F.array_join("reasons", ",").alias("reasons"), "fault")


@query(r"""SELECT event_id, CASE event_type WHEN 'view' THEN 'API-Key' WHEN 'click' THEN 'x_api_key' WHEN 'signup' THEN 'Password' ELSE '' END AS secrets FROM events""")
def secret_rejection(spark, d):
    """Names of secrets among the keys of a step's record."""
    from ..operators import rollouts as O

    kind = F.col("event_type")
    keys = F.array(F.lit("k"), F.when(kind == "view", "API-Key").when(kind == "click", "x_api_key").when(kind == "signup", "Password").otherwise("apikeys"))
    return O.reject_secrets(table(spark, d, "events").select("event_id", "event_type", F.create_map(F.lit("k"), F.lit("v")).alias("m")), "m").select("event_id", F.array_join(O.secret_keys(keys), ",").alias("secrets"))
