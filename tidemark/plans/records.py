"""Contracts, credit and datasets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.logic import mean_of
from ..operators import contracts as C
from ..operators import credit as K
from ..operators import datasets as T
from ..sources import catalog as SC
from ..sources import records as SR
from .registry import query
from .tables import STEPS_SQL, steps, table


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'P') USING (c_custkey)")
def completeness_gap(spark, d):
    """Customers without a pending order."""
    results = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return C.missing(table(spark, d, "customer"), results, "c_custkey")


@query("SELECT conv_id, turn FROM conversations ANTI JOIN (SELECT item_id AS conv_id FROM benchmark) USING (conv_id)")
def heldout_antijoin(spark, d):
    held = table(spark, d, "benchmark").select(F.col("item_id").alias("conv_id"))
    return table(spark, d, "conversations").select("conv_id", "turn").join(held, "conv_id", "left_anti")


@query("""WITH frozen AS (SELECT item_id AS id, sha256(text) AS h FROM benchmark)
SELECT doc_id, doc_id IN (SELECT id FROM frozen) AS by_id, sha256(text) IN (SELECT h FROM frozen) AS by_content FROM documents
WHERE doc_id IN (SELECT id FROM frozen) OR sha256(text) IN (SELECT h FROM frozen)""")
def leakage_guard(spark, d):
    """Documents that share an id or the content with a frozen set, here the benchmark."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    frozen = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.sha2("text", 256).alias("h"))
    ids = frozen.select("doc_id").distinct().withColumn("by_id", F.lit(True))
    contents = frozen.select("h").distinct().withColumn("by_content", F.lit(True))
    found = docs.join(ids, "doc_id", "left").join(contents, "h", "left").where("by_id OR by_content")
    return found.select("doc_id", F.coalesce("by_id", F.lit(False)).alias("by_id"), F.coalesce("by_content", F.lit(False)).alias("by_content"))


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_suppkey % 2 AS item, l_linenumber - 1 AS slot FROM lineitem),
w AS (SELECT DISTINCT l_orderkey, item, s.slot FROM r, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS slot) s)
SELECT l_orderkey, item, slot FROM w ANTI JOIN r USING (l_orderkey, item, slot)""")
def cartesian_completeness(spark, d):
    """Missing slots of the full product of an order's suppliers by parity and three lines."""
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 2).alias("item"), (F.col("l_linenumber") - 1).alias("slot"))
    return C.product_gaps(rows, "l_orderkey", "item", 3)


@query("""WITH i AS (SELECT o_orderkey AS key, count(*) AS intents FROM orders GROUP BY 1),
r AS (SELECT l_orderkey AS key, count(DISTINCT l_linestatus) AS records FROM lineitem GROUP BY 1),
b AS (SELECT key, coalesce(intents, 0) AS intents, coalesce(records, 0) AS records FROM i FULL JOIN r USING (key))
SELECT *, CASE WHEN records = 0 THEN 'open_intent' WHEN intents = 0 THEN 'orphan_record' ELSE 'count_mismatch' END AS fault FROM b WHERE records <> intents""")
def wal_closure(spark, d):
    """Orders as intents, the states of their lines as records."""
    intents = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    records = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linestatus").distinct()
    return C.closure(intents, records, "key")


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'one_sided', count(*) FROM (SELECT DISTINCT c_nationkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def union_and_disjoint(spark, d):
    """Sizes of the set operations on the nations of customers and suppliers."""
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"union": a.unionByName(b), "intersect": a.intersect(b), "except": a.subtract(b), "one_sided": C.same_sets(a, b, "k").select("k")}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return C.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


# Credit: a state is a user, a decision an event type, slots are the first eight events of it.

NESTED_SQL = f"""{STEPS_SQL}, n AS (SELECT user_id AS state, tool AS decision, value / 97 AS reward, CAST(row_number() OVER (PARTITION BY user_id, tool ORDER BY ts, event_id) - 1 AS INTEGER) AS slot,
  count(*) OVER (PARTITION BY user_id, tool) AS proposals FROM steps),
samples AS (SELECT * FROM n WHERE slot < 8 AND proposals >= 8), train AS (SELECT * FROM samples WHERE slot < 4), gate AS (SELECT * FROM samples WHERE slot >= 4)"""


def nested(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "tool")
    n = steps(spark, d).select(
        F.col("user_id").alias("state"), F.col("tool").alias("decision"), (F.col("value") / 97).alias("reward"), (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("slot"), F.count("*").over(w).alias("proposals")
    )
    return n.where("slot < 8 AND proposals >= 8")


@query(f"WITH {NESTED_SQL} SELECT state, decision, count(*) AS n, round(avg(reward), 6) AS mean, round(var_samp(reward) / count(*), 6) AS variance_of_mean FROM train GROUP BY 1, 2")
def variance_of_mean(spark, d):
    return K.variance_of_mean(nested(spark, d).where("slot < 4"), ["state", "decision"], F.col("reward"))


COV_SQL = """cov AS (SELECT a.state, a.decision AS d1, b.decision AS d2, covar_samp(a.reward, b.reward) / count(*) * CASE WHEN a.decision = b.decision THEN 1 ELSE 0.5 END AS c
  FROM train a JOIN train b ON a.state = b.state AND a.slot = b.slot GROUP BY a.state, a.decision, b.decision)"""


@query(f"WITH {NESTED_SQL}, {COV_SQL} SELECT state, d1, d2, round(c, 6) AS c FROM cov")
def paired_covariance(spark, d):
    cov = K.covariances(nested(spark, d).where("slot < 4"), "state", "decision", "slot", "reward")
    return cov.select("state", "d1", "d2", F.round("c", 6).alias("c"))


@query(f"""WITH {NESTED_SQL}, {COV_SQL}, q AS (SELECT state, decision, avg(reward) AS q, max(proposals) AS c FROM train GROUP BY 1, 2),
p AS (SELECT *, c / sum(c) OVER (PARTITION BY state) AS p FROM q),
r AS (SELECT cov.state, d1 AS decision, sum(cov.c * p) AS row, sum(CASE WHEN d1 = d2 THEN cov.c END) AS own FROM cov JOIN p ON cov.state = p.state AND d2 = p.decision GROUP BY 1, 2),
a AS (SELECT *, sum(p * q) OVER w AS mu, sum(p * row) OVER w AS noise FROM p JOIN r USING (state, decision) WINDOW w AS (PARTITION BY state)),
b AS (SELECT *, sum(p * (q - mu) * (q - mu)) OVER w AS var, greatest(sum(p * own) OVER w - noise, 0.0) AS unc FROM a WINDOW w AS (PARTITION BY state)),
c AS (SELECT *, greatest(var - unc, 0.0) / (greatest(var - unc, 0.0) + greatest(own + noise - 2 * row, 0.0) + 1e-8) AS kappa FROM b),
s AS (SELECT *, mu + kappa * (q - mu) AS shrunk FROM c), v AS (SELECT *, sum(p * shrunk) OVER (PARTITION BY state) AS v FROM s),
m AS (SELECT *, max(abs(shrunk - v)) OVER (PARTITION BY state) AS largest FROM v)
SELECT state, decision, round(mu, 6) AS mu, round(kappa, 5) AS kappa, round(shrunk, 6) AS shrunk, round((shrunk - v) * CASE WHEN largest = 0 THEN 1.0 ELSE least(1.0, 0.5 / largest) END, 6) + 0e0 AS advantage FROM m""")
def nested_shrinkage(spark, d):
    samples = nested(spark, d).where("slot < 4")
    decisions = samples.groupBy("state", "decision").agg(F.max("proposals").alias("proposals"))
    out = K.shrinkage(decisions, samples.select("state", "decision", "slot", "reward"))
    return out.select("state", "decision", F.round("mu", 6).alias("mu"), F.round("kappa", 5).alias("kappa"), F.round("shrunk", 6).alias("shrunk"), (F.round("advantage", 6) + F.lit(0.0)).alias("advantage"))


STATES_SQL = f"""{STEPS_SQL}, states AS (SELECT user_id AS state, count(*) AS proposals, count(DISTINCT tool) AS decisions, count(*) >= 60 AS slots_complete, count_if(k % 10 = 0) < 9 AS train_valid,
  count_if(k % 10 = 1) < 9 AS gate_valid, count_if(k < 7) / count(*) AS invalid_rate FROM steps GROUP BY user_id)"""


@query(f"""WITH {STATES_SQL}, f AS (SELECT state, concat_ws(',', CASE WHEN proposals < 4 THEN 'too_few_proposals' END, CASE WHEN decisions < 2 THEN 'too_few_decisions' END, CASE WHEN NOT slots_complete THEN 'incomplete_slots' END,
  CASE WHEN NOT train_valid THEN 'invalid_train' END, CASE WHEN NOT gate_valid THEN 'invalid_gate' END, CASE WHEN invalid_rate > 0.05 THEN 'invalid_rate' END) AS failures FROM states)
SELECT state, failures, failures = '' AS eligible FROM f""")
def structural_gate(spark, d):
    k = F.col("k")
    states = steps(spark, d).groupBy(F.col("user_id").alias("state")).agg(
        F.count("*").alias("proposals"),
        F.count_distinct("tool").alias("decisions"),
        (F.count("*") >= 60).alias("slots_complete"),
        (F.count_if(k % 10 == 0) < 9).alias("train_valid"),
        (F.count_if(k % 10 == 1) < 9).alias("gate_valid"),
        (F.count_if(k < 7) / F.count("*")).alias("invalid_rate"),
    )
    return K.structural_gate(states).select("state", "failures", "eligible")


@query(f"""WITH {NESTED_SQL}, t AS (SELECT state, decision, avg(reward) AS t FROM train GROUP BY 1, 2), g AS (SELECT state, decision, avg(reward) AS g FROM gate GROUP BY 1, 2),
b AS (SELECT state, max(t) AS hi, min(t) AS lo, arg_max(g, (t, decision)) AS top, arg_min(g, (t, decision)) AS bottom FROM t JOIN g USING (state, decision) GROUP BY state)
SELECT state, round(top - bottom, 6) AS delta, hi > lo AS identifiable, hi > lo AND top - bottom > 0 AS consistent FROM b""")
def heldout_diagnostic(spark, d):
    n = nested(spark, d)
    decisions = n.groupBy("state", "decision").agg(F.avg(F.when(F.col("slot") < 4, F.col("reward"))).alias("train"), F.avg(F.when(F.col("slot") >= 4, F.col("reward"))).alias("gate"))
    return K.held_out(decisions, "state", "decision", "train", "gate")


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 6) AS p25, round(quantile_cont(o_totalprice, 0.5), 6) AS p500, round(quantile_cont(o_totalprice, 0.975), 6) AS p975 FROM orders GROUP BY 1")
def percentile_linear(spark, d):
    return K.linear_percentiles(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", [0.025, 0.5, 0.975])


# Datasets: a session as a trajectory.

TRAJECTORY_SQL = f"""{STEPS_SQL}, t AS (SELECT user_id, user_id % 50 AS task, max(CASE WHEN tool = 'error' AND k < 4 THEN 'guard' END) AS error, count_if(tool = 'purchase') AS buys, max(value) AS top, min(k) AS low FROM steps GROUP BY user_id),
a AS (SELECT user_id, task, concat_ws(',', CASE WHEN error IS NOT NULL THEN 'has_error' END, CASE WHEN low > 3 THEN 'status_not_done' END, CASE WHEN buys < 10 THEN 'missing_buy' END, CASE WHEN top < 90 THEN 'purchase_not_successful' END) AS reasons FROM t)"""

SESSION_REJECTIONS = (("has_error", "error IS NOT NULL"), ("status_not_done", "low > 3"), ("missing_buy", "buys < 10"), ("purchase_not_successful", "top < 90"))


def trajectories(spark, d):
    tool = F.col("tool")
    rows = steps(spark, d).groupBy("user_id").agg(
        F.max(F.when((tool == "error") & (F.col("k") < 4), "guard")).alias("error"), F.count_if(tool == "purchase").alias("buys"), F.max("value").alias("top"), F.min("k").alias("low")
    )
    return T.acceptance(rows.withColumn("task", F.col("user_id") % 50), SESSION_REJECTIONS)


@query(f"WITH {TRAJECTORY_SQL} SELECT user_id, reasons, reasons = '' AS accepted FROM a")
def acceptance_reasons(spark, d):
    return trajectories(spark, d).select("user_id", F.array_join("reasons", ",").alias("reasons"), "accepted")


@query(f"""WITH {TRAJECTORY_SQL} SELECT user_id, task, CASE WHEN reasons <> '' THEN 'rejected' WHEN count(*) FILTER (WHERE reasons = '') OVER (PARTITION BY task ORDER BY user_id ROWS UNBOUNDED PRECEDING) > 1 THEN 'duplicate_task'
  ELSE 'accepted' END AS verdict FROM a""")
def sft_rows(spark, d):
    return T.first_accepted(trajectories(spark, d), "task", "user_id").select("user_id", "task", "verdict")


@query(r"""WITH w AS (SELECT conv_id, turn, role, string_split(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), ' ') AS words FROM conversations),
l AS (SELECT conv_id, flatten(list(list_transform(words, lambda x: CASE WHEN role = 'assistant' THEN length(x) ELSE -100 END) ORDER BY turn)) AS labels FROM w GROUP BY conv_id)
SELECT conv_id, CAST(len(labels) AS INTEGER) AS tokens, CAST(len(list_filter(labels, lambda x: x <> -100)) AS INTEGER) AS supervised, CAST(coalesce(list_sum(list_filter(labels, lambda x: x <> -100)), 0) AS BIGINT) AS digest FROM l WHERE len(labels) <= 600""")
def label_mask(spark, d):
    own = F.filter("labels", lambda x: x != -100)
    masks = T.label_mask(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", 600)
    return masks.select("conv_id", F.size("labels").alias("tokens"), F.size(own).alias("supervised"), F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("digest"))


@query("""WITH k AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant') AND length(text) % 10 <> 0)
SELECT conv_id, string_agg(role || ':' || CASE WHEN back = 1 THEN 'done' ELSE sha256(text) END, '|' ORDER BY turn) AS messages FROM k GROUP BY conv_id""")
def message_sanitise(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.sha2("text", 256).alias("content"), (F.length("text") % 10 == 0).alias("blocked"))))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("m")).select("conv_id", T.sanitised(F.col("m"), ("user", "assistant"), "done").alias("m"))
    return rows.where(F.size("m") > 0).select("conv_id", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], x["content"])), "|").alias("messages"))


@query()
def html_visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.visible_text(F.col("html")).alias("text"))


@query(r"""WITH c AS (SELECT page_id, list_transform(list_concat(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1), regexp_extract_all(html, '(?i)<button[^>]*>([^<]*)</button>', 1)), lambda x: lower(trim(x))) AS c FROM pages)
SELECT page_id, array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: list_position(c, c[i]) = i), lambda i: c[i]), '|') AS targets FROM c""")
def clickables(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(T.clickables(F.col("html")), "|").alias("targets"))


@query("SELECT sha256(string_agg(printf('%06d', conv_id) || chr(0) || h || chr(10), '' ORDER BY conv_id)) AS digest FROM (SELECT conv_id, sha256(string_agg(role, '' ORDER BY turn)) AS h FROM conversations GROUP BY conv_id)")
def combined_digest(spark, d):
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), "")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sha2(roles, 256).alias("h")).withColumn("path", F.format_string("%06d", "conv_id"))
    return T.combined_digest(rows, "path", "h")


@query("""SELECT o_orderpriority, round(CAST(sum(CAST(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS mean_reward FROM orders GROUP BY 1""")
def recomputed_reward(spark, d):
    """Mean reward in which an invalid row counts as zero."""
    reward = F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(mean_of(reward).alias("mean_reward"))


@query("""WITH x AS (SELECT CASE WHEN text IS NULL OR text = '' THEN 'no_text' WHEN len(text) > 2000 THEN 'too_long' WHEN lang NOT IN ('en', 'de') THEN 'language' END AS reason FROM documents)
SELECT count(*) AS total, count(*) - count(reason) AS kept, count(reason) AS dropped, array_to_string(list_sort(list(DISTINCT reason) FILTER (WHERE reason IS NOT NULL)), ',') AS reasons FROM x""")
def supervised_drop_counts(spark, d):
    """Documents as examples: how many are kept and dropped, counted while they are written."""
    text = F.coalesce("text", F.lit(""))
    reason = F.when(text == "", "no_text").when(F.length(text) > 2000, "too_long").when(~F.col("lang").isin("en", "de"), "language")
    kept, observed = T.with_drop_counts(table(spark, d, "documents"), reason)
    kept.write.format("noop").mode("overwrite").save()
    found = observed.get
    return spark.createDataFrame([(found["total"], found["kept"], found["dropped"], ",".join(found["reasons"]))], "total long, kept long, dropped long, reasons string")


@query("SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def parquet_take(spark, d):
    """The parts that large lines name, each of which has to be there."""
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    ids = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return SR.take(parts, ids.join(parts.select("p_partkey"), "p_partkey", "left_semi"), "p_partkey")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 100.0 ELSE p_retailprice END AS price, CASE p_size % 3 WHEN 0 THEN '$100.00' WHEN 1 THEN printf('$%.2f', p_retailprice) ELSE printf('$%.2f', p_retailprice) || ' to ' || printf('$%.2f', p_retailprice + 5) END AS price_tag FROM part""")
def catalogue_prices(spark, d):
    """Base price and price tag of products with no price, one and three."""
    part, price = table(spark, d, "part"), F.col("p_retailprice")
    pricing = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<double>")).when(F.col("p_size") % 3 == 1, F.array(price)).otherwise(F.array(price, price + 5, price + 9))
    none = F.create_map().cast("map<string,array<struct<value:string,price:double>>>")
    products = part.select(F.col("p_partkey").cast("string").alias("asin"), "p_partkey", pricing.alias("pricing"), none.alias("customization_options"))
    found = SC.clean(products.unionByName(products), "p_partkey")
    return found.select("p_partkey", SC.base_price(F.col("pricing")).alias("price"), "price_tag")


@query("""WITH i AS (SELECT p_partkey, unnest(range(0, p_size % 4)) AS k, p_type, p_size FROM part), g AS (SELECT * FROM i WHERE k <> 1)
SELECT row_number() OVER (ORDER BY p_partkey, k) - 1 AS goal_id, CAST(p_partkey AS VARCHAR) AS asin, p_type || ' ' || k AS instruction FROM g""")
def flattened_goals(spark, d):
    """The goals of all parts, numbered; every second instruction of a part has no attributes."""
    part = table(spark, d, "part")
    every = F.when(F.col("p_size") % 4 > 0, F.sequence(F.lit(0), (F.col("p_size") % 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    attributes = lambda k: F.when(k == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))
    instructions = F.transform(every, lambda k: F.struct(F.concat_ws(" ", "p_type", k.cast("string")).alias("instruction"), attributes(k).alias("attributes")))
    products = part.select(F.col("p_partkey").cast("string").alias("asin"), "p_partkey", instructions.alias("instructions"))
    return SC.goals(products, "p_partkey").select("goal_id", "asin", "instruction")
