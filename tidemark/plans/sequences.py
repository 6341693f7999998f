"""Ordered steps of sessions, and splits, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import branches as B
from ..operators import sequences as S
from ..operators import splits as D
from .registry import query
from .tables import STEPS_SQL, steps, table

KEY, ORDER = "user_id", ["ts", "event_id"]
W = "(PARTITION BY user_id ORDER BY ts, event_id)"
SIGNATURE_SQL = "(tool || ':' || CAST(k % 3 AS VARCHAR))"


def signature():
    return F.concat_ws(":", "tool", (F.col("k") % 3).cast("string"))


@query(f"""WITH {STEPS_SQL}, x AS (SELECT *, row_number() OVER {W} AS n, count(*) FILTER (WHERE tool <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM steps)
SELECT event_id, printf('e%04d', n) AS event, printf('a%04d', n) AS attempt, CASE WHEN tool = 'error' THEN '' ELSE printf('s%04d', s - 1) END AS executed,
  CASE WHEN tool = 'error' THEN 'guard_rejection' ELSE 'tool_step' END AS event_type FROM x""")
def normalized_event_stream(spark, d):
    return S.event_ids(steps(spark, d), KEY, ORDER, F.col("tool") == "error").select("event_id", "event", "attempt", "executed", "event_type")


@query(f"""WITH {STEPS_SQL}, x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, {SIGNATURE_SQL} ORDER BY ts, event_id) > 1 AS again, lag({SIGNATURE_SQL}) OVER {W} = {SIGNATURE_SQL} AS same FROM steps)
SELECT user_id, count_if(again) AS duplicates, count_if(same) AS consecutive FROM x GROUP BY user_id""")
def duplicate_action_counts(spark, d):
    return S.repeats(steps(spark, d), KEY, ORDER, signature())


@query(f"""WITH {STEPS_SQL}, x AS (SELECT event_id, {SIGNATURE_SQL} AS s, lag({SIGNATURE_SQL}, 1) OVER {W} AS a, lag({SIGNATURE_SQL}, 2) OVER {W} AS b, lag({SIGNATURE_SQL}, 3) OVER {W} AS c FROM steps)
SELECT event_id, coalesce(s = a, false) OR coalesce(s = b, false) OR coalesce(s = c, false) AS repeated FROM x""")
def recent_window_repeat(spark, d):
    return S.in_recent(steps(spark, d), KEY, ORDER, signature()).select("event_id", "repeated")


@query(f"""WITH {STEPS_SQL} SELECT user_id, event_id, tool FROM steps QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 48""")
def keep_last_n_trace(spark, d):
    return S.keep_last(steps(spark, d), KEY, ORDER, 48).select("user_id", "event_id", "tool")


ISLANDS = f"""x AS (SELECT *, CASE WHEN lag(tool) OVER {W} = tool THEN 0 ELSE 1 END AS c FROM steps),
y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM x)"""


@query(f"""WITH {STEPS_SQL}, {ISLANDS}, z AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, i ORDER BY ts, event_id) AS run FROM y)
SELECT user_id, max(run) AS longest, count_if(run = 1) AS runs FROM z GROUP BY user_id""")
def repeat_run_length(spark, d):
    runs = S.run_lengths(steps(spark, d), KEY, ORDER, F.col("tool"))
    return runs.groupBy("user_id").agg(F.max("run").cast("bigint").alias("longest"), F.count_if(F.col("run") == 1).alias("runs"))


PROGRESS = "p AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) = 1 AS progress FROM steps)"
STREAK = """q AS (SELECT *, sum(CAST(progress AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM p),
r AS (SELECT *, CAST(sum(1 - CAST(progress AS INT)) OVER (PARTITION BY user_id, i ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM q)"""


def progressing(spark, d):
    return S.first_seen(steps(spark, d), KEY, ORDER, ["k"]).withColumnRenamed("first", "progress")


@query(f"WITH {STEPS_SQL}, {PROGRESS}, {STREAK} SELECT user_id, max(streak) AS longest FROM r GROUP BY user_id")
def no_progress_streak(spark, d):
    return S.streak(progressing(spark, d), KEY, ORDER, F.col("progress")).groupBy("user_id").agg(F.max("streak").alias("longest"))


@query(f"""WITH {STEPS_SQL}, e AS (SELECT DISTINCT user_id, CASE tool WHEN 'view' THEN 'product' WHEN 'click' THEN 'subpage' WHEN 'signup' THEN 'result_set' END AS kind, k FROM steps WHERE tool IN ('view', 'click', 'signup'))
SELECT user_id, kind, count(*) AS found, least(count(*), CASE kind WHEN 'product' THEN 5 WHEN 'subpage' THEN 6 ELSE 3 END) AS credited FROM e GROUP BY user_id, kind""")
def evidence_credit_budget(spark, d):
    kind = F.when(F.col("tool") == "view", "product").when(F.col("tool") == "click", "subpage").when(F.col("tool") == "signup", "result_set")
    return S.credited(steps(spark, d).withColumn("kind", kind), KEY, ORDER, "kind", "k")


@query(f"""WITH {STEPS_SQL}, {PROGRESS}, {STREAK}, x AS (SELECT *, CASE WHEN lag({SIGNATURE_SQL}) OVER {W} = {SIGNATURE_SQL} THEN 0 ELSE 1 END AS c FROM r),
y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS j FROM x),
z AS (SELECT user_id, CAST(row_number() OVER {W} AS INT) AS step, row_number() OVER (PARTITION BY user_id, j ORDER BY ts, event_id) AS run, streak FROM y),
t AS (SELECT user_id, step, CASE WHEN run >= 3 THEN 'repeat_loop' WHEN streak >= 4 THEN 'no_progress' WHEN step >= 35 THEN 'max_steps' END AS reason FROM z)
SELECT user_id, step, reason FROM t WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY step) = 1""")
def first_terminal_reason(spark, d):
    return S.first_terminal(progressing(spark, d), KEY, ORDER, signature(), "progress")


PHASE = f"""x AS (SELECT *, coalesce(sum(CASE WHEN tool IN ('view', 'signup', 'purchase') THEN 1 ELSE 0 END) OVER {W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i,
  coalesce(last_value(CASE WHEN tool = 'view' THEN true WHEN tool IN ('signup', 'purchase') THEN false END IGNORE NULLS) OVER {W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS open FROM steps),
ph AS (SELECT *, CASE WHEN open THEN coalesce(sum(CASE WHEN tool = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, i ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS options FROM x)"""


def phased(spark, d):
    return S.phases(steps(spark, d), KEY, ORDER, F.col("tool") == "view", F.col("tool").isin("signup", "purchase"), F.col("tool") == "click")


@query(f"WITH {STEPS_SQL}, {PHASE} SELECT event_id, open, CAST(options AS BIGINT) AS options FROM ph")
def public_phase(spark, d):
    return phased(spark, d).select("event_id", "open", F.col("options").cast("bigint").alias("options"))


#: The name of the accepted actions before each step, in DuckDB: PREFIX needs the columns key, place (by which a session is ordered), ok and action.
PREFIX_SQL = """counted AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY key ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prefix_n FROM acts),
hashed AS (SELECT *, CASE WHEN ok THEN md5(prefix_n || ':' || action) END AS h FROM counted),
prefixed AS (SELECT *, prefix_n || '-' || lower(lpad(printf('%x', coalesce(bit_xor(('0x' || substr(h, 1, 15))::BIGINT) OVER before, 0)), 15, '0')) || '-' ||
  lower(lpad(printf('%x', coalesce(bit_xor(('0x' || substr(h, 16, 15))::BIGINT) OVER before, 0)), 15, '0')) AS prefix_id FROM hashed
  WINDOW before AS (PARTITION BY key ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"""WITH {STEPS_SQL}, acts AS (SELECT *, user_id AS key, row_number() OVER {W} AS place, tool <> 'error' AS ok, tool || k AS action FROM steps), {PREFIX_SQL}
SELECT event_id, prefix_n, prefix_id FROM prefixed""")
def accepted_prefix(spark, d):
    """Length and name of the accepted actions before each step."""
    found = B.with_prefix(steps(spark, d), KEY, ORDER, F.col("tool") != "error", F.concat("tool", F.col("k").cast("string")))
    return found.select("event_id", "prefix_n", "prefix_id")


# A session's ledger has the tools of its accepted steps, and ends with a purchase of value 90 or more. What is seen after an action is the
# tool's name; every step but each 29th tells how many actions came before it, each 31st one too many, and each 37th saw something else.


def ledger(spark, d):
    rows = steps(spark, d).where("tool <> 'error'")
    at = F.row_number().over(Window.partitionBy(KEY).orderBy(*ORDER))
    return rows.withColumn("seq", at)


def events_of(spark, d):
    before = Window.partitionBy(KEY).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    ok, e = F.col("tool") != "error", F.col("event_id")
    n = F.coalesce(F.count(F.when(ok, 1)).over(before), F.lit(0))
    seen = F.coalesce(F.last(F.when(ok, F.col("tool")), ignorenulls=True).over(before), F.lit("start"))
    rows = steps(spark, d).withColumn("n", n).withColumn("seen", seen)
    count = F.when(e % 29 == 0, None).when(e % 31 == 0, F.col("n") + 1).otherwise(F.col("n"))
    return rows.withColumn("prefix_action_count", count).withColumn("observation", F.when(e % 37 == 0, "else").otherwise(F.col("seen")))


def bound(spark, d):
    rows = ledger(spark, d)
    states = B.ledger_states(rows, KEY, "seq", F.col("tool"), (F.col("tool") == "purchase") & (F.col("value") >= 90), F.col("tool"))
    sessions = table(spark, d, "events").select(KEY).distinct().select(KEY, (F.col(KEY) % 3).alias("task"), F.lit("start").alias("initial"))
    return B.bound_events(events_of(spark, d), sessions, states, KEY)


BOUND_SQL = f"""acts AS (SELECT *, user_id AS key, row_number() OVER {W} AS place, tool <> 'error' AS ok, tool AS action FROM steps), {PREFIX_SQL},
led AS (SELECT *, prefix_n + 1 AS seq, tool = 'purchase' AND value >= 90 AS done FROM prefixed WHERE ok),
ev AS (SELECT *, CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN prefix_n + 1 ELSE prefix_n END AS cnt,
  CASE WHEN event_id % 37 = 0 THEN 'else' ELSE coalesce(last_value(CASE WHEN ok THEN tool END IGNORE NULLS) OVER (PARTITION BY key ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'start') END AS obs FROM prefixed),
size AS (SELECT key, count(*) AS n FROM led GROUP BY key),
j AS (SELECT ev.*, cur.done AS over, cur.tool AS now, coalesce(size.n, 0) AS most FROM ev LEFT JOIN size USING (key) LEFT JOIN led cur ON cur.key = ev.key AND cur.seq = ev.cnt),
why AS (SELECT *, CASE WHEN cnt IS NULL THEN 'invalid_prefix_action_count' WHEN cnt > most THEN 'prefix_action_count_out_of_range' WHEN cnt > 0 AND over THEN 'branch_after_terminal'
  WHEN obs <> CASE WHEN cnt = 0 THEN 'start' ELSE now END THEN 'event_observation_hash_mismatch' END AS fault FROM j)"""


@query(f"""WITH {STEPS_SQL}, {BOUND_SQL}
SELECT event_id, fault, CASE WHEN fault IS NULL AND why.cnt = why.prefix_n THEN sha256((user_id % 3) || '|' || why.prefix_id || '|' || obs) END AS state_id FROM why""")
def ledger_prefix_join(spark, d):
    """The state of each step, by the part of its session's ledger that came before it."""
    found = bound(spark, d)
    return found.select("event_id", "fault", F.when(F.col("prefix_action_count") == F.col("n"), F.col("state_id")).alias("state_id"))


@query(f"""WITH {STEPS_SQL}, {BOUND_SQL}, v AS (SELECT sha256((user_id % 3) || '|' || prefix_id || '|' || obs) AS state_id, tool, value >= 50 AS won, value FROM why WHERE fault IS NULL AND cnt = prefix_n),
g AS (SELECT state_id, count(*) AS visits, count(DISTINCT tool) AS unique_next_actions, bool_or(won) AND NOT bool_and(won) AS mixed, max(value) - min(value) > 1e-8 AS varies FROM v GROUP BY 1)
SELECT state_id, visits, unique_next_actions, mixed AS mixed_strict, varies AS utility_varying, mixed AND unique_next_actions > 1 AS eligible_mixed_strict, varies AND unique_next_actions > 1 AS eligible_mixed_utility,
  visits >= 4 AND mixed AND unique_next_actions > 1 AS natural_suffix_group_candidate FROM g WHERE visits >= 2""")
def branch_state_groups(spark, d):
    """States that several sessions came to: how they went on."""
    visits = bound(spark, d).where(F.col("fault").isNull() & (F.col("prefix_action_count") == F.col("n")))
    visits = visits.withColumn("won", F.col("value") >= 50)
    return B.branch_groups(visits, ["state_id"], "event_id", "tool", "won", "value").drop("action_outcomes")


@query(f"""WITH {STEPS_SQL}, {PHASE}, y AS (SELECT *, lag(tool) OVER {W} AS before, lag({SIGNATURE_SQL}) OVER {W} AS last FROM ph)
SELECT event_id, concat_ws(',', CASE WHEN tool = 'view' THEN 'candidate_open' END, CASE WHEN tool = 'click' AND open THEN 'option_selected' END, CASE WHEN before = 'error' THEN 'post_guard' END,
  CASE WHEN last = {SIGNATURE_SQL} THEN 'repeat_attempt' END, CASE WHEN tool = 'purchase' THEN 'pre_commit' END, CASE WHEN open AND tool IN ('signup', 'view') THEN 'candidate_abandonment' END,
  CASE WHEN tool = 'click' AND options > 0 THEN 'option_reselection' END) AS labels FROM y""")
def pivotal_labels(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy(KEY).orderBy(*ORDER)
    s = phased(spark, d).withColumn("before", F.lag("tool").over(w)).withColumn("last", F.lag(signature()).over(w))
    labels = [
        F.when(F.col("tool") == "view", "candidate_open"),
        F.when((F.col("tool") == "click") & F.col("open"), "option_selected"),
        F.when(F.col("before") == "error", "post_guard"),
        F.when(F.col("last") == signature(), "repeat_attempt"),
        F.when(F.col("tool") == "purchase", "pre_commit"),
        F.when(F.col("open") & F.col("tool").isin("signup", "view"), "candidate_abandonment"),
        F.when((F.col("tool") == "click") & (F.col("options") > 0), "option_reselection"),
    ]
    return s.select("event_id", F.concat_ws(",", *labels).alias("labels"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> row_number() OVER w THEN 'sequence' WHEN lag(l_linestatus) OVER w <> l_linestatus THEN 'chain' END AS code
  FROM (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
y AS (SELECT l_orderkey, coalesce(arg_min(code, l_linenumber) FILTER (WHERE code IS NOT NULL), 'ok') AS code, count(*) AS n FROM x GROUP BY l_orderkey)
SELECT code, count(*) AS orders, CAST(sum(n) AS BIGINT) AS lines FROM y GROUP BY code""")
def hash_chain_check(spark, d):
    """Lines as a ledger: numbers without gaps, one status from line to line."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("status"))
    found = S.chain_check(lines, "l_orderkey", "l_linenumber", 1, F.col("status"), F.col("status"))
    return found.groupBy("code").agg(F.count("*").alias("orders"), F.sum("n").alias("lines"))


@query(f"""WITH {STEPS_SQL}, b AS (SELECT user_id, max(event_id) AS buy FROM steps WHERE tool = 'purchase' GROUP BY user_id),
o AS (SELECT user_id, buy, max(event_id) AS opened FROM steps JOIN b USING (user_id) WHERE tool = 'view' AND event_id < buy GROUP BY user_id, buy)
SELECT user_id, buy, opened, coalesce((SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY event_id) FROM steps s WHERE s.user_id = o.user_id AND tool = 'click' AND event_id > opened AND event_id < buy), '') AS options FROM o""")
def anchored_reference(spark, d):
    return S.anchored(steps(spark, d), KEY, "event_id", F.col("tool") == "purchase", F.col("tool") == "view", F.col("tool") == "click", "k")


@query(f"""WITH {STEPS_SQL}, m AS (SELECT user_id, row_number() OVER {W} - 1 AS n, tool IN ('view', 'click') AS on_ FROM steps),
i AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS island FROM m WHERE on_)
SELECT user_id, CAST(min(n) AS INT) AS start, CAST(count(*) AS INT) AS length FROM i GROUP BY user_id, island""")
def mask_run_spans(spark, d):
    mask = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "tool"))), lambda x: x["tool"].isin("view", "click").cast("int"))
    return S.mask_spans(steps(spark, d).groupBy("user_id").agg(mask.alias("mask")), "user_id", "mask")


@query("""WITH x AS (SELECT conv_id, turn, length(text) AS t, sum(length(text)) OVER w AS s, count(*) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
SELECT conv_id, min(turn) AS first_turn, count(*) AS kept, CAST(sum(t) AS BIGINT) AS tokens FROM x WHERE s <= 1500 OR n = 1 GROUP BY conv_id""")
def context_suffix_budget(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("t"))
    return S.suffix_budget(turns, "conv_id", "turn", "t", 1500)


@query("""SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN left(text, 66) || '…' || right(text, 33) ELSE text END AS text FROM conversations""")
def head_tail_compaction(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.compacted(F.col("text"), 100).alias("text"))


# Splits.


def split_sql(ids: str, seed: int, ratio: float) -> str:
    return f"""i AS ({ids}), r AS (SELECT id, row_number() OVER (ORDER BY sha256('{seed}:' || id)) AS n, count(*) OVER () AS m FROM i)
SELECT id, CASE WHEN n <= least(greatest(1, CAST(round_even(m * {ratio}, 0) AS BIGINT)), m - 1) THEN 'validation' ELSE 'train' END AS split FROM r"""


@query("WITH " + split_sql("SELECT c_custkey AS id FROM customer", 3407, 0.1))
def hash_split_by_task(spark, d):
    return D.hash_split(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id", 3407, 0.1)


@query("""WITH s AS (SELECT o_orderpriority AS stratum, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT stratum, n * 1000 / (sum(n) OVER ()) AS share FROM s),
r AS (SELECT stratum, floor(share) AS f, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, stratum) AS k, 1000 - sum(floor(share)) OVER () AS rest FROM q),
p AS (SELECT stratum, f + CASE WHEN k <= rest THEN 1 ELSE 0 END AS quota FROM r),
x AS (SELECT o_orderkey, o_orderpriority AS stratum, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('42:' || o_orderkey)) AS n FROM orders)
SELECT stratum, o_orderkey FROM x JOIN p USING (stratum) WHERE n <= quota""")
def stratified_largest_remainder(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("stratum"), "o_orderkey")
    return D.stratified(rows, "stratum", "o_orderkey", 42, 1000).where("taken").select("stratum", "o_orderkey")


@query("""WITH known AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'validation' ELSE 'train' END AS split FROM customer WHERE c_custkey % 3 = 0),
i AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0), r AS (SELECT id, row_number() OVER (ORDER BY sha256('7:' || id)) AS n, count(*) OVER () AS m FROM i)
SELECT * FROM known UNION ALL SELECT id, CASE WHEN n <= least(greatest(1, CAST(round_even(m * 0.2, 0) AS BIGINT)), m - 1) THEN 'validation' ELSE 'train' END FROM r""")
def recovery_split(spark, d):
    """Ids that have a split keep it; the others are split by hash."""
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    known = ids.where("id % 3 = 0").withColumn("split", F.when(F.col("id") % 4 == 0, "validation").otherwise("train"))
    return known.unionByName(D.hash_split(ids.join(known, "id", "left_anti"), "id", 7, 0.2))


@query(f"""WITH {STEPS_SQL}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY sha256('11:row:' || event_id), event_id) AS task_rank FROM steps)
SELECT user_id, event_id, CAST(task_rank AS INT) AS task_rank FROM r WHERE task_rank <= 2 ORDER BY task_rank, sha256('11:task:' || user_id), user_id LIMIT 200""")
def round_robin_selection(spark, d):
    return D.round_robin(steps(spark, d), "user_id", "event_id", 11, 2, 200).select("user_id", "event_id", "task_rank")


def label_sql(name: str, n: int, where: str) -> str:
    return f"""(SELECT user_id, tool, event_id FROM (SELECT user_id, '{name}' AS tool, arg_min(event_id, sha256('5:' || event_id)) AS event_id FROM steps WHERE tool = '{name}' {where} GROUP BY user_id)
  ORDER BY sha256('5:{name}:' || user_id), user_id LIMIT {n})"""


@query(f"WITH {STEPS_SQL}, a AS {label_sql('signup', 40, '')}, b AS {label_sql('purchase', 40, 'AND user_id NOT IN (SELECT user_id FROM a)')} FROM a UNION ALL FROM b")
def label_quota_selection(spark, d):
    return D.label_quotas(steps(spark, d), "tool", "user_id", "event_id", 5, [("signup", 40), ("purchase", 40)])


@query("""WITH s AS (SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS name, o_custkey AS id FROM orders)
SELECT a.name AS set_a, b.name AS set_b, count(*) AS n FROM s a JOIN s b USING (id) WHERE a.name <= b.name GROUP BY 1, 2""")
def split_overlap_matrix(spark, d):
    sets = table(spark, d, "orders").select(F.year("o_orderdate").cast("string").alias("name"), F.col("o_custkey").alias("id"))
    return D.overlap(sets, "name", "id")


@query(f"""WITH {STEPS_SQL}, x AS (SELECT event_id, tool, count(*) FILTER (WHERE tool = 'purchase') OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM steps)
SELECT event_id, tool FROM x WHERE coalesce(n, 0) < 100""")
def accept_until_target(spark, d):
    return D.until_target(steps(spark, d).select("event_id", "tool"), "event_id", F.col("tool") == "purchase", 100)
