"""Spans of turns and hidden fields, over conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hidden
from ..operators import turn_spans as T
from .registry import query
from .tables import table

# A conversation's turns from the first of the assistant on are a session: the assistant's turns are generated, the others observed, and a turn has
# as many tokens as words, and one more.


@query(
    r"""WITH said AS (
  SELECT conv_id, turn, role = 'assistant' AS own, 1 + len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+')) AS n, min(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS first FROM conversations),
s AS (
  SELECT conv_id, turn, own, n, CAST(sum(n) OVER w AS BIGINT) - n AS low, lag(own) OVER w AS before, turn = max(turn) OVER (PARTITION BY conv_id) AS final, CAST(sum(n) OVER (PARTITION BY conv_id) AS BIGINT) AS size
  FROM said WHERE turn >= first WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, coalesce(lead(low) OVER (PARTITION BY conv_id ORDER BY turn), size) AS until FROM s WHERE own),
c AS (
  SELECT conv_id, any_value(size) AS size, bool_or(coalesce(before, false)) AS merged, count(*) AS turns, list({'start': low, 'end': low + n, 'until': until} ORDER BY turn) AS spans FROM a GROUP BY conv_id),
r AS (SELECT *, CASE WHEN NOT merged THEN coalesce(list_max(list_filter(list_transform(spans, lambda x: x.until), lambda e: e <= size * 2 // 5)), 0) END AS removed FROM c),
k AS (SELECT *, (size - removed) * 9 // 10 AS kept, list_transform(list_filter(spans, lambda x: x."end" > removed AND x.start - removed < (size - removed) * 9 // 10), lambda x: {'start': x.start - removed, 'end': x."end" - removed, 'until': x.until - removed}) AS moved FROM r)
SELECT conv_id, turns, CASE WHEN merged THEN 'turns_and_runs_differ' END AS fault, removed,
       CASE WHEN NOT merged THEN array_to_string(list_transform(moved, lambda x: x.start || '-' || least(x."end", kept) || '-' || least(x.until, kept) || CASE WHEN x."end" > kept THEN '!' ELSE '' END), ';') END AS spans
FROM k"""
)
def turn_span_algebra(spark, d):
    """The spans of each conversation's turns, after whole groups from the front and a tenth of the rest have gone."""
    size = (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x09-\x0D\x20]+")) + 1).cast("int")
    said = table(spark, d, "conversations").select("conv_id", F.struct("turn", (F.col("role") == "assistant").alias("own"), size.alias("n")).alias("s"))
    rows = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("all"))
    rows = rows.withColumn("all", F.filter("all", lambda s, i: s["turn"] >= F.get(F.filter("all", lambda x: x["own"]), 0)["turn"])).where(F.size("all") > 0)
    final = F.element_at("all", -1)["turn"]
    own = F.transform(F.filter("all", lambda s: s["own"]), lambda s: F.struct(s["turn"].cast("int").alias("turn_id"), F.when(s["turn"] == final, T.FINAL).otherwise(T.CALL).alias("kind"), s["n"].alias("generated_token_count"), (s["turn"] != final).alias("credit_eligible")))
    mask = F.flatten(F.transform("all", lambda s: F.array_repeat(s["own"].cast("int"), s["n"])))
    rows = rows.select("conv_id", own.alias("turns"), mask.alias("mask")).withColumn("runs", T.runs(F.col("mask")))
    rows = rows.withColumn("m", T.materialised(F.col("turns"), F.col("mask"), F.col("runs")))
    fine = F.col("m.fault").isNull()
    rows = rows.withColumn("removed", F.when(fine, T.removable(F.col("m.spans"), F.floor(F.size("mask") * 2 / 5))).cast("int"))
    rows = rows.withColumn("r", T.rebased(F.col("m.spans"), F.col("removed")))
    left = F.size("mask") - F.col("removed")
    rows = rows.withColumn("mask", F.slice("mask", F.col("removed") + 1, F.floor(left * 9 / 10).cast("int"))).withColumn("runs", T.runs(F.col("mask")))
    rows = rows.withColumn("f", T.finalised(F.col("r.spans"), F.col("mask"), F.col("runs")))
    cut = F.exists("f.spans", lambda s: s["end"] > F.size("mask"))
    text = F.array_join(F.transform("f.spans", lambda s: F.concat(F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"), s["observation_end"].cast("string")), F.when(s["truncated"], "!").otherwise(""))), ";")
    return rows.select("conv_id", F.size("turns").cast("long").alias("turns"), F.coalesce("m.fault", F.col("r.fault"), F.col("f.fault"), F.when(cut, "cut")).alias("fault"), F.col("removed").cast("long").alias("removed"), F.when(fine, text).alias("spans"))


@query(
    """WITH line AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity) - 1 AS i, CASE l_returnflag WHEN 'R' THEN 'Goal' WHEN 'A' THEN 'note' ELSE 'item' END AS k, l_linenumber % 3 = 0 AS deep FROM lineitem)
SELECT l_orderkey, '$.lines[' || i || '].' || k AS path FROM line WHERE k = 'Goal' UNION ALL SELECT l_orderkey, '$.lines[' || i || '].' || k || '.TARGET_asin' FROM line WHERE deep"""
)
def hidden_field_paths(spark, d):
    """Where an order, as JSON with keys that depend on its lines, holds a field that tells a goal."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_returnflag").alias("f"), "l_quantity").alias("l"))
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l")).alias("l"))
    name = lambda x: F.when(x["f"] == "R", "Goal").when(x["f"] == "A", "note").otherwise("item")
    inner = lambda x: F.create_map(F.when(x["l_linenumber"] % 3 == 0, "TARGET_asin").otherwise("size"), F.array(x["l_quantity"]))
    return hidden.forbidden_paths(orders, "l_orderkey", F.to_json(F.struct(F.transform("l", lambda x: F.create_map(name(x), inner(x))).alias("lines"))))
