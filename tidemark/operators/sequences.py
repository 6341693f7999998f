"""Windows over the ordered steps of a session. All take the session's key and its order, and shuffle once on the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(key: str, order: list[str]):
    return Window.partitionBy(key).orderBy(*order)


def event_ids(steps: DataFrame, key: str, order: list[str], guard: Column) -> DataFrame:
    """Ordinal ids of interleaved events: every event, every attempt and every executed step."""
    w = _w(key, order)
    executed = F.sum(F.when(guard, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.row_number().over(w)
    return steps.select(
        "*",
        F.format_string("e%04d", n).alias("event"),
        F.format_string("a%04d", n).alias("attempt"),
        F.when(guard, "").otherwise(F.format_string("s%04d", executed - 1)).alias("executed"),
        F.when(guard, "guard_rejection").otherwise("tool_step").alias("event_type"),
    )


def repeats(steps: DataFrame, key: str, order: list[str], signature: Column) -> DataFrame:
    """Per session: steps with a signature seen before, and those that equal their predecessor."""
    s = steps.withColumn("_s", signature)
    s = s.withColumn("_again", F.row_number().over(Window.partitionBy(key, "_s").orderBy(*order)) > 1).withColumn("_next", F.lag("_s").over(_w(key, order)) == F.col("_s"))
    return s.groupBy(key).agg(F.count_if("_again").alias("duplicates"), F.count_if("_next").alias("consecutive"))


def in_recent(steps: DataFrame, key: str, order: list[str], signature: Column, n: int = 3) -> DataFrame:
    """Steps whose signature is among the ``n`` before."""
    recent = F.collect_list(signature).over(_w(key, order).rowsBetween(-n, -1))
    return steps.withColumn("repeated", F.array_contains(recent, signature))


def keep_last(steps: DataFrame, key: str, order: list[str], n: int = 48) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return steps.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def run_lengths(steps: DataFrame, key: str, order: list[str], value: Column, name: str = "run") -> DataFrame:
    """The length so far of the run of equal values that a step is in."""
    w = _w(key, order)
    s = steps.withColumn("_v", value).withColumn("_change", F.when(F.lag("_v").over(w).eqNullSafe(F.col("_v")), 0).otherwise(1))
    s = s.withColumn("_island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.withColumn(name, F.row_number().over(Window.partitionBy(key, "_island").orderBy(*order))).drop("_v", "_change", "_island")


def streak(steps: DataFrame, key: str, order: list[str], progress: Column, name: str = "streak") -> DataFrame:
    """Steps since the last one with progress."""
    w = _w(key, order).rowsBetween(Window.unboundedPreceding, 0)
    s = steps.withColumn("_p", progress.cast("int")).withColumn("_island", F.sum("_p").over(w))
    own = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn(name, F.sum(1 - F.col("_p")).over(own)).drop("_p", "_island")


def first_seen(steps: DataFrame, key: str, order: list[str], evidence: list[str]) -> DataFrame:
    """Whether a step is the first of its session with this evidence."""
    return steps.withColumn("first", F.row_number().over(Window.partitionBy(key, *evidence).orderBy(*order)) == 1)


#: Evidence credited a session.
BUDGETS = {"product": 5, "subpage": 6, "result_set": 3}


def credited(steps: DataFrame, key: str, order: list[str], kind: str, evidence: str, budgets: dict[str, int] = BUDGETS) -> DataFrame:
    """Per session and kind of evidence: how much is new, and how much of it the budget credits."""
    first = first_seen(steps.where(F.col(kind).isNotNull()), key, order, [kind, evidence])
    found = first.groupBy(key, kind).agg(F.count_if("first").alias("found"))
    budget = F.element_at(F.create_map(*(F.lit(x) for kv in budgets.items() for x in kv)), F.col(kind))
    return found.withColumn("credited", F.least("found", budget.cast("bigint")))


def first_terminal(steps: DataFrame, key: str, order: list[str], signature: Column, progress: str, most_steps: int = 35) -> DataFrame:
    """The first step at which a session ends and why: a repeat, no progress, or too many steps, in this order."""
    s = run_lengths(steps, key, order, signature, "_run")
    s = streak(s, key, order, F.col(progress), "_streak").withColumn("step", F.row_number().over(_w(key, order)))
    reason = F.when(F.col("_run") >= 3, "repeat_loop").when(F.col("_streak") >= 4, "no_progress").when(F.col("step") >= most_steps, "max_steps")
    return s.where(reason.isNotNull()).groupBy(key).agg(F.min(F.struct("step", reason.alias("reason"))).alias("r")).select(key, "r.step", "r.reason")


def phases(steps: DataFrame, key: str, order: list[str], opens: Column, resets: Column, selects: Column) -> DataFrame:
    """Before each step: whether a candidate is open, and how many options have been selected since it was."""
    w = _w(key, order).rowsBetween(Window.unboundedPreceding, -1)
    s = steps.withColumn("_island", F.coalesce(F.sum((opens | resets).cast("int")).over(w), F.lit(0)))
    s = s.withColumn("open", F.coalesce(F.last(F.when(opens, True).when(resets, False), ignorenulls=True).over(w), F.lit(False)))
    own = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    options = F.coalesce(F.sum(selects.cast("int")).over(own), F.lit(0))
    return s.withColumn("options", F.when(F.col("open"), options).otherwise(0)).drop("_island")


def chain_check(rows: DataFrame, key: str, order: str, first: int, before: Column | None = None, after: Column | None = None) -> DataFrame:
    """Per key the first fault of an ordered ledger: sequence (a gap), chain (before is not the last after), else ok."""
    w = Window.partitionBy(key).orderBy(order)
    code = F.when(F.col(order) != F.row_number().over(w) + (first - 1), "sequence")
    if before is not None:
        code = code.when(F.lag(after).over(w) != before, "chain")
    return rows.withColumn("_code", code).groupBy(key).agg(F.coalesce(F.min_by("_code", F.when(F.col("_code").isNotNull(), F.col(order))), F.lit("ok")).alias("code"), F.count("*").alias("n"))


def anchored(steps: DataFrame, key: str, order: str, buys: Column, opens: Column, selects: Column, value: str) -> DataFrame:
    """Last purchase, last opening before it, and the selections between them."""
    s = steps.withColumn("_buy", F.max(F.when(buys, F.col(order))).over(Window.partitionBy(key)))
    s = s.withColumn("_open", F.max(F.when(opens & (F.col(order) < F.col("_buy")), F.col(order))).over(Window.partitionBy(key)))
    between = F.when(selects & (F.col(order) > F.col("_open")) & (F.col(order) < F.col("_buy")), F.struct(order, value))
    options = F.transform(F.array_sort(F.collect_list(between)), lambda x: x[value].cast("string"))
    return s.where("_open IS NOT NULL").groupBy(key).agg(F.first("_buy").alias("buy"), F.first("_open").alias("opened"), F.array_join(options, ",").alias("options"))


def mask_spans(rows: DataFrame, key: str, mask: str) -> DataFrame:
    """(start, length) of every run of ones in an array of zeros and ones, without leaving the row."""
    starts = F.filter(F.sequence(F.lit(0), F.size(mask) - 1), lambda i: (F.get(mask, i) == 1) & (F.coalesce(F.get(mask, i - 1), F.lit(0)) == 0))
    ends = F.filter(F.sequence(F.lit(1), F.size(mask)), lambda i: (F.get(mask, i - 1) == 1) & (F.coalesce(F.get(mask, i), F.lit(0)) == 0))
    spans = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    return rows.where(F.size(mask) > 0).select(key, F.explode(spans).alias("x")).select(key, F.col("x.s").alias("start"), (F.col("x.e") - F.col("x.s")).alias("length"))


def suffix_budget(turns: DataFrame, key: str, order: str, tokens: str, budget: int) -> DataFrame:
    """The longest suffix of whole turns within the budget; the latest turn always stays."""
    w = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    s = turns.withColumn("_sum", F.sum(tokens).over(w)).withColumn("_n", F.count("*").over(w))
    kept = s.where((F.col("_sum") <= budget) | (F.col("_n") == 1))
    return kept.groupBy(key).agg(F.min(order).alias("first_turn"), F.count("*").alias("kept"), F.sum(tokens).alias("tokens"))


def compacted(text: Column, most: int) -> Column:
    """Head and tail of a long text, two thirds of the room for the head, with an ellipsis between."""
    head = (most - 1) * 2 // 3
    tail = most - 1 - head
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit("…"), F.right(text, F.lit(tail)))).otherwise(text)
