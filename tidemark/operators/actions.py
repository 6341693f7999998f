"""Guards, outcomes and shapes of single actions: expressions over one row, first reason first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contracts import first_reason

#: Errors of the infrastructure.
INFRASTRUCTURE = ("ConnectionError", "TimeoutError", "HTTPError")


def guard(page: Column, tool: Column, target: Column, known: Column) -> Column:
    """Why an action is not legal on its page, or null; the first check that applies."""
    return first_reason(
        unknown_tool=~F.array_contains(known, tool),
        no_observation=page.isNull(),
        not_visible=(tool == "open") & ~page.contains(target),
        missing_target=(tool == "click") & (F.coalesce(target, F.lit("")) == ""),
    )


def extra_args(args: Column, allowed: Column) -> Column:
    """Names in ``args`` (a map) that the schema lacks, sorted."""
    return F.array_sort(F.array_except(F.map_keys(args), allowed))


def bounded_parameters(args: Column, keys: int = 8, chars: int = 256) -> Column:
    """The first keys of a map by name, their values cut."""
    entries = F.slice(F.array_sort(F.map_entries(args)), 1, keys)
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.left(e["value"], F.lit(chars)))))


#: Tools that click on what an argument names, and those that click on a button.
CLICKED_ARGUMENTS = {"open_product": "asin", "select_option": "value"}
CLICKED_BUTTONS = {
    "view_description": "Description",
    "view_features": "Features",
    "view_reviews": "Reviews",
    "view_attributes": "Attributes",
    "next_page": "Next >",
    "prev_page": "< Prev",
    "back_to_search": "Back to Search",
    "buy_now": "Buy Now",
}


def environment_action(tool: Column, args: Column) -> Column:
    """The environment's form of a call (``args`` is a map); null for a tool without one or a missing argument."""
    out = F.when(tool == "search_products", F.concat(F.lit("search["), args["query"], F.lit("]"))).when(tool == "finish_without_purchase", F.concat(F.lit("finish["), args["reason"], F.lit("]")))
    for name, key in CLICKED_ARGUMENTS.items():
        out = out.when(tool == name, F.concat(F.lit("click["), args[key], F.lit("]")))
    for name, button in CLICKED_BUTTONS.items():
        out = out.when(tool == name, F.lit(f"click[{button}]"))
    return out


def infrastructure_failure(release_error: Column, error_type: Column, message: Column) -> Column:
    found = release_error.isNotNull() | error_type.isin(*INFRASTRUCTURE) | F.coalesce(message, F.lit("")).contains("connection")
    return F.coalesce(found, F.lit(False))


def strict_success(*levels: Column) -> Column:
    """True at every level; anything unknown is no success."""
    out = F.lit(True)
    for c in levels:
        out = out & c.eqNullSafe(F.lit(True))
    return out


def serial(calls: Column) -> tuple[Column, Column]:
    """(the first call, those dropped)."""
    return F.slice(calls, 1, 1), F.when(F.size(calls) > 1, F.slice(calls, 2, 1_000_000)).otherwise(F.slice(calls, 1, 0))


def summary_line(tool: Column, fields: list[Column], rejected: Column, most: int = 120) -> Column:
    """One line for an action: its first filled field, cut, and why it was rejected."""
    value = F.coalesce(*(F.nullif(f, F.lit("")) for f in fields), F.lit(""))
    line = F.concat(tool, F.lit("["), value, F.lit("]"))
    line = F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most - 3)), F.lit("..."))).otherwise(line)
    return F.when(rejected.isNotNull(), F.concat(F.lit("REJECTED "), line, F.lit(" ["), rejected, F.lit("]"))).otherwise(line)


def price_ladder(price: Column, n: int) -> Column:
    """The next n multiples of ten above a price."""
    base = (F.floor(price / 10) + 1) * 10
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: base + 10 * i)


def previous_value(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The last known value before each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def aligned_trim(ends: Column, removal: Column) -> Column:
    """The smallest end of a complete group at or past what has to be removed, or null."""
    return F.array_min(F.filter(ends, lambda e: e >= removal))


def copied(rows: DataFrame, content: Column, key: str) -> DataFrame:
    """Contents that several keys share, by hash, with how many do."""
    return rows.groupBy(F.sha2(content, 256).alias("content")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def outcomes_of(attempts: DataFrame, outcomes: DataFrame, key: list[str]) -> DataFrame:
    """Attempts with what came of them; without an outcome they are open."""
    return attempts.join(outcomes, key, "left").withColumn("state", F.when(F.col("accepted").isNull(), "open").when(F.col("accepted"), "accepted").otherwise("rejected"))


def demonstration(rows: DataFrame, task: str, *order: Column) -> DataFrame:
    """Per task the smallest row by the given order."""
    names = [c for c in rows.columns if c != task]
    smallest = F.min_by(F.struct(*names), F.struct(*order))
    return rows.groupBy(task).agg(smallest.alias("_r")).select(task, "_r.*")
