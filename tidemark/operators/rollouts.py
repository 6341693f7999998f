"""Rollouts and their records: views that hide outcomes, options of variants, plans of branches, audits of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contracts import first_reason

#: Fields that tell an outcome.
OUTCOMES = ("reward", "utility", "success", "done", "termination_reason")


def outcome_blind(rows: DataFrame, outcomes: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """``rows`` with every outcome set to null: a selection that uses one fails or finds nothing."""
    return rows.select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name in outcomes else f.name for f in rows.schema.fields))


def hidden_fields(rows: DataFrame, forbidden: tuple[str, ...], suffixes: tuple[str, ...] = ()) -> list[str]:
    """Paths of fields, nested ones included, with a forbidden name or suffix; read from the schema, before anything runs."""
    out: list[str] = []

    def walk(kind, path: str) -> None:
        name = kind.typeName()
        if name == "struct":
            for f in kind.fields:
                here = f"{path}.{f.name}" if path else f.name
                if f.name in forbidden or f.name.lower().endswith(suffixes or ("\0",)):
                    out.append(here)
                walk(f.dataType, here)
        elif name == "array":
            walk(kind.elementType, path + "[]")
        elif name == "map":
            walk(kind.valueType, path + "{}")

    walk(rows.schema, "")
    return out


#: Names of fields that hold a secret, and the ending that makes any name one.
SECRETS, SECRET_ENDING = ("api_key", "apikey", "authorization", "bearer_token", "access_token", "client_secret", "secret", "password"), "_api_key"


def secret_keys(keys: Column) -> Column:
    """Those of an array of names that stand for a secret, case and dashes aside."""
    return F.filter(keys, lambda k: F.replace(F.lower(k), F.lit("-"), F.lit("_")).isin(*SECRETS) | F.endswith(F.replace(F.lower(k), F.lit("-"), F.lit("_")), F.lit(SECRET_ENDING)))


def reject_secrets(rows: DataFrame, *maps: str) -> DataFrame:
    """``rows``, unless a field's name stands for a secret (an error before anything runs) or a key of one of the map columns does (an error at that row)."""
    named: list[str] = []

    def walk(kind, path: str) -> None:
        if kind.typeName() == "struct":
            for f in kind.fields:
                plain = f.name.lower().replace("-", "_")
                if plain in SECRETS or plain.endswith(SECRET_ENDING):
                    named.append(f"{path}{f.name}")
                walk(f.dataType, f"{path}{f.name}.")
        elif kind.typeName() in ("array", "map"):
            walk(getattr(kind, "elementType", None) or kind.valueType, path)

    walk(rows.schema, "")
    if named:
        raise ValueError(f"forbidden secret fields: {named}")
    for m in maps:
        bad = F.coalesce(F.size(secret_keys(F.map_keys(m))) > 0, F.lit(False))
        rows = rows.withColumn(m, F.when(bad, F.raise_error(F.lit(f"{m} has a forbidden secret field"))).otherwise(F.col(m)))
    return rows


def step_validity(tool: Column, allowed: Column, arguments: Column, action: Column, expected: Column) -> Column:
    """Why a step is unsound, or null: its tool, its arguments' JSON, or an action that does not follow from them."""
    return first_reason(
        unknown_tool=~F.array_contains(allowed, tool),
        arguments_missing=arguments.isNull(),
        arguments_not_json=F.get_json_object(arguments, "$").isNull(),
        action_mismatch=~action.eqNullSafe(expected),
    )


def recovered_query(instruction: Column, first_user: Column) -> Column:
    """The instruction, else the first user message without its heading."""
    own = F.regexp_replace(first_user, r"(?i)^\s*Instruction:\s*", "")
    return F.coalesce(F.nullif(F.trim(instruction), F.lit("")), F.nullif(F.trim(own), F.lit("")), F.lit(""))


def cleaned_list(values: Column) -> Column:
    """Texts with white space collapsed, blank ones dropped, the first of equal ones kept; no list is an empty one."""
    found = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(F.regexp_replace(v, r"(?U)\s+", " ")))
    return F.array_distinct(F.filter(found, lambda v: v.isNotNull() & (v != "")))


def token_values(values: Column) -> Column:
    """Finite values of zero or more, as whole numbers."""
    return F.transform(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))), lambda v: v.cast("bigint"))


def remaining_budget(response: Column, context: Column, prompt_now: Column, prompt_first: Column) -> Column:
    return F.least(response, context - prompt_now, prompt_first + response - prompt_now)


def axis_collisions(options: DataFrame, product: str, axis: str, canonical: Column) -> DataFrame:
    """Per product the canonical axes that several of its axes stand for."""
    each = options.select(product, axis, canonical.alias("canonical")).distinct()
    return each.groupBy(product, "canonical").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(axis)), ",").alias("axes")).where("n > 1")


def required_options(required: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Per key the verdict on required (axis, value) against selected ones: a missing axis can't be verified and outweighs a wrong value."""
    both = required.join(selected.withColumnRenamed("value", "chosen"), [key, "axis"], "left")
    severity = F.when(F.col("chosen").isNull(), 2).when(F.col("chosen") != F.col("value"), 1).otherwise(0)
    worst = both.groupBy(key).agg(F.max(severity).alias("s"), F.count("*").alias("n"))
    return worst.select(key, "n", F.when(F.col("s") == 2, "unverifiable").when(F.col("s") == 1, "fail").otherwise("pass").alias("status"))


def branch_plan(states: DataFrame, state: str, k: int, seed: int) -> DataFrame:
    """k branches of each state, each with its identity."""
    rows = states.select(state).distinct().withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.withColumn("uid", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(state).cast("string"), F.col("branch").cast("string")), 256))


def suffix_groups(rows: DataFrame, group: str, index: str, action: str, success: Column) -> DataFrame:
    """Per group: size, whether its indices run from 0 without gaps or repeats, mixed outcomes, divergent actions."""
    return rows.groupBy(group).agg(
        F.count("*").alias("n"),
        ((F.min(index) == 0) & (F.max(index) == F.count("*") - 1) & (F.count_distinct(index) == F.count("*"))).alias("contiguous"),
        (F.some(success) & ~F.every(success)).alias("mixed"),
        (F.count_distinct(action) > 1).alias("divergent"),
    )


def exclusion_audit(rows: DataFrame, key: str, excluded: Column, buckets: int = 16) -> DataFrame:
    """Counts of eligible and excluded keys and a hash over the sorted keys, by bucket: a partition is told by few rows, each over a part."""
    bucket = F.pmod(F.col(key), F.lit(buckets)).alias("bucket")
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(excluded, F.col(key)))).cast("array<string>"), ","), 256)
    return rows.groupBy(bucket).agg(F.count_if(~excluded).alias("eligible"), F.count_if(excluded).alias("excluded"), digest.alias("digest"))


def located(selection: DataFrame, source: DataFrame, locator: list[str]) -> DataFrame:
    """Selected rows with what they point at; ``fault`` where they point at nothing or at several rows."""
    n = source.groupBy(*locator).agg(F.count("*").alias("n"))
    return selection.join(n, locator, "left").withColumn("fault", F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous"))


def spans_of(events: DataFrame, spans: DataFrame, key: str, at: str) -> DataFrame:
    """Events with the span (start, end) of their key that holds them; an event has to be in one span exactly.

    The spans of a key are collected with its row, so that an event meets its own key's spans only.
    """
    lists = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_s"))
    found = F.filter("_s", lambda s: (s["start"] <= F.col(at)) & (F.col(at) < s["end"]))
    joined = events.join(lists, key, "left").withColumn("_f", found)
    return joined.withColumn("span_start", F.when(F.size("_f") == 1, F.get("_f", F.lit(0))["start"])).drop("_s", "_f")


def cluster_deltas(deltas: DataFrame, task: str, delta: str, consistent: str) -> DataFrame:
    """Per task its mean delta, the share of consistent states and its weight."""
    return deltas.groupBy(task).agg(F.round(F.avg(delta), 6).alias("mean_delta"), F.round(F.avg(F.col(consistent).cast("double")), 6).alias("consistency"), F.count("*").alias("weight"))


def last_call(steps: DataFrame, key: str, order: str, done: Column) -> DataFrame:
    """The last step of each key that is done."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return steps.where(done).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
