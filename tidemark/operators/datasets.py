"""Training rows from sessions: acceptance, sanitised messages, masks, and text of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .contracts import reasons

#: What a row needs in order to be accepted, as (reason, SQL condition of a rejection).
REJECTIONS = (
    ("has_error", "error IS NOT NULL"),
    ("release_error", "release_error IS NOT NULL"),
    ("status_not_done", "NOT (status <=> 'done')"),
    ("trajectory_not_done", "NOT (done <=> true)"),
    ("environment_not_done", "NOT (terminal_done <=> true)"),
    ("missing_buy", "NOT (has_buy <=> true)"),
    ("reward_v3_required", "NOT (reward_version <=> 'v3')"),
    ("reward_v3_not_gold_purchase", "NOT (reward_type <=> 'gold_purchase')"),
    ("reward_v3_invalid", "NOT (reward_valid <=> true)"),
    ("purchase_not_successful", "NOT (purchase_success <=> true)"),
    ("termination_not_gold_purchase", "NOT (termination_reason <=> 'gold_purchase')"),
)


def acceptance(rows: DataFrame, rejections: tuple[tuple[str, str], ...] = REJECTIONS) -> DataFrame:
    """``rows`` with every reason against them, in order, and whether they are accepted."""
    found = reasons(**{name: F.expr(condition) for name, condition in rejections})
    return rows.withColumn("reasons", found).withColumn("accepted", F.size("reasons") == 0)


def first_accepted(rows: DataFrame, task: str, order: str, accepted: str = "accepted") -> DataFrame:
    """``rows`` with the verdict accepted, rejected or duplicate_task: of a task the first accepted row counts."""
    n = F.sum(F.col(accepted).cast("int")).over(Window.partitionBy(task).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("verdict", F.when(~F.col(accepted), "rejected").when(n > 1, "duplicate_task").otherwise("accepted"))


def sanitised(messages: Column, allowed: tuple[str, ...], terminal: str) -> Column:
    """Messages (role, content, blocked) of the allowed roles that were not blocked; the last one's content is replaced."""
    kept = F.filter(messages, lambda m: m["role"].isin(*allowed) & ~m["blocked"])
    return F.transform(kept, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == F.size(kept) - 1, F.lit(terminal)).otherwise(m["content"]).alias("content")))


def label_mask(rows: DataFrame, key: str, order: str, role: str, text: str, most: int) -> DataFrame:
    """Per key the labels of white-space tokens, -100 but for the assistant's; too long ones are dropped, never cut."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    turn = F.struct(order, F.col(role).alias("role"), words.alias("words"))
    turns = rows.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    labels = F.flatten(F.transform("turns", lambda t: F.transform(t["words"], lambda w: F.when(t["role"] == "assistant", F.length(w)).otherwise(-100))))
    return turns.select(key, labels.alias("labels")).where(F.size("labels") <= most)


def with_drop_counts(rows: DataFrame, reason: Column) -> tuple[DataFrame, Observation]:
    """The rows without a ``reason`` to drop them, and what is known once they have been written: total, kept, dropped, and the dropped by reason.

    The counts come with the pass that writes the rows, there is no second one.
    """
    observed = Observation()
    kept = rows.withColumn("_reason", reason)
    counted = kept.observe(observed, F.count("*").alias("total"), F.count_if(F.col("_reason").isNull()).alias("kept"), F.count("_reason").alias("dropped"), F.array_sort(F.collect_set("_reason")).alias("reasons"))
    return counted.where("_reason IS NULL").drop("_reason"), observed


_BLOCKS = r"(?is)<(style|script|head|title)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<meta\b[^>]*>"


def visible_text(html: Column, separator: str = " [SEP] ") -> Column:
    """The texts between tags, without scripts, styles, heads and comments."""
    bare = F.regexp_replace(html, _BLOCKS, "\u0001")
    parts = F.split(F.regexp_replace(bare, r"(?s)<[^>]*>", "\u0001"), "\u0001")
    return F.array_join(F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != ""), separator)


def clickables(html: Column) -> Column:
    """Targets of links and texts of buttons, lower-cased, distinct, in the order of the page."""
    links = F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)
    buttons = F.regexp_extract_all(html, F.lit(r"(?i)<button[^>]*>([^<]*)</button>"), 1)
    return F.array_distinct(F.transform(F.concat(links, buttons), lambda x: F.lower(F.trim(x))))


def combined_digest(rows: DataFrame, path: str, digest: str) -> DataFrame:
    """SHA-256 over path, NUL, digest and newline of the rows in order of their paths: a list of files, short by nature."""
    lines = F.array_sort(F.collect_list(F.concat(F.col(path), F.lit("\u0000"), F.col(digest), F.lit("\n"))))
    return rows.agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"))
