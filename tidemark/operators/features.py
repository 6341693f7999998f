"""What a task asks for, from its instruction and the product it was written for: brands, models, functions, options.

A brand is looked up in a table of aliases of any size. An instruction's runs of up to four characters are joined with the beginnings of the
aliases, so that only aliases that begin in the text are compared with it; the table is broadcast where its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logic import bound
from ..functions.sizes import small, written
from ..functions.text import collapsed, folded_characters
from . import variants
from .scoring import status

#: Versions, ends of a shop's name, in the order in which they are tried, where a feature comes from, and the pattern of a model.
FEATURE_VERSION, OPTION_VERSION, CONTRACT_VERSION = "shopping-reward-features-v1", "option-axis-v1", "shopping-task-constraints-v1"
SHOP_ENDS = ("官方旗舰店", "旗舰店", "专卖店", "专营店", "企业店", "店")
SOURCES = {
    "category": "task.target_product.category",
    "brand": "instruction_explicit_alias",
    "model": "instruction_target_token_intersection",
    "core_functions": "instruction.attributes",
    "options": "instruction.instruction_options",
}
MODEL = r"(?i)((?<![a-z0-9])(?=[a-z0-9._+-]{2,24}(?![a-z0-9]))(?=[a-z0-9._+-]*[0-9])[a-z0-9._+-]+)"

#: Characters of an alias by which it is looked up, and the fewest it may have.
GRAM, SHORTEST = 4, 2
#: Characters of a shop's name that can be a brand, at most.
LONGEST_SHOP = 12


def normal(text: Column) -> Column:
    """Folded, without white space; a null is an empty text."""
    return F.regexp_replace(folded_characters(F.coalesce(text, F.lit(""))), r"(?U)\s+", "")


def grams(text: Column, lengths: list[int]) -> Column:
    """Distinct runs of so many characters, each found in one pass: substring() would begin at the text's beginning for each. No run begins within a surrogate pair."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{{k}}}))"), 1) for k in lengths))))


def alias_table(canonical: DataFrame) -> DataFrame:
    """(alias, canonical) in normal form from rows (canonical, aliases: array); a name is an alias of itself. Of several the smallest canonical name counts."""
    each = canonical.select(normal(F.col("canonical")).alias("canonical"), F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    return each.select(normal(F.col("alias")).alias("alias"), "canonical").where("alias <> ''").groupBy("alias").agg(F.min("canonical").alias("canonical"))


def canonical_brands(rows: DataFrame, aliases: DataFrame, brand: str, name: str) -> DataFrame:
    """``rows`` with the canonical name of a brand as a column: that of its alias, else its own normal form; null for a null."""
    known = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    found = rows.withColumn("_alias", F.when(F.col(brand).isNotNull(), normal(F.col(brand)))).join(small(known), "_alias", "left")
    return found.withColumn(name, F.coalesce("_canonical", "_alias")).select(*rows.columns, name)


def brand_comparison(required: Column, actual: Column) -> Column:
    """pass if the actual brand is one of the required ones (an array), all canonical; unverifiable if either is missing or empty."""
    wanted = F.filter(F.coalesce(required, F.array().cast("array<string>")), lambda r: F.coalesce(r, F.lit("")) != "")
    return status((F.size(wanted) > 0) & (F.coalesce(actual, F.lit("")) != ""), F.array_contains(wanted, actual))


def shop_brand(instruction: Column, title: Column, shop: Column) -> Column:
    """The longest beginning of a shop's name, without its end, that both the instruction and the title hold; null if there is none."""
    name = shop
    bare = F.lit(None).cast("string")
    for end in reversed(SHOP_ENDS):
        bare = F.when(name.endswith(end), F.left(name, F.length(name) - len(end))).otherwise(bare)
    bare = F.coalesce(bare, name)
    n = F.least(F.length(bare), F.lit(LONGEST_SHOP))
    lengths = F.when(n >= SHORTEST, F.sequence(n, F.lit(SHORTEST), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    beginnings = F.transform(lengths, lambda k: F.left(bare, k))
    return F.get(F.filter(beginnings, lambda b: instruction.contains(b) & title.contains(b)), 0)


def explicit_brands(tasks: DataFrame, aliases: DataFrame, key: str, instruction: str = "instruction", title: str = "title", shop: str = "shop_name") -> DataFrame:
    """(key, expected_brand: sorted array): canonical names of the aliases that both an instruction and its product name, and the shop's brand.

    ``aliases`` is an ``alias_table``. ``key`` is unique; nulls are empty texts.
    """
    texts = written(tasks.select(key, normal(F.col(instruction)).alias("_said"), normal(F.col(title)).alias("_title"), normal(F.col(shop)).alias("_shop")))
    named = written(aliases.where(F.length("alias") >= SHORTEST).select("alias", "canonical", F.left("alias", F.lit(GRAM)).alias("_gram")))
    # Three numbers at most: the lengths of the beginnings.
    lengths = sorted(r.n for r in named.select(F.length("_gram").alias("n")).distinct().collect())
    nothing = F.array().cast("array<string>")
    begins = texts.select(key, "_said", F.concat("_title", "_shop").alias("_target"), F.explode(grams(F.col("_said"), lengths) if lengths else nothing).alias("_gram"))
    found = begins.join(small(named), "_gram").where(F.col("_said").contains(F.col("alias")) & F.col("_target").contains(F.col("alias")))
    found = found.groupBy(key).agg(F.collect_set("canonical").alias("_named"))
    own = texts.select(key, F.array_compact(F.array(shop_brand(F.col("_said"), F.col("_title"), F.col("_shop")))).alias("_own"))
    every = F.array_union(F.coalesce("_named", nothing), F.col("_own"))
    return own.join(found, key, "left").select(key, F.array_sort(every).alias("expected_brand"))


def explicit_models(instruction: Column, *target: Column) -> Column:
    """Model names, letters and digits with at least one digit, that an instruction and its product share; sorted."""
    tokens = lambda text: F.transform(F.regexp_extract_all(text, F.lit(MODEL), 1), F.lower)
    text = F.concat_ws(" ", *(F.nullif(t, F.lit("")) for t in target))
    return F.array_sort(F.array_intersect(tokens(F.coalesce(instruction, F.lit(""))), tokens(text)))


def cleaned(values: Column) -> Column:
    """Texts without superfluous white space, each once, in their order; empty for a null."""
    texts = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: collapsed(F.coalesce(v, F.lit(""))))
    return F.array_distinct(F.filter(texts, lambda t: t != ""))


def compiled(tasks: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """(key, features): what a purchase is scored by, for tasks (instruction, attributes, instruction_options, category, title, shop_name,
    full_description, options).

    ``options`` are a product's, as in ``variants``. Wanted options that no single axis lists are given with the reason.
    """
    tasks = tasks.withColumn("_axes", variants.indexed(F.col("options"))).withColumn("_wanted", cleaned(F.col("instruction_options")))
    axes = F.col("_axes")
    tasks, resolved = tasks.withColumn("_resolved", variants.resolve(axes, F.col("_wanted"))), F.col("_resolved")
    lists = lambda a, key: F.exists(a["values"], lambda v: v["key"] == key)
    source = lambda r: bound(variants.option_text(r["value"]), lambda key: F.get(F.filter(axes, lambda a: lists(a, key)), 0)["source"])
    required = F.transform(F.filter(resolved, lambda r: r["reason"].isNull()), lambda r: F.struct(r["axis"].alias("axis"), r["value"].alias("value"), source(r).alias("source_axis"), F.lit(SOURCES["options"]).alias("source")))
    unresolved = F.transform(F.filter(resolved, lambda r: r["reason"].isNotNull()), lambda r: F.struct(r["value"].alias("value"), r["reason"].alias("reason")))
    features = F.struct(
        F.lit(FEATURE_VERSION).alias("reward_feature_version"),
        F.col("category").alias("category"),
        F.col("expected_brand").alias("expected_brand"),
        explicit_models(F.col("instruction"), F.col("title"), F.col("full_description")).alias("expected_model"),
        cleaned(F.col("attributes")).alias("expected_core_functions"),
        required.alias("required_options"),
        unresolved.alias("unresolved_option_requirements"),
        F.lit(OPTION_VERSION).alias("option_axis_version"),
        F.struct(*(F.lit(v).alias(k) for k, v in SOURCES.items())).alias("feature_sources"),
    )
    return tasks.join(explicit_brands(tasks, aliases, key), key).select(key, features.alias("features"))


def constraint_contract(instruction: Column, attributes: Column, options: Column) -> Column:
    """The constraints that a task's annotations state, and whether they are complete: an instruction that isn't blank and both lists."""
    complete = (normal(instruction) != "") & attributes.isNotNull() & options.isNotNull()
    nothing = F.array().cast("array<string>")
    hard = F.struct(
        complete.alias("complete"),
        F.lit(CONTRACT_VERSION).alias("contract_version"),
        F.lit(SOURCES["core_functions"]).alias("annotation_source"),
        cleaned(attributes).alias("core_functions"),
        nothing.alias("brand"),
        nothing.alias("model"),
        nothing.alias("key_specs"),
        F.size(cleaned(options)).alias("annotated_option_count"),
    )
    return F.struct(hard.alias("hard_constraints"), nothing.alias("weighted_preferences"))
