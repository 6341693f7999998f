"""Tri-state comparisons of purchases with what was asked, prices of variants, and rewards.

A status is pass, fail or unverifiable; in a set of gates unverifiable beats fail, which beats pass.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.logic import bound
from ..functions.text import folded, folded_characters

PASS, FAIL, UNVERIFIABLE = "pass", "fail", "unverifiable"

#: Weights of the dimensions and rewards of the outcomes.
WEIGHTS = {"brand": 0.35, "model": 0.25, "core_functions": 0.25, "key_options": 0.15}
REWARDS = {
    "gold_purchase": 1.0,
    "valid_alternative_purchase": 0.55,
    "graceful_abstain": -0.15,
    "early_abstain": -0.35,
    "max_steps": -0.5,
    "repeat_loop": -0.65,
    "wrong_purchase": -0.85,
    "reward_unverifiable": 0.0,
}


def status(verifiable: Column, passed: Column) -> Column:
    return F.when(~F.coalesce(verifiable, F.lit(False)), UNVERIFIABLE).when(passed, PASS).otherwise(FAIL)


def comparison(state: Column, comparator: str, required: Column, actual: Column) -> Column:
    """The record of a comparison."""
    return F.struct(state.alias("status"), (state == PASS).alias("passed"), (state != UNVERIFIABLE).alias("verifiable"), F.lit(comparator).alias("comparator"), required.alias("required"), actual.alias("actual"))


def gates(*states: Column) -> Column:
    """The verdict of several gates."""
    some = [s == UNVERIFIABLE for s in states], [s == FAIL for s in states]
    unsure, bad = (_any(x) for x in some)
    return F.when(unsure, UNVERIFIABLE).when(bad, FAIL).otherwise(PASS)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def category_match(required: Column, actual: Column, separator: str = "›") -> Column:
    """Leaves are equal, and one side has no ancestors or they share one. Unverifiable if either is missing."""

    def path(c: Column) -> Column:
        return F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")

    r, a = path(required), path(actual)
    up_r, up_a = F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    known = required.isNotNull() & actual.isNotNull() & (F.size(r) > 0) & (F.size(a) > 0)
    same = (F.try_element_at(r, F.lit(-1)) == F.try_element_at(a, F.lit(-1))) & ((F.size(up_r) == 0) | (F.size(up_a) == 0) | F.arrays_overlap(up_r, up_a))
    return status(known, same)


def brand_match(required: Column, actual: Column) -> Column:
    """Any of the required brands (an array) is among the actual ones (an array)."""
    return status((F.size(F.coalesce(required, F.array())) > 0) & (F.size(F.coalesce(actual, F.array())) > 0), F.arrays_overlap(required, actual))


def price_gate(limit: Column, price: Column) -> Column:
    """No limit passes; a missing, negative or non-finite price can't be verified."""
    usable = price.isNotNull() & ~F.isnan(price) & (price >= 0) & (price < float("inf"))
    return F.when(limit.isNull(), PASS).otherwise(status(usable, price <= limit))


def holds_token(text: Column, token: Column) -> Column:
    """The token stands alone in the text: no ASCII letter or digit on either side."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), token, F.lit(r"\E(?![A-Za-z0-9])"))
    return F.regexp_like(text, quoted)


def model_match(required: Column, text: Column) -> Column:
    """All required models stand alone in the text."""
    return status((F.size(F.coalesce(required, F.array())) > 0) & text.isNotNull(), F.forall(required, lambda m: holds_token(text, m)))


#: What negates a function right after it.
NEGATORS = ("不支持", "不含", "不具备", "没有", "无", "非", "不")


def _plain(text: Column) -> Column:
    return F.regexp_replace(folded_characters(F.coalesce(text, F.lit(""))), r"(?U)\s+", "")


def polarity(text: Column, expected: Column) -> Column:
    """held if a text has an occurrence that isn't negated, negated if all are, absent if there is none; both in plain form."""
    negated = lambda x: _any([x.endswith(n) for n in NEGATORS])

    def of(parts: Column) -> Column:
        # What stands before an occurrence begins with the one before it.
        before = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(expected, x)))
        return F.when(F.exists(before, lambda x: ~negated(x)), "held").otherwise("negated")

    # Splitting compiles a pattern for each expected text: only where it occurs.
    return F.when(text.contains(expected), bound(F.split(text, F.concat(F.lit(r"\Q"), expected, F.lit(r"\E")), -1), of)).otherwise("absent")


def function_match(required: Column, structured: Column, fallback: Column) -> Column:
    """(status, matched: array of (value, source), missing, negated) of required functions, by a product's attributes and then by its texts (arrays).

    An attribute that holds a function decides, then one that negates it; only then the texts count. A function that is missing or negated fails. Without
    a required function, or without any attribute or text, nothing can be verified.
    """
    nothing = F.array().cast("array<string>")
    attributes, texts = F.coalesce(structured, nothing), F.coalesce(fallback, nothing)
    wanted = F.filter(F.transform(F.coalesce(required, nothing), lambda r: F.struct(r.alias("value"), _plain(r).alias("plain"))), lambda r: r["plain"] != "")
    own, text = F.transform(attributes, _plain), _plain(F.array_join(F.filter(texts, lambda t: t.isNotNull()), " "))
    kind = lambda j: F.when(F.array_contains(j["own"], "held"), "attribute").when(F.array_contains(j["own"], "negated"), "negated").when(j["text"] == "held", "text_fallback").when(j["text"] == "negated", "negated").otherwise("missing")

    def judged(own: Column, text: Column) -> Column:
        both = lambda r: F.struct(F.transform(own, lambda x: polarity(x, r["plain"])).alias("own"), polarity(text, r["plain"]).alias("text"))
        return F.transform(wanted, lambda r: F.struct(r["value"].alias("value"), bound(both(r), kind).alias("source")))

    def told(found: Column) -> Column:
        of = lambda name: F.transform(F.filter(found, lambda x: x["source"] == name), lambda x: x["value"])
        known = (F.size(found) > 0) & ((F.size(attributes) > 0) | F.exists(texts, lambda t: F.coalesce(t, F.lit("")) != ""))
        bad = F.exists(found, lambda x: x["source"].isin("missing", "negated"))
        kept = F.filter(found, lambda x: x["source"].isin("attribute", "text_fallback"))
        return F.struct(status(known, ~bad).alias("status"), kept.alias("matched"), of("missing").alias("missing"), of("negated").alias("negated"))

    return bound(bound(own, lambda own: bound(text, lambda text: judged(own, text))), told)


#: Units in the base of their dimension.
UNITS = {
    "ml": ("volume", 1.0),
    "毫升": ("volume", 1.0),
    "l": ("volume", 1000.0),
    "升": ("volume", 1000.0),
    "g": ("mass", 1.0),
    "克": ("mass", 1.0),
    "kg": ("mass", 1000.0),
    "千克": ("mass", 1000.0),
    "公斤": ("mass", 1000.0),
    "mm": ("length", 1.0),
    "毫米": ("length", 1.0),
    "cm": ("length", 10.0),
    "厘米": ("length", 10.0),
    "m": ("length", 1000.0),
    "米": ("length", 1000.0),
}
_UNIT = "|".join(sorted(map(re.escape, UNITS), key=len, reverse=True))


def _map(values: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def quantities(text: Column) -> Column:
    """(dimension, amount in base units) of every quantity in a text."""
    pattern = F.lit(rf"([0-9]+(?:\.[0-9]+)?)\s*({_UNIT})(?![a-z])")
    lower = folded(text)
    both = F.arrays_zip(F.regexp_extract_all(lower, pattern, 1).alias("n"), F.regexp_extract_all(lower, pattern, 2).alias("u"))
    dimension, factor = _map({u: d for u, (d, _) in UNITS.items()}), _map({u: f for u, (_, f) in UNITS.items()})
    return F.transform(both, lambda x: F.struct(F.element_at(dimension, x["u"]).alias("dimension"), (x["n"].cast("double") * F.element_at(factor, x["u"])).alias("amount")))


def spec_match(amount: Column, unit: Column, mode: Column, text: Column, tolerance: float = 1e-6) -> Column:
    """A quantity of the text in the unit's dimension is equal to, at least (min) or at most (max) the amount; none can't be verified."""
    dimension, factor = _map({u: d for u, (d, _) in UNITS.items()}), _map({u: f for u, (_, f) in UNITS.items()})
    key = F.lower(unit)
    wanted = amount * F.element_at(factor, key)
    found = F.filter(quantities(text), lambda q: q["dimension"] == F.element_at(dimension, key))
    room = wanted * tolerance
    good = F.exists(found, lambda q: F.when(mode == "min", q["amount"] >= wanted - room).when(mode == "max", q["amount"] <= wanted + room).otherwise(F.abs(q["amount"] - wanted) <= room))
    return status(F.size(found) > 0, good)


def match_score(scores: dict[str, Column], active: dict[str, Column]) -> Column:
    """Weighted mean of the scores of the active dimensions; one without any."""
    total = sum((F.when(active[d], F.lit(WEIGHTS[d])).otherwise(0.0) for d in scores), F.lit(0.0))
    weighted = sum((F.when(active[d], F.lit(WEIGHTS[d]) * s).otherwise(0.0) for d, s in scores.items()), F.lit(0.0))
    return F.when(total == 0, F.lit(1.0)).otherwise(weighted / total)


def partial_reward(score: Column) -> Column:
    return F.least(F.lit(0.25), F.lit(-0.30) + F.lit(0.55) * score)


def purchase(category: Column, budget: Column, all_preferences: Column, same_product: Column, score: Column) -> Column:
    """(reward_type, reward, reward_valid) of a purchase."""
    gate = gates(category, budget)
    kind = (
        F.when(gate == UNVERIFIABLE, "reward_unverifiable")
        .when(gate == FAIL, "wrong_purchase")
        .when(all_preferences & same_product, "gold_purchase")
        .when(all_preferences, "valid_alternative_purchase")
        .otherwise("partial_purchase")
    )
    reward = F.when(kind == "partial_purchase", partial_reward(score)).otherwise(F.element_at(_map(REWARDS), kind))
    return F.struct(kind.alias("reward_type"), reward.alias("reward"), (kind != "reward_unverifiable").alias("reward_valid"))


def eligible(category: Column, budget: Column, score: Column, coverage: Column) -> Column:
    return (gates(category, budget) == PASS) & (score >= 0.70) & (coverage >= 0.75)


def abstain(result_sets: Column, opened: Column, acceptable: Column) -> Column:
    """Giving up is graceful after two result sets and two opened products without an acceptable one."""
    return F.when((result_sets >= 2) & (opened >= 2) & (acceptable == 0), "graceful_abstain").otherwise("early_abstain")


def policy_reward(base: Column, guards: Column, repeats: Column) -> Column:
    cost = F.lit(0.03) * F.least(guards, F.lit(3)) + F.lit(0.02) * F.least(repeats, F.lit(3))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), base - cost))


def cheapest(values: Column) -> Column:
    """The value (price, name) with the lowest price; values without one come last, ties go by name."""
    return F.array_min(F.transform(values, lambda v: F.struct(v["price"].isNull().alias("missing"), v["price"].alias("price"), F.lower(F.trim(v["name"])).alias("name"))))


#: What a budget begins with, factors of its units, and the words that make it a limit.
BUDGET, PRICE, LIMITED = "预算(?:控制)?在?", "价格(?:控制)?在?", "不超过|不高于|最高"
FACTORS = {"万": 10_000.0, "千": 1_000.0, "k": 1_000.0}
WITHIN, ABOUT, BETWEEN = "以内|以下|内", "左右", "[-~～至到]"


def budget(text: Column) -> Column:
    """The upper limit that a request states, or null. The first form that fits decides; a range counts by its upper end, "about" adds a tenth."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), ",", "")
    number, unit = r"(\d+(?:\.\d+)?)", "(万|千|[kK])?"
    none = F.lit(None).cast("double")

    def group(pattern: str, k: int) -> Column:
        return F.nullif(F.regexp_extract(s, pattern, k), F.lit(""))

    def scaled(pattern: str, k: int) -> Column:
        return group(pattern, k).cast("double") * F.coalesce(F.element_at(_map(FACTORS), F.lower(F.coalesce(group(pattern, k + 1), F.lit("")))), F.lit(1.0))

    def about(pattern: str, k: int) -> Column:
        return F.when(group(pattern, k) == ABOUT, 1.1).otherwise(1.0)

    mixed = rf"{BUDGET}\s*(\d+)\s*万\s*(\d+)\s*千?\s*({WITHIN}|{ABOUT})?"
    span = rf"(?:{BUDGET}|{PRICE})\s*{number}\s*{unit}\s*元?\s*{BETWEEN}\s*{number}\s*{unit}"
    open_ended = rf"(?:{BUDGET}|{PRICE})\s*{number}\s*[kK]\s*\+"
    qualified = rf"\s*{number}\s*{unit}\s*元?({WITHIN}|{ABOUT})?(?!\s*[-~～至到+kK])"
    forms = [BUDGET + qualified, PRICE + qualified, rf"(?:{LIMITED})\s*{number}\s*(万|千)?\s*元", rf"{number}\s*(万|千)?\s*元(?:以内|以下)"]
    single = [F.when(s.rlike(p), scaled(p, 1) * (about(p, 3) if k < 2 else F.lit(1.0))) for k, p in enumerate(forms)]
    low, high = scaled(span, 1), scaled(span, 3)
    return F.round(
        F.when(s.rlike(mixed), (group(mixed, 1).cast("double") * 10_000 + group(mixed, 2).cast("double") * 1_000) * about(mixed, 3))
        .when(s.rlike(span) & (low > 0) & (high >= low), high)
        .when(s.rlike(open_ended), none)
        .otherwise(F.coalesce(*(F.when(x > 0, x) for x in single), none)),
        6,
    )


#: Outcomes that count as a purchase.
PURCHASES = ("gold_purchase", "valid_alternative_purchase")


def derived(reward_type: Column, reward_valid: Column, coverage: Column, dimensions: Column) -> Column:
    """(purchase_success, sampling_invalid, evidence_coverage, dimension_scores): fields that follow from an outcome; what is missing counts as zero."""
    scores = F.transform_values(F.coalesce(dimensions, F.create_map().cast("map<string,double>")), lambda _, s: F.coalesce(s, F.lit(0.0)))
    return F.struct(
        F.coalesce(reward_type.isin(*PURCHASES), F.lit(False)).alias("purchase_success"), (~F.coalesce(reward_valid, F.lit(False))).alias("sampling_invalid"),
        F.coalesce(coverage, F.lit(0.0)).alias("evidence_coverage"), scores.alias("dimension_scores"),
    )


def price_resolution(price: Column) -> Column:
    """(status, price) of a price that was stated: a finite one of zero or more passes, any other can't be verified."""
    p = price.cast("double")
    usable = p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p < float("inf"))
    return F.struct(status(usable, F.lit(True)).alias("status"), F.when(usable, p).alias("price"))
