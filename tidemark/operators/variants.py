"""Options of a product, by canonical axis: what a task requires, what was selected, which variant that is and what it costs.

A product's ``options`` are an array of (axis, values: array of (value, price)), in the product's order; a selection or a requirement
is an array of (axis, value). All of it stays within the product's row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.logic import bound
from ..functions.text import folded_characters
from .scoring import FAIL, PASS, UNVERIFIABLE

#: Names of axes that mean the same.
AXIS_ALIASES = {
    "color": ("颜色", "颜色分类"),
    "size": ("尺码", "鞋码"),
    "dimensions": ("尺寸", "大小"),
    "net_content": ("净含量", "总净含量"),
    "flavor": ("口味", "食品口味"),
    "specification": ("规格", "规格描述", "规格类型"),
    "bundle": ("套餐", "套餐类型", "组合套餐"),
    "capacity": ("容量", "规格容量"),
}


def option_text(value: Column) -> Column:
    """An option's text folded, without white space, with | for /."""
    return F.replace(F.regexp_replace(folded_characters(F.coalesce(value, F.lit(""))), r"(?U)\s+", ""), F.lit("/"), F.lit("|"))


def canonical_axis(axis: Column) -> Column:
    """The canonical name of an axis; its own text if it has no other."""
    names = F.create_map(*(F.lit(x) for canonical, aliases in AXIS_ALIASES.items() for alias in aliases for x in (alias, canonical)))
    return bound(option_text(axis), lambda text: F.coalesce(F.try_element_at(names, text), text))


def finite_price(price: Column) -> Column:
    p = price.cast("double")
    return F.when(p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p < float("inf")), p)


def indexed(options: Column) -> Column:
    """Array of (canonical, source, values: array of (key, value, price)); of values with the same text the last one counts, empty ones are dropped."""

    def values(o: Column) -> Column:
        placed = F.transform(o["values"], lambda v, i: F.struct(option_text(v["value"]).alias("key"), i.alias("at"), v["value"].alias("value"), finite_price(v["price"]).alias("price")))
        # Sorted by text and place, the last of a text is the one before another text.
        last = bound(F.sort_array(F.filter(placed, lambda v: v["key"] != "")), lambda s: F.filter(s, lambda v, i: F.coalesce(F.get(s, i + 1)["key"] != v["key"], F.lit(True))))
        ordered = F.sort_array(F.transform(last, lambda v: F.struct(v["at"].alias("at"), v["key"].alias("key"), v["value"].alias("value"), v["price"].alias("price"))))
        return F.transform(ordered, lambda v: F.struct(v["key"].alias("key"), v["value"].alias("value"), v["price"].alias("price")))

    return F.transform(options, lambda o: F.struct(canonical_axis(o["axis"]).alias("canonical"), o["axis"].alias("source"), values(o).alias("values")))


def colliding(axes: Column) -> Column:
    """Canonical axes, of an ``indexed`` product or of a selection with ``canonical``, that come more than once."""
    names = F.transform(axes, lambda a: a["canonical"])
    return bound(F.sort_array(names), lambda s: bound(F.filter(s, lambda n, i: n == F.get(s, i + 1)), lambda again: F.array_distinct(F.filter(names, lambda n: F.array_contains(again, n)))))


def _without(axes: Column, bad: Column) -> Column:
    return F.filter(axes, lambda a: ~F.array_contains(bad, a["canonical"]))


def unambiguous(axes: Column) -> Column:
    """The axes of an ``indexed`` product that don't collide."""
    return bound(axes, lambda axes: bound(colliding(axes), lambda bad: _without(axes, bad)))


def canonical_selection(selected: Column) -> Column:
    """(selected: array of (canonical, source, value), errors: axes that were selected before); of several the first counts."""
    named = F.transform(selected, lambda s: F.struct(canonical_axis(s["axis"]).alias("canonical"), s["axis"].alias("source"), s["value"].alias("value")))

    def of(named: Column) -> Column:
        before = lambda s, i: F.exists(F.slice(named, 1, i), lambda t: t["canonical"] == s["canonical"])
        first, again = F.filter(named, lambda s, i: ~before(s, i)), F.filter(named, before)
        return F.struct(first.alias("selected"), F.transform(again, lambda s: s["canonical"]).alias("errors"))

    return bound(named, of)


def _axis(axes: Column, name: Column) -> Column:
    return F.get(F.filter(axes, lambda a: a["canonical"] == name), F.lit(0))


def _value(axis: Column, text: Column) -> Column:
    return bound(option_text(text), lambda key: F.get(F.filter(axis["values"], lambda v: v["key"] == key), F.lit(0)))


def matching(axes: Column, required: Column) -> Column:
    """(status, reason, axis, selected: array of (axis, value)) of the required values alone; the first that is lacking decides.

    axes: an ``indexed`` product. required: array of (axis, value), the axes canonical. No requirement at all can't be verified.
    """
    none = F.lit(None).cast("string")
    nothing = F.array().cast("array<struct<axis:string,value:string>>")

    def of(status: Column, reason: Column, axis: Column, selected: Column) -> Column:
        return F.struct(status.alias("status"), reason.alias("reason"), axis.alias("axis"), selected.alias("selected"))

    def judged(bad: Column, found: Column) -> Column:
        lacking = F.get(F.filter(found, lambda f: f["value"].isNull()), F.lit(0))
        chosen = F.transform(found, lambda f: F.struct(f["source"].alias("axis"), f["value"]["value"].alias("value")))
        verdict = lambda f: (
            F.when(f.isNull(), of(F.lit(PASS), none, none, chosen))
            .when(f["lost"], of(F.lit(UNVERIFIABLE), F.lit("candidate_axis_missing"), f["axis"], nothing))
            .otherwise(of(F.lit(FAIL), F.lit("candidate_required_value_missing"), f["axis"], nothing))
        )
        return (
            F.when(found.isNull(), of(F.lit(UNVERIFIABLE), F.lit("missing_contract"), none, nothing))
            .when(F.size(bad) > 0, of(F.lit(UNVERIFIABLE), F.lit("candidate_axis_collision"), F.get(bad, F.lit(0)), nothing))
            .otherwise(bound(lacking, verdict))
        )

    def looked_up(good: Column) -> Column:
        def one(r: Column) -> Column:
            return bound(_axis(good, r["axis"]), lambda a: F.struct(r["axis"].alias("axis"), a.isNull().alias("lost"), a["source"].alias("source"), _value(a, r["value"]).alias("value")))

        return F.transform(required, one)

    return bound(axes, lambda axes: bound(colliding(axes), lambda bad: bound(bound(_without(axes, bad), looked_up), lambda found: judged(bad, found))))


def complete(axes: Column, match: Column) -> Column:
    """``match`` with the axes it leaves open filled by their cheapest value, ties by text, and ``inferred``: the canonical names of these axes."""
    nobody, none = F.array().cast("array<string>"), F.lit(None).cast("string")

    def of(status: Column, reason: Column, axis: Column, selected: Column, inferred: Column) -> Column:
        return F.struct(status.alias("status"), reason.alias("reason"), axis.alias("axis"), selected.alias("selected"), inferred.alias("inferred"))

    def cheapest(a: Column) -> Column:
        return F.array_min(F.transform(a["values"], lambda v: F.struct(v["price"].isNull().alias("missing"), v["price"].alias("price"), v["key"].alias("key"), v["value"].alias("value"))))["value"]

    def filled(match: Column, rest: Column) -> Column:
        empty = F.get(F.filter(rest, lambda a: F.size(a["values"]) == 0), F.lit(0))["canonical"]
        every = F.concat(match["selected"], F.transform(rest, lambda a: F.struct(a["source"].alias("axis"), cheapest(a).alias("value"))))
        done = of(F.lit(PASS), none, none, every, F.transform(rest, lambda a: a["canonical"]))
        return bound(empty, lambda e: F.when(e.isNotNull(), of(F.lit(UNVERIFIABLE), F.lit("candidate_axis_has_no_values"), e, match["selected"], nobody)).otherwise(done))

    def of_match(match: Column) -> Column:
        rest = bound(F.transform(match["selected"], lambda s: canonical_axis(s["axis"])), lambda fixed: _without(axes, fixed))
        left = of(match["status"], match["reason"], match["axis"], match["selected"], nobody)
        return F.when(match["status"] != PASS, left).otherwise(bound(rest, lambda rest: filled(match, rest)))

    return bound(match, of_match)


def _as_set(options: Column) -> Column:
    return F.array_sort(F.transform(options, lambda o: F.struct(canonical_axis(o["axis"]).alias("axis"), option_text(o["value"]).alias("value"))))


def combination_price(combinations: Column, selected: Column) -> Column:
    """Price of the first listed combination (options, price) with the selected options; null if there is none or it has no usable price."""
    return bound(_as_set(selected), lambda wanted: finite_price(F.get(F.filter(combinations, lambda c: _as_set(c["options"]) == wanted), F.lit(0))["price"]))


#: How the price of a variant was told, or why it can't be.
PRICE_METHODS = (
    "invalid_option_axes",
    "full_variant_combination",
    "multiple_effective_price_axes",
    "effective_price_axis_unselected",
    "selected_variant_price_missing",
    "unique_effective_price_axis",
    "constant_option_price",
    "single_base_price",
    "price_not_deterministic",
)


def variant_price(axes: Column, selected: Column, combinations: Column, base_prices: Column) -> Column:
    """(status, price, method) of a selection of an ``indexed`` product. Nothing is guessed.

    A listed combination counts first; then the only axis whose values have several prices; then the one price that all values have, and
    without any axis the product's own. Of two selections of an axis neither can be told.
    """
    prices = lambda a: F.array_distinct(F.filter(F.transform(a["values"], lambda v: v["price"]), lambda p: p.isNotNull()))
    invalid, full, several, unselected, missing, unique, constant, single, unknown = PRICE_METHODS

    def of(method: str, price: Column | None = None) -> Column:
        found = F.lit(None).cast("double") if price is None else price
        return F.struct(F.lit(UNVERIFIABLE if price is None else PASS).alias("status"), found.alias("price"), F.lit(method).alias("method"))

    def of_one(axis: Column, picked: Column) -> Column:
        own = F.get(F.filter(picked["selected"], lambda s: s["canonical"] == axis["canonical"]), F.lit(0))
        told = lambda own: F.when(own.isNull(), of(unselected)).otherwise(bound(_value(axis, own["value"])["price"], lambda price: F.when(price.isNull(), of(missing)).otherwise(of(unique, price))))
        return bound(own, told)

    def of_none(axes: Column) -> Column:
        every = F.array_distinct(F.flatten(F.transform(axes, lambda a: a["prices"])))
        base = F.array_distinct(F.filter(F.transform(F.coalesce(base_prices, F.array().cast("array<double>")), finite_price), lambda p: p.isNotNull()))
        own = bound(base, lambda base: F.when((F.size(axes) == 0) & (F.size(base) == 1), of(single, F.get(base, F.lit(0)))).otherwise(of(unknown)))
        return bound(every, lambda every: F.when(F.size(every) == 1, of(constant, F.get(every, F.lit(0)))).otherwise(own))

    def of_axes(axes: Column, picked: Column) -> Column:
        priced = F.transform(axes, lambda a: F.struct(a["canonical"].alias("canonical"), a["values"].alias("values"), prices(a).alias("prices")))
        effective = lambda axes: F.filter(axes, lambda a: F.size(a["prices"]) > 1)
        by_axes = lambda axes, some: F.when(F.size(some) > 1, of(several)).when(F.size(some) == 1, bound(F.get(some, F.lit(0)), lambda axis: of_one(axis, picked))).otherwise(of_none(axes))
        return bound(priced, lambda axes: bound(effective(axes), lambda some: by_axes(axes, some)))

    def of_selection(axes: Column, picked: Column) -> Column:
        raw = F.transform(picked["selected"], lambda s: F.struct(s["source"].alias("axis"), s["value"].alias("value")))
        listed = lambda price: F.when(price.isNotNull(), of(full, price)).otherwise(of_axes(axes, picked))
        wrong = (F.size(picked["errors"]) > 0) | (F.size(colliding(axes)) > 0)
        return F.when(wrong, of(invalid)).otherwise(bound(combination_price(combinations, raw), listed))

    return bound(axes, lambda axes: bound(canonical_selection(selected), lambda picked: of_selection(axes, picked)))


def compare_required(axes: Column, required: Column, selected: Column) -> Column:
    """(status, missing, unavailable, wrong, matched): required options against the selected ones, each list by canonical axis.

    A missing axis, a collision or an axis that was selected twice can't be verified.
    """
    def judged(bad: Column, good: Column, picked: Column) -> Column:
        def of(r: Column, axis: Column) -> Column:
            own = F.get(F.filter(picked["selected"], lambda s: s["canonical"] == r["axis"]), F.lit(0))["value"]
            differs = bound(own, lambda own: own.isNull() | (option_text(own) != option_text(r["value"])))
            return F.when(axis.isNull(), "missing").when(_value(axis, r["value"]).isNull(), "unavailable").when(differs, "wrong").otherwise("matched")

        kinds = F.transform(required, lambda r: F.struct(r["axis"].alias("axis"), bound(_axis(good, r["axis"]), lambda axis: of(r, axis)).alias("kind")))
        of_kind = lambda kinds, kind: F.transform(F.filter(kinds, lambda j: j["kind"] == kind), lambda j: j["axis"])
        lists = lambda kinds: F.struct(*(of_kind(kinds, kind).alias(kind) for kind in ("missing", "unavailable", "wrong", "matched")))

        def verdict(lists: Column) -> Column:
            unsure = required.isNull() | (F.size(bad) > 0) | (F.size(picked["errors"]) > 0) | (F.size(lists["missing"]) > 0)
            state = F.when(unsure, UNVERIFIABLE).when((F.size(lists["unavailable"]) > 0) | (F.size(lists["wrong"]) > 0), FAIL).otherwise(PASS)
            return F.struct(state.alias("status"), *(lists[k].alias(k) for k in ("missing", "unavailable", "wrong", "matched")))

        return bound(bound(kinds, lists), verdict)

    def of_axes(axes: Column, bad: Column) -> Column:
        return bound(_without(axes, bad), lambda good: bound(canonical_selection(selected), lambda picked: judged(bad, good, picked)))

    return bound(axes, lambda axes: bound(colliding(axes), lambda bad: of_axes(axes, bad)))


def resolve(axes: Column, values: Column) -> Column:
    """Array of (value, axis, reason) for wanted values of which only the text is known: the only axis that lists one, else why there is none.

    A second value for an axis that is taken is left unresolved.
    """

    def of(v: Column, holders: Column) -> Column:
        return F.struct(v.alias("value"), F.when(F.size(holders) == 1, F.get(holders, F.lit(0))["canonical"]).alias("axis"), F.size(holders).alias("n"))

    holders = lambda axes, key: F.filter(axes, lambda a: F.exists(a["values"], lambda x: x["key"] == key))
    found = lambda axes: F.transform(values, lambda v: bound(bound(option_text(v), lambda key: holders(axes, key)), lambda h: of(v, h)))

    def told(found: Column) -> Column:
        again = lambda f, i: F.exists(F.slice(found, 1, i), lambda g: F.coalesce(g["axis"] == f["axis"], F.lit(False)))
        reason = lambda f, i: F.when(f["n"] == 0, "axis_not_found").when(f["n"] > 1, "axis_ambiguous").when(again(f, i), "canonical_axis_collision")
        named = lambda f, reason: F.struct(f["value"].alias("value"), F.when(reason.isNull(), f["axis"]).alias("axis"), reason.alias("reason"))
        return F.transform(found, lambda f, i: bound(reason(f, i), lambda r: named(f, r)))

    return bound(bound(axes, found), told)
