"""Pages cut to a budget of tokens: the longest body or titles that fit, with every action of the page kept.

A page is a body and a footer that says whether search is there and which buttons can be clicked. A page over its budget becomes an array of pieces,
some of which can be cut to a limit on characters, and the largest limit whose text fits is found by bisection: within
the row, in the JVM, where tokens are counted by built-in functions; in Arrow batches for an opaque tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .contracts import first_reason

#: Marks of the pages' format, and the buttons that navigate.
SEARCH_STATE, BUTTONS = "搜索功能是否可用:", "可点击的按钮:"
STRUCTURED, PROJECTED, TRUNCATED = "[SHOPPING_OBSERVATION_V2]", "[SHOPPING_OBSERVATION_PROJECTION]", "[TRUNCATED_BY_SHOPPING_PROJECTOR]"
PRODUCT_ID = r"\d{8,12}"
NAVIGATION = ("back to search", "next >", "< prev", "description", "features", "reviews", "attributes", "buy now")
#: What ends a line, and white space at the ends of a text.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))

Count = Callable[[Column], Column]


def buttons(page: Column) -> Column:
    """The texts in the page's list of buttons; empty where there is none or it is no JSON."""
    listed = F.from_json(F.regexp_extract(page, BUTTONS + r"\s*(\[[^\n]*\])", 1), "array<variant>")
    texts = F.filter(listed, lambda b: F.schema_of_variant(b) == "STRING")
    return F.coalesce(F.transform(texts, lambda b: F.variant_get(b, "$", "string")), F.array().cast("array<string>"))


def products(page: Column) -> Column:
    """Ids of the page's product rows in their order."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(rf"(?m)^\d+\|({PRODUCT_ID})\|"), 1))


def navigates(button: Column) -> Column:
    return F.lower(button).isin(*NAVIGATION)


def page_type(page: Column, page_buttons: Column, page_products: Column) -> Column:
    names = F.transform(page_buttons, F.lower)
    listed = page.contains(STRUCTURED) & page.contains("page_type: search_results")
    numbered = page.rlike(r"(?:^|\[SEP\]\s*)Page \d+") & (F.size(page_products) > 0)
    sub = (F.size(names) > 0) & F.forall(names, lambda b: b.isin("back to search", "< prev"))
    return (
        F.when(listed | numbered, "search_results")
        .when(F.array_contains(names, "buy now") | page.contains("价格:"), "product_detail")
        .when(page.contains(f"{SEARCH_STATE} True"), "search_home")
        .when(sub, "information_subpage")
        .otherwise("generic")
    )


def shortened(text: Column, limit: Column) -> Column:
    """The beginning and the end of a text, two to one, with a dot between them."""
    head = F.greatest(F.lit(1), F.floor((limit - 1) * 2 / 3).cast("int"))
    tail = F.greatest(F.lit(1), limit - 1 - head)
    both = F.concat(F.left(text, head), F.lit("…"), F.right(text, tail))
    return F.when(limit <= 0, "").when(F.length(text) <= limit, text).when(limit == 1, "…").when(limit == 2, F.concat(F.left(text, F.lit(1)), F.lit("…"))).otherwise(both)


def footer_of(footer: Column, shown: Column) -> Column:
    """Both lines of a footer with the given buttons."""
    states = F.filter(F.transform(F.split(footer, LINE_END), lambda x: F.trim(x)), lambda x: x.startswith(SEARCH_STATE))
    each = F.transform(shown, lambda b: F.regexp_extract(F.to_json(F.array(b)), r"(?s)^\[(.*)\]$", 1))
    return F.concat(F.coalesce(F.get(states, 0), F.lit(f"{SEARCH_STATE} False")), F.lit(f"\n{BUTTONS} ["), F.array_join(each, ", "), F.lit("]"))


def _parts(page: Column) -> list[dict[str, Column]]:
    """What the pieces are made of, in steps that use the columns of the step before."""
    split = rf"(?s)^(.*)\n\n({SEARCH_STATE}.*)$"
    whole = page.rlike(split)
    row = rf"^(\d+)\|({PRODUCT_ID})\|(.*)$"
    lines, segments = F.col("_lines"), F.col("_segments")
    rows = F.transform(F.filter(lines, lambda x: x.rlike(row)), lambda x: F.struct(F.regexp_extract(x, row, 1).alias("rank"), F.regexp_extract(x, row, 2).alias("id"), F.split(F.regexp_extract(x, row, 3), r"\|", -1).alias("fields")))
    head = F.filter(lines, lambda x: ~x.rlike(row) & (x != "") & ~x.startswith("products_shown:"))
    at = F.filter(F.sequence(F.lit(0), F.size(segments) - 1), lambda i: F.get(segments, i).rlike(f"^{PRODUCT_ID}$"))
    or_empty = lambda x: F.coalesce(x, F.lit(""))
    listed = F.transform(at, lambda i: F.struct(F.get(segments, i).alias("id"), or_empty(F.get(segments, i + 1)).alias("title"), or_empty(F.get(segments, i + 2)).alias("price")))
    number = F.coalesce(F.get(F.filter(segments, lambda x: x.rlike(r"^Page \d+.*$")), 0), F.lit("Page unknown"))
    return [
        {"body": F.when(whole, F.regexp_extract(page, split, 1)).otherwise(page), "footer": F.when(whole, F.regexp_extract(page, split, 2)).otherwise("")},
        {"lines": F.split("_body", LINE_END), "segments": F.transform(F.split("_body", r"\[SEP\]"), lambda x: F.trim(x, F.lit(WHITE)))},
        {"rows": rows, "head": head, "listed": listed, "number": number},
    ]


def _piece(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def _fixed(text: Column) -> Column:
    return _piece("fixed", text)


def _note(what: str) -> Column:
    return F.array(_piece("note", F.lit(f"{TRUNCATED} {what}=true\n")))


def _structured(p: dict[str, Column]) -> Column:
    """The pieces of a page of product rows, each of whose fields can be cut."""
    fields = lambda r: F.flatten(F.transform(r["fields"], lambda x: F.array(_fixed(F.lit("|")), _piece("short", x))))
    rows = F.flatten(F.transform(p["rows"], lambda r: F.concat(F.array(_fixed(F.concat_ws("|", r["rank"], r["id"]))), fields(r), F.array(_fixed(F.lit("\n"))))))
    head = F.array(_fixed(F.array_join(F.transform(p["head"], lambda x: F.concat(x, F.lit("\n"))), "")))
    return F.concat(head, rows, _note("product_fields_compacted"), F.array(_fixed(p["kept_footer"])))


def _listed(p: dict[str, Column]) -> Column:
    """The pieces of a page of segments: a line a product, whose title can be cut."""
    n = F.size(p["listed"]).cast("string")
    query = F.coalesce(F.nullif(F.trim(p["query"]), F.lit("")), F.lit("(not recorded)"))
    head = F.concat(F.lit(f"{PROJECTED}\npage_type: search_results\nquery: "), query, F.lit("\npage: "), p["number"], F.lit("\nproducts_shown: "), n, F.lit("/"), n, F.lit("\n"))
    line = lambda r, i: F.array(_fixed(F.concat(F.format_string("%02d", i + 1), F.lit("|"), r["id"], F.lit("|"), r["price"], F.lit("|"))), _piece("short", r["title"]), _fixed(F.lit("\n")))
    return F.concat(F.array(_fixed(head)), F.flatten(F.transform(p["listed"], line)), _note("product_titles_compacted"), F.array(_fixed(p["kept_footer"])))


def _render(pieces: Column, limit: Column) -> Column:
    """A text from its pieces: fixed ones, short ones cut to the limit, a note that stands only if one was cut, and a body of which both ends are
    kept, four to one."""
    cut = F.exists(pieces, lambda x: (x["kind"] == "short") & (F.length(x["text"]) > limit))
    tail = F.floor(limit / 5).cast("int")
    ends = lambda t: F.when(tail == 0, F.lit(TRUNCATED)).otherwise(F.concat(F.rtrim(F.left(t, limit - tail), F.lit(WHITE)), F.lit(f"\n{TRUNCATED}\n"), F.ltrim(F.right(t, tail), F.lit(WHITE))))
    text = lambda x: F.when(x["kind"] == "fixed", x["text"]).when(x["kind"] == "short", shortened(x["text"], limit)).when(x["kind"] == "note", F.when(cut, x["text"]).otherwise("")).otherwise(ends(x["text"]))
    return F.array_join(F.transform(pieces, text), "")


def _longest(pieces: Column, most: Column, budget: Column, count: Count) -> Column:
    """The largest limit, up to ``most``, that bisection finds to fit, or -1."""

    def step(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        fits = F.struct((middle + 1).alias("low"), state["high"].alias("high"), middle.alias("best"))
        left = F.when(count(_render(pieces, middle)) <= budget, fits).otherwise(F.struct(state["low"].alias("low"), (middle - 1).alias("high"), state["best"].alias("best")))
        return F.when(state["low"] > state["high"], state).otherwise(left)

    begin = F.struct(F.lit(0).alias("low"), most.alias("high"), F.lit(-1).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(most + 2.0)).cast("int")), begin, step, lambda s: s["best"])


def _rendered(kinds: Sequence[str], texts: Sequence[str], limit: int) -> str:
    """``_render`` for a tokenizer's bisection."""
    cut = any(k == "short" and len(t) > limit for k, t in zip(kinds, texts, strict=True))
    head, tail = max(1, (limit - 1) * 2 // 3), limit // 5

    def text(kind: str, t: str) -> str:
        if kind == "fixed" or kind == "note" and cut or kind == "short" and len(t) <= limit:
            return t
        if kind == "body":
            return f"{t[: limit - tail].rstrip(WHITE)}\n{TRUNCATED}\n{t[len(t) - tail :].lstrip(WHITE)}" if tail else TRUNCATED
        if kind == "note" or limit <= 0:
            return ""
        return (t[: head if limit > 2 else limit - 1] + "…" + (t[-max(1, limit - 1 - head) :] if limit > 2 else ""))

    return "".join(map(text, kinds, texts))


def _counter(tokenizer: Callable[[str], int]) -> tuple[Count, Callable[..., Column]]:
    """Column functions of an opaque tokenizer: the count of a text, and the largest limit that fits."""

    @F.pandas_udf(LongType())
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else tokenizer(t)).astype("Int64")

    @F.pandas_udf(StructType().add("limit", IntegerType()).add("tokens", LongType()))
    def longest(kinds: pd.Series, texts: pd.Series, most: pd.Series, budget: pd.Series) -> pd.DataFrame:
        def one(k, t, high, room) -> tuple[int | None, int | None]:
            if k is None:
                return None, None
            low, best, high = 0, (-1, None), int(high)
            while low <= high:
                middle = (low + high) // 2
                if (n := tokenizer(_rendered(k, t, middle))) <= room:
                    low, best = middle + 1, (middle, n)
                else:
                    high = middle - 1
            return best

        found = [one(*x) for x in zip(kinds, texts, most, budget, strict=True)]
        return pd.DataFrame({"limit": pd.array([x for x, _ in found], dtype="Int32"), "tokens": pd.array([n for _, n in found], dtype="Int64")})

    return counted, longest


def fit(
    rows: DataFrame,
    count: Count | None,
    page: Column,
    tool: Column | None = None,
    query: Column | None = None,
    budget: int = 1536,
    detail_budget: int = 4096,
    generic_budget: int = 768,
    page_capacity: int = 20,
    tokenizer: Callable[[str], int] | None = None,
) -> DataFrame:
    """``rows`` with ``fit``: the visible text of ``page``, why there is none (``fault``), and what is known of both texts.

    Pages within their budget stay as they are. ``count`` gives the number of tokens of a text, by built-in functions; a ``tokenizer``
    counts instead of it, in Arrow batches. A null page is an empty one.
    """
    if tokenizer is not None:
        count, longest = _counter(tokenizer)
    if min(budget, detail_budget, generic_budget) < 64 or page_capacity < 1:
        raise ValueError("budgets have to be 64 tokens or more, and a page has to have room for a product")
    null = F.lit(None).cast("string")
    raw = F.coalesce(page, F.lit(""))
    names = rows.columns
    # Columns of their own rather than fields of one: a field is worked out again wherever it is used.
    found = rows.withColumn("_page", raw).withColumns({"_buttons": buttons(F.col("_page")), "_products": products(F.col("_page")), "_tool": tool if tool is not None else null, "_query": query if query is not None else null})
    found = found.withColumns({"_type": page_type(F.col("_page"), F.col("_buttons"), F.col("_products")), "_raw_tokens": count(F.col("_page")).cast("long")})
    own = F.when(F.col("_type") == "search_results", budget).when(F.col("_type") == "product_detail", detail_budget).otherwise(generic_budget)
    found = found.withColumn("_budget", own).withColumn("_over", F.col("_raw_tokens") > F.col("_budget")).withColumn("_text", F.when(F.col("_over"), F.col("_page")))

    text, search = F.col("_text"), F.col("_type") == "search_results"
    for step in _parts(text):
        found = found.withColumns({f"_{n}": c for n, c in step.items()})
    p = {n: F.col(f"_{n}") for n in ("body", "footer", "rows", "head", "listed", "number", "query", "budget")}
    found = found.withColumn("_form", F.when(search & text.contains(STRUCTURED), "structured").when(search & (F.size(p["listed"]) > 0), "listed").otherwise("generic"))
    p["form"] = F.col("_form")
    ids = F.when(p["form"] == "structured", p["rows"]["id"]).otherwise(p["listed"]["id"])
    kept = F.filter(F.col("_buttons"), lambda b: F.array_contains(ids, b) | navigates(b))
    lengths = F.when(p["form"] == "structured", F.array_max(F.transform(F.flatten(p["rows"]["fields"]), F.length))).when(p["form"] == "listed", F.array_max(F.transform(p["listed"]["title"], F.length))).otherwise(F.length(p["body"]))
    more = {"most": F.coalesce(lengths, F.lit(0)), "kept_footer": footer_of(p["footer"], kept), "full_footer": footer_of(p["footer"], F.col("_buttons"))}
    found = found.withColumns({f"_{n}": c for n, c in more.items()})
    p |= {n: F.col(f"_{n}") for n in more}
    body = F.array(_piece("body", p["body"]), _fixed(F.concat(F.lit("\n"), p["full_footer"])))
    pieces = F.when(p["form"] == "structured", _structured(p)).when(p["form"] == "listed", _listed(p)).otherwise(body)
    found = found.withColumn("_pieces", F.when(F.col("_over"), pieces))

    unsafe = ~text.contains(f"\n\n{SEARCH_STATE}") | ~text.contains(BUTTONS)
    suffix = count(F.when(p["form"] == "generic", F.concat(F.lit(f"{TRUNCATED}\n"), p["full_footer"])))
    early = first_reason(
        no_action_footer=unsafe,
        no_product_rows=(p["form"] == "structured") & (F.size(p["rows"]) == 0),
        too_many_products=(p["form"] == "listed") & (F.size(p["listed"]) > page_capacity),
    )
    found = found.withColumn("_early", early).withColumn("_open", F.when(F.col("_over") & F.col("_early").isNull(), F.col("_pieces")))
    pieces, room = F.col("_open"), F.col("_budget")
    # A tokenizer gives the count of what it has fitted as well: functions in Python that wait for each other would have the optimizer work for long.
    if tokenizer is not None:
        found = found.withColumn("_fit", longest(pieces["kind"], pieces["text"], p["most"], room)).withColumn("_limit", F.col("_fit.limit"))
    else:
        found = found.withColumn("_limit", F.when(pieces.isNotNull(), _longest(pieces, p["most"], room, count)))
    found = found.withColumn("_fault", F.coalesce("_early", first_reason(footer_over_budget=suffix > room, does_not_fit=F.col("_limit") < 0)))
    found = found.withColumn("_visible", F.when(~F.col("_over"), F.col("_page")).when(F.col("_fault").isNull(), _render(F.col("_pieces"), F.col("_limit"))))

    # What is shown is held against the page again, whatever was done to it.
    v = F.col("_visible")
    found = found.withColumns({"_shown_buttons": buttons(v), "_shown_products": products(v), "_tokens": count(v).cast("long") if tokenizer is None else F.when(F.col("_over"), F.col("_fit.tokens")).otherwise(F.col("_raw_tokens"))})
    before = {"page": F.col("_page"), "buttons": F.col("_buttons"), "products": F.col("_products")}
    after = {"buttons": F.col("_shown_buttons"), "products": F.col("_shown_products")}
    same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    ways = lambda x: F.filter(F.transform(x, F.lower), navigates)
    footer = ~((before["page"].contains(SEARCH_STATE) & ~v.contains(SEARCH_STATE)) | (before["page"].contains(BUTTONS) & ~v.contains(BUTTONS))) & same(ways(before["buttons"]), ways(after["buttons"]))
    opened = F.filter(after["buttons"], lambda b: F.trim(b).rlike(f"^{PRODUCT_ID}$"))
    late = first_reason(
        above_budget=F.col("_tokens") > F.col("_budget"),
        footer_lost=~footer,
        buttons_changed=~search & ~same(before["buttons"], after["buttons"]),
        products_lost=search & ~same(before["products"], after["products"]),
        products_not_actionable=search & ~same(before["products"], opened),
    )
    found = found.withColumn("_footer_kept", footer).withColumn("_fault", F.coalesce(F.col("_fault"), F.when(v.isNotNull(), late)))
    safe = F.col("_fault").isNull()
    result = F.struct(
        F.when(safe, v).alias("visible"),
        F.col("_fault").alias("fault"),
        F.col("_tool").alias("tool_name"),
        F.col("_type").alias("page_type"),
        F.col("_budget").alias("token_budget"),
        F.col("_raw_tokens").alias("raw_tokens"),
        F.when(safe, F.col("_tokens")).alias("visible_tokens"),
        F.when(safe, F.when(F.col("_raw_tokens") == 0, 1.0).otherwise(F.col("_tokens") / F.col("_raw_tokens"))).alias("truncation_ratio"),
        F.when(safe, v != before["page"]).alias("truncated"),
        F.size(before["products"]).alias("raw_asin_count"),
        F.when(safe, F.size(after["products"])).alias("visible_asin_count"),
        F.size(before["buttons"]).alias("raw_button_count"),
        F.when(safe, F.size(after["buttons"])).alias("visible_button_count"),
        F.when(safe, F.col("_footer_kept")).alias("critical_footer_preserved"),
    )
    return found.withColumn("fit", result).select(*names, "fit")
