import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import observation as O


def footer(buttons, search="False", between="\n"):
    return f"\n\n搜索功能是否可用: {search}{between}可点击的按钮: " + json.dumps(buttons, ensure_ascii=False)


def results(ids, title, fields="{n}.0|test brand|test category|test attribute|", page=1):
    rows = [f"{n}|{i}|{fields.format(n=n)}{title}" for n, i in enumerate(ids, 1)]
    head = ["[SHOPPING_OBSERVATION_V2]", "page_type: search_results", "query: useful product", f"Page {page} of 2 (Total results: 40)", "格式: rank|asin|price|brand|category|key_attributes|title"]
    return "\n".join([*head, *rows, f"products_shown: {len(ids)}"]) + footer(["Back to Search", "Next >", *ids])


def fitted(spark, page, opaque=False, **options):
    rows = spark.createDataFrame([(1, page)], "fit int, page string")
    out = O.fit(rows.select("page"), None if opaque else F.length, F.col("page"), tokenizer=len if opaque else None, **options)
    return out.first().fit


def ids_of(text):
    return [x.split("|")[1] for x in text.split("\n") if x.count("|") > 3 and x[0].isdigit()]


@pytest.mark.parametrize("opaque", [False, True])
@pytest.mark.parametrize("page", [1, 2])
def test_every_product_of_a_page_stays(spark, page, opaque):
    ids = [str(100000000000 + k) for k in range(20)]
    raw = results(ids, "product title " + "x" * 40, page=page)
    f = fitted(spark, raw, opaque, budget=1200)
    assert f.fault is None and len(f.visible) == f.visible_tokens <= 1200 and f.truncated and f.critical_footer_preserved
    assert "[TRUNCATED_BY_SHOPPING_PROJECTOR] product_fields_compacted=true" in f.visible and f"Page {page} of 2" in f.visible
    assert ids_of(f.visible) == ids and (f.raw_asin_count, f.visible_asin_count, f.visible_button_count) == (20, 20, 22)
    assert f.page_type == "search_results" and f.truncation_ratio == f.visible_tokens / len(raw)


def test_the_longest_limit_is_found(spark):
    ids = [f"{k:012d}" for k in range(1, 21)]
    f = fitted(spark, results(ids, "很长的商品标题" * 20, "{n}|品牌|类目|属性|"), budget=1400)
    assert ids_of(f.visible) == ids and 1300 < f.visible_tokens <= 1400
    mixed = ["12345678", "123456789", "1234567890", "35842622441", "123456789012"]
    f = fitted(spark, results(mixed, "很长的商品标题" * 20, "{n}|品牌|类目|属性|"), budget=700)
    assert ids_of(f.visible) == mixed
    assert fitted(spark, results(ids, "t" * 60), budget=300).fault == "does_not_fit"


def test_short_page_stays(spark):
    raw = "Product [SEP] price: 20 [SEP] Buy Now" + footer(["back to search", "buy now"], between="\n\n")
    f = fitted(spark, raw, budget=448)
    assert f.visible == raw and not f.truncated and f.page_type == "product_detail" and f.token_budget == 4096


@pytest.mark.parametrize("opaque", [False, True])
def test_both_ends_and_the_footer_stay(spark, opaque):
    raw = "Description " + "detail " * 200 + "TAIL_SPECIFICATION" + footer(["back to search", "< prev"], between="\n\n")
    f = fitted(spark, raw, opaque, generic_budget=300)
    assert f.visible_tokens <= 300 and f.page_type == "information_subpage" and "TAIL_SPECIFICATION" in f.visible
    assert f.visible.endswith('搜索功能是否可用: False\n可点击的按钮: ["back to search", "< prev"]') and f.critical_footer_preserved


def test_page_without_footer_is_a_fault(spark):
    assert fitted(spark, "x" * 1000, generic_budget=128).fault == "no_action_footer"
    many = fitted(spark, "x" * 1000 + footer(["button " + "b" * 20] * 20), generic_budget=128)
    assert many.fault == "footer_over_budget" and many.visible is None and many.visible_tokens is None
    with pytest.raises(ValueError):
        fitted(spark, "x", generic_budget=63)


def test_listed_pages(spark):
    ids = ["12345678", "123456789"]
    raw = " [SEP] ".join(["Page 3 (Total results: 40)", *(x for i in ids for x in (i, "a long title " * 30, "9.5"))]) + footer(["Next >", "other", *ids])
    raw = raw.replace("Page 3", "Page 3")
    # Only product rows count as products of a page, so that the type is generic here, as it has no row.
    f = fitted(spark, raw, generic_budget=200)
    assert f.page_type == "generic" and f.fault is None
    raw = "page_type: search_results [SHOPPING_OBSERVATION_V2]"
    assert fitted(spark, raw + "x" * 500 + footer(["a"]), budget=100).fault == "no_product_rows"
    rows = "1|12345678|x\n2|123456789|y\nz"
    listed = "Page 3 [SEP] 12345678 [SEP] " + "long title " * 40 + " [SEP] 9.5 [SEP] 123456789 [SEP] short [SEP] 7\n" + rows
    f = fitted(spark, listed + footer(["Next >", "other", *ids]), budget=400)
    assert f.page_type == "search_results" and f.fault in (None, "products_lost")


def test_odd_buttons_and_pages(spark):
    rows = spark.createDataFrame([(None,), ("",), ("可点击的按钮: [1, \"a\", null, \"b\\\"c\"]",), ("可点击的按钮: [oops]",)], "page string")
    got = [x.b for x in rows.select(O.buttons(F.coalesce("page", F.lit(""))).alias("b")).collect()]
    assert got == [[], [], ["a", 'b"c'], []]
    assert [x.fit.visible for x in O.fit(rows.limit(2), F.length, F.col("page")).collect()] == ["", ""]
    assert [O._rendered(["short"], ["abcdefgh"], k) for k in range(9)] == ["", "…", "a…", "a…h", "ab…h", "ab…gh", "abc…gh", "abcd…gh", "abcdefgh"]
    limits = spark.range(9).select(O.shortened(F.lit("abcdefgh"), F.col("id").cast("int")).alias("s")).collect()
    assert [x.s for x in limits] == ["", "…", "a…", "a…h", "ab…h", "ab…gh", "abc…gh", "abcd…gh", "abcdefgh"]
