"""Values that the engine's semantics fix."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import scoring as S
from tidemark.operators import search as R
from tidemark.operators import variants as V


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_text(spark):
    row = one(spark, T.search_query(F.lit("  迷你，冰箱 100 CNY ")), T.tokens(F.lit("小冰箱 a20-x a20-x 大")), T.folded(F.lit("ＳＴＲＡßE")), T.canonical(F.lit('{"b": 1, "a": [1.5, "é"]}')), T.canonical(F.lit("{")))
    assert tuple(row) == ("迷你 冰箱 100元", ["小冰", "冰箱", "大", "a20-x"], "strasse", '{"a":[1.5,"é"],"b":1}', None)
    assert one(spark, T.seed63(F.lit("1:2:3")))[0] == int(__import__("hashlib").sha256(b"1:2:3").hexdigest()[:16], 16) & (2**63 - 1)


@pytest.mark.parametrize(
    ("request_", "limit"),
    [
        ("预算在1000元以下。", 1000),
        ("价格不超过 2199 元", 2199),
        ("价格在70元左右", 77),
        ("价格在130-140元之间", 140),
        ("价格30元到40元之间", 40),
        ("预算4k+", None),
        ("预算在1万元左右", 11000),
        ("预算1万2以内", 12000),
        ("预算1万20以内", 30000),
        ("我的预算有限，想买3个杯子", None),
        ("70元左右", None),
        ("30元-40元", None),
        ("我想要256k+内存，预算300元", 300),
        ("预算1,500元以内", 1500),
        ("2千元以下", 2000),
        ("随便", None),
    ],
)
def test_budget(spark, request_, limit):
    got = one(spark, S.budget(F.lit(request_)))[0]
    assert got == limit or math.isclose(got, limit)


def test_comparisons(spark):
    row = one(
        spark,
        S.model_match(F.array(F.lit("A20")), F.lit("phone A200")),
        S.model_match(F.array(F.lit("A20")), F.lit("phone A20 (new)")),
        S.function_match(F.array(F.lit("防水")), F.lit(None).cast("array<string>"), F.array(F.lit("不支持防水")))["status"],
        S.spec_match(F.lit(2.0), F.lit("L"), F.lit("eq"), F.lit("容量为2000ml")),
        S.spec_match(F.lit(2.0), F.lit("L"), F.lit("eq"), F.lit("重2kg")),
        S.category_match(F.lit("家电›冰箱"), F.lit("电器›冰箱")),
        S.category_match(F.lit("冰箱"), F.lit("电器›冰箱")),
        S.price_gate(F.lit(10.0), F.lit(float("nan"))),
        S.price_gate(F.lit(None).cast("double"), F.lit(None).cast("double")),
        S.gates(F.lit("fail"), F.lit("unverifiable")),
        S.brand_match(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a"))),
    )
    assert tuple(row) == ("fail", "pass", "fail", "pass", "unverifiable", "fail", "pass", "unverifiable", "pass", "unverifiable", "pass")


def test_rewards(spark):
    score = lambda x: F.lit(x)
    row = one(
        spark,
        S.partial_reward(score(0.0)),
        S.partial_reward(score(1.0)),
        S.abstain(F.lit(2), F.lit(1), F.lit(0)),
        S.abstain(F.lit(2), F.lit(2), F.lit(0)),
        S.abstain(F.lit(2), F.lit(2), F.lit(1)),
        S.purchase(F.lit("pass"), F.lit("pass"), F.lit(True), F.lit(True), score(1.0)).getField("reward"),
        S.purchase(F.lit("pass"), F.lit("pass"), F.lit(True), F.lit(False), score(1.0)).getField("reward"),
        S.purchase(F.lit("fail"), F.lit("unverifiable"), F.lit(True), F.lit(False), score(1.0)).getField("reward_type"),
        S.policy_reward(F.lit(-0.99), F.lit(9), F.lit(9)),
        S.match_score({"brand": F.lit(1.0), "model": F.lit(0.0)}, {"brand": F.lit(False), "model": F.lit(False)}),
    )
    assert tuple(row) == (-0.3, 0.25, "early_abstain", "graceful_abstain", "early_abstain", 1.0, 0.55, "reward_unverifiable", -1.0, 1.0)


def test_variant_prices(spark):
    axis = "array<struct<axis:string,values:array<struct<value:string,price:double>>>>"
    pair = "array<struct<axis:string,value:string>>"
    two, flat = [("Ｓｉｚｅ", [("Ｌ", 1899.0), ("XL", 1999.0), ("M", None)]), ("颜色", [("红", None), ("白", None)])], [("口味", [("甜", 7.0), ("咸", 7.0)])]
    both = [("尺码", [("L", 1.0), ("M", 2.0)]), ("颜色", [("红", 3.0), ("白", 4.0)])]
    listed = [([("颜色", "白"), ("尺码", "l")], 9.0)]
    cases = [
        ((two, [("size", "xl")], [], [5.0]), ("pass", 1999.0, "unique_effective_price_axis")),
        ((two, [("SIZE", "ｌ")], [], [5.0]), ("pass", 1899.0, "unique_effective_price_axis")),
        ((two, [("size", "m")], [], [5.0]), ("unverifiable", None, "selected_variant_price_missing")),
        ((two, [("size", "zz")], [], [5.0]), ("unverifiable", None, "selected_variant_price_missing")),
        ((two, [("颜色", "红")], [], [5.0]), ("unverifiable", None, "effective_price_axis_unselected")),
        ((both, [("尺码", "L")], listed, [5.0]), ("unverifiable", None, "multiple_effective_price_axes")),
        ((both, [("鞋码", "L"), ("颜色分类", "白")], listed, [5.0]), ("pass", 9.0, "full_variant_combination")),
        ((both, [("尺码", "L"), ("鞋码", "L")], listed, [5.0]), ("unverifiable", None, "invalid_option_axes")),
        ((both + [("颜色分类", [("x", 1.0)])], [], [], [5.0]), ("unverifiable", None, "invalid_option_axes")),
        ((flat, [], [], [5.0]), ("pass", 7.0, "constant_option_price")),
        (([], [], [], [5.0, 5.0, None]), ("pass", 5.0, "single_base_price")),
        (([], [], [], [5.0, 6.0]), ("unverifiable", None, "price_not_deterministic")),
        (([("颜色", [("红", None)])], [], [], [5.0]), ("unverifiable", None, "price_not_deterministic")),
    ]
    df = spark.createDataFrame([c for c, _ in cases], f"options {axis}, selected {pair}, combinations array<struct<options:{pair},price:double>>, base array<double>")
    got = df.coalesce(1).select(V.variant_price(V.indexed(F.col("options")), F.col("selected"), F.col("combinations"), F.col("base")).alias("x")).collect()
    assert [tuple(r.x) for r in got] == [e for _, e in cases]
    cheap = one(spark, S.cheapest(F.array(F.struct(F.lit(None).cast("double").alias("price"), F.lit("a").alias("name")), F.struct(F.lit(2.0).alias("price"), F.lit(" B ").alias("name")))))[0]
    assert cheap == Row(missing=False, price=2.0, name="b")


def test_functions_by_attributes_then_texts(spark):
    cases = [
        ((["防水"], ["防水 材质"], ["不防水"]), ("pass", [("防水", "attribute")], [], [])),
        ((["防水"], ["非防水"], ["防水"]), ("fail", [], [], ["防水"])),
        ((["防水"], ["非防水", "防水"], None), ("pass", [("防水", "attribute")], [], [])),
        ((["热 洗", "静音"], ["x"], [None, "支持热洗，不静音"]), ("fail", [("热 洗", "text_fallback")], [], ["静音"])),
        ((["静音"], [], ["不静音，但静音模式"]), ("pass", [("静音", "text_fallback")], [], [])),
        ((["静音"], ["a"], ["b"]), ("fail", [], ["静音"], [])),
        ((["无"], ["无无"], None), ("pass", [("无", "attribute")], [], [])),
        ((["ＵＳＢ", " "], ["usb-c"], None), ("pass", [("ＵＳＢ", "attribute")], [], [])),
        (([" "], ["a"], None), ("unverifiable", [], [], [])),
        ((["a"], None, [None, ""]), ("unverifiable", [], ["a"], [])),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "r array<string>, s array<string>, t array<string>").coalesce(1)
    got = [r.f for r in df.select(S.function_match(F.col("r"), F.col("s"), F.col("t")).alias("f")).collect()]
    assert [(f.status, [tuple(m) for m in f.matched], f.missing, f.negated) for f in got] == [e for _, e in cases]


def test_options_are_folded(spark):
    texts = ["Ｌ／ＸＬ 号", "½Ｋｇ", "Straße", "①㎏", "ﾊﾝﾄﾞ", None]
    got = [r.t for r in spark.createDataFrame([(x,) for x in texts], "t string").select(V.option_text(F.col("t")).alias("t")).collect()]
    assert got[:4] == ["l|xl号", "1⁄2kg", "strasse", "1kg"] and got[5] == ""
    assert one(spark, V.canonical_axis(F.lit("颜 色"))) == ("color",)


def test_search_form_and_tokens(spark):
    row = one(
        spark,
        T.search_query(F.lit("100块钱 人民币 100 yuan 20RMB yuanyuan ¥100 （a）")),
        T.tokens(F.lit("㐀㐁冰箱")),
        T.search_query(F.lit(None).cast("string")),
        S.spec_match(F.lit(2.0), F.lit("L"), F.lit("eq"), F.lit("容量为２０００ＭＬ")),
    )
    assert row == ("100元 元 100元 20元 yuanyuan ¥100 (a)", ["㐀㐁", "㐁冰", "冰箱"], "", "pass")


def test_fields_of_raw_products(spark):
    docs = ['{"Title": "Ｘ1-Pro a20/b 5 x1-pro", "brand": "", "shop_name": "店", "attribute": {"b": [1, {"z": "é\\"q", "a": null}], "a": 2.5}, "options": [], "sub_title": ["s", true]}', "{", None, '{"title": 5}']
    fields = R.product_fields(F.col("j"))
    got = [r.asDict() for r in spark.createDataFrame([(x,) for x in docs], "j string").coalesce(1).select(*(c.alias(f) for f, c in fields.items())).collect()]
    assert got[0] == {"title": "Ｘ1-Pro a20/b 5 x1-pro", "brand": "店", "category": "", "model": "x1-pro a20/b", "attributes": 'a 2.5 b 1 a z é"q', "options": "", "bullets": "s True"}
    assert set(got[1].values()) == set(got[2].values()) == {""} and got[3]["title"] == "5"


def test_a_chinese_query_finds_its_product(spark):
    schema = "asin string, title string, brand string, category string, model string, attributes string, options string, bullets string"
    rows = [("000000000001", "宿舍小冰箱", "海尔", "家电›冰箱", "", "", "", ""), ("000000000002", "家用冰箱贴", "美的", "饰品", "", "", "", ""), ("000000000003", "dormitory lamp", "acme", "", "a20-x", "", "", "")]
    docs = spark.createDataFrame(rows, schema)
    fields = list(R.EFFECTIVE)
    words = R.searchable(docs, "asin", {f: F.col(f) for f in fields})
    queries = spark.createDataFrame([(1, "宿舍 冰箱"), (2, "A20-X")], "q long, text string")
    got = {(r.query_id, r["rank"]): r.asin for r in R.bm25(R.asked_terms(queries, "q", F.col("text")), words, "asin", R.EFFECTIVE).collect()}
    assert R.index_stats(words, fields).first().docs == 3
    assert got[1, 1] == "000000000001" and got[2, 1] == "000000000003" and (2, 2) not in got
