import json

from pyspark.sql import functions as F

from tidemark.operators import actions, contracts, hidden, rollouts, scoring
from tidemark.operators import features as C


def test_brands_of_an_instruction_and_its_product(spark):
    aliases = C.alias_table(spark.createDataFrame([("海尔", ["Haier", "ＨＡＩＥＲ"]), ("Acme", ["acme tools", "ac"]), ("x", ["y"])], "canonical string, aliases array<string>"))
    rows = [
        (1, "想买 HAIER 冰箱", "Haier海尔 小冰箱", "海尔官方旗舰店"),
        (2, "an ＡＣＭＥ Tools saw", "saw by acme tools", None),
        (3, "石头 洗地机", "石头洗地机 P10", "石头科技旗舰店"),
        (4, "石头 洗地机", "洗地机 P10", "石头科技旗舰店"),
        (5, None, None, None),
        (6, "x y", "x y", "店"),
        (7, "小米之家 手机", "小米之家手机", "小米之家专卖店"),
    ]
    df = spark.createDataFrame(rows, "k int, instruction string, title string, shop_name string")
    for frame in (df, df.repartition(3)):
        got = {r.k: r.expected_brand for r in C.explicit_brands(frame, aliases, "k").collect()}
        assert got == {1: ["海尔"], 2: ["ac", "acme"][1:], 3: ["石头"], 4: [], 5: [], 6: [], 7: ["小米之家"]}


def test_large_alias_tables_are_shuffled(spark, monkeypatch):
    from tidemark.functions import sizes

    monkeypatch.setattr(sizes.small, "__defaults__", (0,))
    names = C.alias_table(spark.range(3000).select(F.concat(F.lit("brand"), F.col("id").cast("string")).alias("canonical"), F.lit(None).cast("array<string>").alias("aliases")))
    df = spark.range(20).select("id", F.concat(F.lit("a Brand "), (F.col("id") * 100).cast("string")).alias("instruction"), F.concat(F.lit("BRAND"), (F.col("id") * 100).cast("string")).alias("title"), F.lit("").alias("shop_name"))
    got = {r.id: set(r.expected_brand) for r in C.explicit_brands(df, names, "id").collect()}
    want = {i: {f"brand{str(i * 100)[:k]}" for k in range(1, len(str(i * 100)) + 1)} - {"brand"} for i in range(20)}
    assert got == want


def test_models(spark):
    row = spark.range(1).select(
        C.explicit_models(F.lit("buy an A20-x or iPhone15, not 12345678901234567890123456 or abc"), F.lit("IPHONE15 pro"), F.lit("a20-X abc 5")).alias("m"),
        C.explicit_models(F.lit(None).cast("string"), F.lit("a1")).alias("n"),
    ).first()
    assert row == (["a20-x", "iphone15"], [])


def test_constraint_contract(spark):
    df = spark.createDataFrame([("买一台支持热洗的洗地机", ["智能", " 热\n洗", "智能", ""], ["白色"]), ("x", ["洗地"], None), (" ", [], [])], "i string, a array<string>, o array<string>")
    got = [r.c.hard_constraints for r in df.coalesce(1).select(C.constraint_contract(F.col("i"), F.col("a"), F.col("o")).alias("c")).collect()]
    assert [g.complete for g in got] == [True, False, False]
    assert got[0].core_functions == ["智能", "热 洗"] and got[0].annotated_option_count == 1 and got[0].brand == [] and got[0].contract_version == "shopping-task-constraints-v1"


def walk(value, path="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            if k.lower() in hidden.GOALS:
                yield f"{path}.{k}"
            yield from walk(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")


def test_hidden_fields_of_any_depth(spark):
    deep = {"gold": 1}
    for k in range(9):
        deep = [deep] if k % 2 else {f"k{k}": deep, "Target": k}
    docs = [{"a": [1, {"Goal": {"x": [[{"gold": 1}]]}}], "b": {"reward_goal": []}}, [], {"goals": 1, "x": "\"goal\": 1"}, deep, {"target_asin": None}]
    texts = [*map(json.dumps, docs), '{"go\\u0061l": 1}', '{"goal": ', "3", None, "goal"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = sorted((r.id, r.path) for r in hidden.forbidden_paths(df, "id", F.col("t")).collect())
    want = sorted([(i, p) for i, d in enumerate(docs) for p in walk(d)] + [(5, "$.goal"), (6, "$!")])
    assert got == want
    typed = spark.range(1).select("id", F.create_map(F.lit("Gold"), F.array(F.struct(F.lit(1).alias("target")))).alias("m"))
    assert sorted(r.path for r in hidden.forbidden_paths(typed, "id", F.to_json(F.struct("m"))).collect()) == ["$.m.Gold", "$.m.Gold[0].target"]
    assert rollouts.hidden_fields(typed, ("target", "m"), ("_gold",)) == ["m", "m{}[].target"]
    assert hidden.forbidden_paths(df.limit(0), "id", F.col("t")).collect() == []


def test_small_parts(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "c array<int>")
    assert [tuple(r) for r in df.coalesce(1).select(*(x.alias(n) for n, x in zip("ab", actions.serial(F.col("c")), strict=True))).collect()] == [([1], [2, 3]), ([], [])]
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "k int, d string")
    assert [r.k for r in contracts.mixed_digests(rows, "k", "d").collect()] == [1]
    c = spark.range(1).select(scoring.comparison(F.lit("pass"), "exact", F.lit(1), F.lit(2)).alias("c")).first().c
    assert c.passed and c.verifiable and c.comparator == "exact"


def test_hidden_levels_do_not_begin_with_the_texts_again(spark):
    df = spark.range(3).select("id", F.lit('{"a": [{"goal": {"b": {"gold": 1}}}]}').alias("t"))
    found = hidden.forbidden_paths(df, "id", F.col("t"))
    assert "Range" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted({r.path for r in found.collect()}) == ["$.a[0].goal", "$.a[0].goal.b.gold"]


def test_runs_of_characters(spark):
    texts = ["a\nb😀c", "", "xx", "xxxx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: sorted(r.g) for r in df.select("i", C.grams(F.col("t"), [2, 4]).alias("g")).collect()}
    assert got == {i: sorted({t[k : k + n] for n in (2, 4) for k in range(len(t) - n + 1)}) for i, t in enumerate(texts)}


def test_conversations_are_dealt_to_all_cores(spark):
    from tidemark.plans import features as plan

    assert plan.tasks(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
