"""Faults that only larger tables or rare texts show."""

import time
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.functions.text import folded_characters
from tidemark.operators import scoring, search, variants
from tidemark.streaming import sessions


def agree(spark, folder, name, **tables):
    """The query and its SQL over tables that are given as data frames."""
    db = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = plans.QUERIES[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    got, want = [tuple(r) for r in df.collect()], db.sql(f"SELECT {columns} FROM ({plans.ORACLE[name]})").fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_folding_of_every_kind_of_character(spark):
    texts = ["ASCII Only", "Straße Ｂ ①", "㎏ x½", "", "颜色 ＡＢ"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = [r.f for r in df.coalesce(1).select(folded_characters(F.col("t")).alias("f")).collect()]
    assert got == [unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()) for t in texts] + [None]


def test_polarity_over_long_texts_takes_seconds(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("word"), i.cast("string")))
    held = F.transform(words, lambda w: F.concat(F.lit("不支持 "), w, F.lit(" "), w))
    start = time.time()
    got = spark.range(1).select(scoring.function_match(words, held, F.array(F.array_join(words, " "))).alias("f")).first().f
    assert got.status == "pass" and len(got.matched) == 300 and {m.source for m in got.matched} == {"attribute"}
    assert time.time() - start < 30


def test_models_of_a_task_are_whole_names(spark, tmp_path):
    texts = ["Send it to christopher.richardson1234 or a-1, x5.", "-" * 30 + "x5 and aaa." + "b" * 30 + "7", " " * 120, None, "Kelvin \u212aa5"]
    rows = [(k, t, "en", "web", None if k == 3 else 101 if k != 4 else 7) for k, t in enumerate(texts)]
    got = agree(spark, tmp_path, "task_constraints", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted((r[0], r[1]) for r in got) == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 1)]


def product(spark, n):
    """One product with an axis of n values, each of which comes twice."""
    value = lambda i: F.struct(F.concat(F.lit("Ｎ "), (i % n).cast("string")).alias("value"), i.cast("double").alias("price"))
    axis = F.struct(F.lit("颜色").alias("axis"), F.transform(F.sequence(F.lit(0), F.lit(2 * n - 1)), value).alias("values"))
    return spark.range(1).select(F.array(axis).alias("options"))


def test_an_axis_of_many_values(spark):
    n = 30_000
    start = time.time()
    rows = product(spark, n).select(variants.indexed(F.col("options")).alias("axes"))
    pick = lambda text: F.array(F.struct(F.lit("color").alias("axis"), F.lit(text).alias("value")))
    none = F.array().cast("array<struct<options:array<struct<axis:string,value:string>>,price:double>>")
    got = rows.select(
        F.size(F.col("axes")[0]["values"]).alias("n"),
        F.col("axes")[0]["values"][7].alias("v"),
        variants.matching(F.col("axes"), pick("N29999")).alias("m"),
        variants.variant_price(F.col("axes"), pick("n 5"), none, F.array().cast("array<double>")).alias("p"),
        variants.resolve(F.col("axes"), F.array(F.lit("n 8"), F.lit("zz"), F.lit("N9"))).alias("r"),
        variants.compare_required(F.col("axes"), pick("n1"), pick("N2")).alias("c"),
    ).first()
    assert got.n == n and (got.v.key, got.v.price) == ("n7", n + 7.0)
    assert got.m.status == "pass" and got.m.selected[0].value == "Ｎ 29999"
    assert (got.p.method, got.p.price) == ("unique_effective_price_axis", n + 5.0)
    assert [(r.axis, r.reason) for r in got.r] == [("color", None), (None, "axis_not_found"), (None, "canonical_axis_collision")]
    assert got.c.status == "fail" and got.c.wrong == ["color"]
    assert time.time() - start < 40


def test_no_requirement_and_collisions(spark):
    options = F.array(*(F.struct(F.lit(a).alias("axis"), F.array(F.struct(F.lit("x").alias("value"), F.lit(1.0).alias("price"))).alias("values")) for a in ("尺码", "颜色", "鞋码", "颜色分类")))
    rows = spark.range(1).select(variants.indexed(options).alias("axes"))
    none = F.lit(None).cast("array<struct<axis:string,value:string>>")
    got = rows.select(variants.colliding(F.col("axes")).alias("c"), variants.matching(F.col("axes"), none).alias("m"), F.size(variants.unambiguous(F.col("axes"))).alias("u")).first()
    assert got.c == ["size", "color"] and got.m.reason == "missing_contract" and got.u == 0


def test_a_phrase_in_a_long_text_takes_seconds(spark):
    df = spark.createDataFrame([(1, "of the x " * 20_000), (2, "the of"), (3, "of"), (4, None)], "doc_id long, text string")
    start = time.time()
    got = search.phrase(search.tokenized(df, "doc_id", {"body": F.col("text")}), "doc_id", "body", ["of", "the"]).collect()
    assert [(r.doc_id, r.times) for r in got] == [(1, 20_000)] and time.time() - start < 30


def test_first_rows_of_a_value_that_many_ask_for(spark):
    parts = spark.range(3_000).select(F.col("id").alias("k"), F.array(F.lit("a")).alias("a"), F.lit("c").alias("c"), F.lit("q").alias("q"))
    asked = spark.range(3_000).select(F.col("id").alias("query_id"))
    start = time.time()
    got = search.by_value(asked, parts, F.lit("<a>"), F.lit("a"), "a", "c", "q", "k", 5).groupBy("query_id").agg(F.collect_list("k").alias("k")).collect()
    assert len(got) == 3_000 and all(sorted(r.k) == [0, 1, 2, 3, 4] for r in got) and time.time() - start < 30


@pytest.mark.parametrize("mode", ["append", "update", "complete"])
def test_replays_are_kept_in_files(spark, tmp_path, mode):
    for k in range(2):
        spark.range(5).select("id", F.timestamp_seconds(F.col("id") + 10 * k).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    if mode == "append":
        got = sessions.run_to_table(sessions.once(stream, "id", "ts", "1 hour"), mode)
        want = [(k,) for k in range(5)]
    else:
        got = sessions.run_to_table(stream.groupBy("id").count(), mode)
        want = sorted([(k, n) for k in range(5) for n in ((2,) if mode == "complete" else (1, 2))])
    assert got.inputFiles() and sorted((r[0], *r[1:][:1]) if mode != "append" else (r[0],) for r in got.collect()) == want


def test_many_queries_and_alike_documents(spark, monkeypatch):
    docs = [(k, ["red hat", "blue hat", "red red coat", "green"][k % 4]) for k in range(60)]
    asked = [(q, t) for q in range(12) for t in (("red", "hat"), ("hat",), ("coat", "blue"))[q % 3]]
    words = search.searchable(spark.createDataFrame(docs, "k long, t string"), "k", {"title": F.col("t")})
    queries = spark.createDataFrame(asked, "query_id long, term string").repartition(3)
    found = lambda: sorted(tuple(r) for r in search.bm25(queries, words, "k", {"title": 1.0}, 20).collect())
    each = found()
    monkeypatch.setattr(search, "MANY_QUERIES", 2)
    assert found() == each and len(each) == 12 * 20


def test_resampling_draws_by_digest_and_not_for_zeros(spark):
    from hashlib import sha256

    import numpy as np

    from tidemark.operators import pairing as P

    rows = [(101, 2.0), (7, 0.0), (33, -1.5), (8, 0.0)]
    df = spark.createDataFrame(rows, "task long, delta double")
    table = np.searchsorted(np.array(P.poisson_thresholds()), np.arange(1 << 20), side="right")
    signs = np.where(np.arange(1 << 20) >= 1 << 19, 1, -1)

    def draw(c, r):
        g, k, j = r // 12, r % 12 // 3, r % 3
        return int(sha256(f"5:{g}:{c}".encode()).hexdigest()[15 * k : 15 * k + 15], 16) >> (20 * j) & 1048575

    for weights, weighed in ((table, True), (signs, False)):
        got = {x.r: (x.total, x.weight) for x in P._replicated(df, "delta", "task", 40, 5, weights, weighed=weighed).collect()}
        assert sorted(got) == list(range(40))
        for r in range(40):
            own = [(int(weights[draw(c, r)]), v) for c, v in rows]
            assert got[r] == (sum(w * v for w, v in own), sum(w for w, v in own if v or weighed))


def test_bm25_reads_the_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = spark.createDataFrame([(k, f"word{k % 7} tea {'cup' * (k % 3)}") for k in range(60)], "id long, text string").withColumn("text", seen.asNondeterministic()("text"))
    words = search.tokenized(docs, "id", {"text": F.col("text")})
    queries = search.asked_terms(spark.createDataFrame([(1, "tea word3"), (2, "cup")], "q long, t string"), "q", F.col("t"))
    found = search.bm25(queries, words, "id", {"text": 1.0}, k=3).collect()
    assert len(found) == 6 and read.value == 60
