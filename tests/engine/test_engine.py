import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts as C
from tidemark.operators import credit as K
from tidemark.operators import evaluation as E
from tidemark.operators import groups as G
from tidemark.operators import pairing as P
from tidemark.operators import search as R
from tidemark.operators import sequences as S
from tidemark.operators import splits as D
from tidemark.sources import catalog, records


def test_exact_test_of_flips(spark):
    rows = spark.createDataFrame([(11, 13), (0, 0), (1, 2), (400, 900)], "g long, l long").coalesce(1)
    p = [r[0] for r in rows.select(P.mcnemar(F.col("g"), F.col("l"))).collect()]
    assert p[0] == pytest.approx(0.8388197422027588, abs=1e-12) and p[1:3] == [1.0, 1.0] and 0 <= p[3] < 1e-40
    a, b = (spark.createDataFrame(list(enumerate(x, 1)), "task long, ok boolean") for x in ([True, True, False, False], [True, False, True, True]))
    got = {(r.task, r.flip) for r in P.transitions(a, b, "task").collect()}
    assert got == {(1, "both"), (2, "loss"), (3, "gain"), (4, "gain")}


def test_shrinkage_of_the_golden_state(spark):
    decisions = spark.createDataFrame([("s", "A", 3), ("s", "B", 1)], "state string, decision string, proposals int")
    rewards = {"A": [1.0, 0.0, 1.0, 0.0], "B": [-1.0, -1.0, 0.0, 0.0]}
    samples = spark.createDataFrame([("s", d, k, r) for d, v in rewards.items() for k, r in enumerate(v)], "state string, decision string, slot int, reward double")
    got = {r.decision: r for r in K.shrinkage(decisions, samples).collect()}
    a, b = got["A"], got["B"]
    assert (a.mu, a["var"], a.uncertainty, a.between) == pytest.approx((0.25, 3 / 16, 1 / 32, 5 / 32))
    assert (a.kappa, b.kappa) == pytest.approx((15 / 16, 5 / 8), abs=1e-6)
    assert (a.shrunk, b.shrunk, a.v) == pytest.approx((31 / 64, -7 / 32, 79 / 256), abs=1e-6)
    assert (a.advantage, b.advantage) == pytest.approx((1 / 6, -1 / 2), abs=1e-6)


def test_kept_groups(spark):
    rows = spark.createDataFrame([("a", 0.0, False), ("a", 1.0, False), ("b", 0.5, False), ("b", 0.5, False), ("c", 0.0, True), ("c", 0.0, False)], "uid string, r double, bad boolean")
    got = {(r.uid, r.verdict) for r in G.reward_varying(rows, "uid", "r", F.col("bad")).collect()}
    assert got == {("a", "kept"), ("b", "constant_reward"), ("c", "sampling_invalid")}


def test_summary_uses_two_denominators(spark):
    expected = spark.createDataFrame([(k,) for k in range(4)], "t long")
    results = spark.createDataFrame([(0, 1, True, 1.0), (0, 2, False, 0.0), (1, 1, None, 2.0)], "t long, n int, ok boolean, r double")
    row = E.fixed_denominator_summary(expected, E.last_per_key(results, "t", "n"), "t", F.col("ok"), "r").first()
    assert tuple(row) == (4, 2, 2, 0, 0.0, 1.0)


def test_bm25_is_that_of_sqlite(spark):
    docs = [(1, "red cold box", "acme"), (2, "cold cold fridge in a box", "box co"), (3, "warm lamp", "acme"), (4, "fridge fridge red", ""), (5, "lamp oil", "acme")]
    weights = {"title": 2.0, "brand": 0.5}
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE d USING fts5(title, brand)")
    db.executemany("INSERT INTO d(rowid, title, brand) VALUES (?, ?, ?)", docs)
    want = db.execute("SELECT rowid, -bm25(d, 2.0, 0.5) FROM d WHERE d MATCH 'cold OR fridge OR oil' ORDER BY 2 DESC, 1").fetchall()
    words = R.tokenized(spark.createDataFrame(docs, "id long, title string, brand string"), "id", {"title": F.col("title"), "brand": F.col("brand")})
    queries = spark.createDataFrame([("q", t) for t in ("cold", "fridge", "oil")], "query_id string, term string")
    got = R.bm25(queries, words, "id", weights).orderBy("rank").collect()
    assert [r.id for r in got] == [w[0] for w in want] and [r.score for r in got] == pytest.approx([w[1] for w in want], abs=1e-6)
    cold = R.postings(words, "id", list(weights), weights).where("id = 2 AND term IN ('cold', 'box')").orderBy("term").collect()
    assert [(r.term, r.tf, r.length) for r in cold] == [("box", 2.5, 8), ("cold", 4.0, 8)] and R.index_stats(words, list(weights)).first().docs == 5
    with pytest.raises(ValueError):
        R.postings(words, "id", ["title"], weights)
    assert [r.id for r in R.phrase(words, "id", "title", ["cold", "box"]).collect()] == [1]


def test_splits(spark):
    ids = spark.createDataFrame([(k,) for k in range(100)], "id long")
    a = {(r.id, r.split) for r in D.hash_split(ids, "id", 1, 0.1).collect()}
    b = {(r.id, r.split) for r in D.hash_split(ids.orderBy(F.desc("id")).repartition(7), "id", 1, 0.1).collect()}
    assert a == b and sum(s == "validation" for _, s in a) == 10
    strata = ids.select("id", F.when(F.col("id") < 60, "short").otherwise("long").alias("s"))
    taken = D.stratified(strata, "s", "id", 1, 15).where("taken").groupBy("s").count().collect()
    assert {tuple(r) for r in taken} == {("short", 9), ("long", 6)}
    rounds = [spark.range(1).select(D.held_out_count(F.lit(n), 0.5)).first()[0] for n in (2, 5, 7)]
    assert rounds == [1, 2, 4]  # halves go to the even number


def test_contracts(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    with pytest.raises(C.ContractError):
        C.require_unique(rows, "k")
    with pytest.raises(C.ContractError):
        C.require_complete(rows, spark.createDataFrame([(1,)], "k long"), "k")
    with pytest.raises(C.ContractError):
        C.require_disjoint(rows, rows, "k")
    C.require_complete(rows, rows, "k")


def test_sequences(spark):
    steps = spark.createDataFrame([("u", k, t) for k, t in enumerate("aabbbba")], "u string, n int, t string")
    runs = [r.run for r in S.run_lengths(steps, "u", ["n"], F.col("t")).orderBy("n").collect()]
    assert runs == [1, 2, 1, 2, 3, 4, 1]
    spans = S.mask_spans(spark.createDataFrame([(1, [1, 1, 0, 1]), (2, [0, 0]), (3, [])], "k int, m array<int>"), "k", "m").collect()
    assert {tuple(r) for r in spans} == {(1, 0, 2), (1, 3, 1)}
    end = S.first_terminal(steps.withColumn("p", F.lit(True)), "u", ["n"], F.col("t"), "p").first()
    assert (end.step, end.reason) == (5, "repeat_loop")


def test_records_round_trip(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.createDataFrame([(1, "é"), (2, None)], "task_id long, s string")
    records.write_jsonl(rows, path)
    with pytest.raises(Exception, match="(?i)exist"):
        records.write_jsonl(rows, path)
    assert sorted(map(tuple, records.read_keyed(spark, path, rows.schema, "task_id").collect())) == [(1, "é"), (2, None)]
    log = tmp_path / "log.jsonl"
    log.write_text('{"task_id": 1}\n\n{"task_id": 2, "attempt_index": 3}\n{"task_id": 2, "att')
    assert {tuple(r) for r in records.finished(spark, str(log)).collect()} == {(1, 0), (2, 3)}
    with pytest.raises(Exception):  # noqa: B017
        records.read_jsonl(spark, str(log), "task_id long").collect()
    assert records.file_digests(spark, str(log)).first().lines == 3
    assert records.markdown(rows.orderBy("task_id")) == "| task_id | s |\n|---|---|\n| 1 | é |\n| 2 |  |\n"


def test_catalog(spark):
    schema = "n long, asin string, pricing array<double>, customization_options map<string, array<struct<value:string>>>, instructions array<struct<instruction:string, attributes:array<string>>>"
    rows = [
        (0, "1", [], {"c": [(" Red/Blue ",)]}, [("a", ["x"]), ("b", [])]),
        (1, "1", [3.0], None, None),
        (2, "nan", [3.0], None, None),
        (3, "2", [3.0, 4.0, 5.0], None, [("c", ["y"]), ("d", ["z"])]),
    ]
    clean = catalog.clean(spark.createDataFrame(rows, schema), "n")
    got = {r.asin: r for r in clean.collect()}
    assert set(got) == {"1", "2"} and got["1"].pricing == [100.0] and got["2"].price_tag == "$3.00 to $4.00"
    assert got["1"].customization_options["c"][0].value == "red | blue"
    assert sorted((r.goal_id, r.instruction) for r in catalog.goals(clean, "n").collect()) == [(0, "a"), (1, "c"), (2, "d")]


def test_lines_of_files_in_several_tasks(spark, tmp_path):
    import gzip

    many = [f'{{"v": {k}}}' + ("\n" if k % 7 else "\n\n  \n") for k in range(400)]
    (tmp_path / "12.jsonl").write_text("".join(many))
    (tmp_path / "3.jsonl").write_text('{"v": 1}\n\n{"v": 2}')
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write('\n{"v": 9}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = records.read_with_lineage(spark, str(tmp_path), "v int")
        got = sorted(((r._source.path.rsplit("/", 1)[1], r._source.step, r._source.line, r.v) for r in rows.collect()), key=lambda x: x[:1] + x[2:])
        assert rows.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([("12.jsonl", 12, k + 1, k) for k in range(400)] + [("3.jsonl", 3, 1, 1), ("3.jsonl", 3, 2, 2), ("x.jsonl.gz", None, 1, 9)], key=lambda x: x[:1] + x[2:])
    (tmp_path / "4.jsonl").write_text("{oops")
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_with_lineage(spark, str(tmp_path), "v int").collect()
