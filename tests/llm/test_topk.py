import math
import random

import pytest

from tidemark.llm import topk


def brute(rows, k, every):
    own = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(own):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for m, (i, b) in enumerate(own) if m != n and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_rows_that_repeat_an_id(spark):
    rows = [(50, [2.0, 0.0]), (1, [3.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (50, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(df, k=5, every=50).collect())
    assert got == brute(rows, 5, 50) and len(got) == 8


@pytest.mark.parametrize("kind", ["plain", "ties", "large", "few"])
def test_matches_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    r = random.Random(kind)
    n = 3 if kind == "few" else 400
    make = {"plain": lambda: r.gauss(0, 1), "ties": lambda: r.choice([0.0, 0.01, -0.01]), "large": lambda: r.gauss(0, 1e6), "few": lambda: r.gauss(0, 1)}[kind]
    rows = [(i, [make() for _ in range(8)]) for i in range(-5, n)]
    if kind == "ties":
        rows += [(1000 + i, rows[10][1]) for i in range(150)]
    rows += [(None, [1.0] * 8), (5000, None), (5010, [1.0] * 7 + [None]), (5020, [float("nan")] * 8), (5030, [float("inf")] * 8), (5040, [1.0] * 3), (5050, [2.0] * 3), (5060, []), (7, [0.5] * 8), (10, [0.25] * 8), (10, [0.25] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(df, k=5, every=10).collect())
    assert got == brute(rows, 5, 10)


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
