import random

import pytest

from tidemark.llm import quality as Q


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(800)]
    out = []
    for d in range(n):
        kind = r.choice(["good"] * 6 + ["toxic", "shout", "repeat"])
        text = r.choices(words, k=r.choice([12, 40, 300]))
        if kind == "toxic":
            for _ in range(3):
                text[r.randrange(len(text))] = r.choice(["awful", "vile", "nasty"])
        elif kind == "shout":
            text = [w.upper() + "!!" for w in text]
        elif kind == "repeat":
            text = [text[0]] * len(text)
        out.append((d, " ".join(text), kind))
    return out


def test_held_out_documents(spark):
    rows = corpus(3000, 1)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(k in ("good", "toxic")), int(k == "toxic")) for d, _, k in rows if d % 2], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in Q.resampled(docs, labels).collect()}
    for kind, least, most in (("good", 0.97, 1), ("toxic", 0, 0.1), ("shout", 0, 0.03), ("repeat", 0, 0.15)):
        own = [d for d, _, k in rows if k == kind and d % 2 == 0]
        assert least <= sum(d in kept for d in own) / len(own) <= most, kind
    assert sorted(kept) == sorted(r.doc_id for r in Q.resampled(docs.repartition(7), labels).collect())


@pytest.mark.parametrize("k", [0, 1, 17, 2999, 3000, 9000])
def test_threshold_is_the_kth_largest(spark, k):
    r = random.Random(k)
    values = [r.choice([r.gauss(0, 1), 1.5, -1e6 * r.random()]) for _ in range(3000)]
    keys = spark.createDataFrame([(v,) for v in values], "x double")
    least = Q.threshold(keys, "x", k)
    expected = float("inf") if k == 0 else sorted(values, reverse=True)[k - 1] if k < len(values) else float("-inf")
    assert least == expected


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "no id", "c"), (1, "twice", "d"), (1, "twice", "d"), (4, "long " * 100_000, "e")], "doc_id long, text string, weight string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1), (4, 1, None)], none.schema)
    for labels in (none, some):
        out = Q.sample(docs, labels)
        assert out.count() == 6 and out.where("key IS NULL OR kept IS NULL").count() == 0
        assert Q.resampled(docs, labels).columns == docs.columns
        assert Q.resampled(docs.limit(0), labels).collect() == []
