import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import divergence as D


def brute(rows, least=10, top=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups, docs, counts = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: counts[lang, s] for g, s in groups if g == lang}
        every = sum(own.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pair), ("term", term)) for k, (v, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("small_parts", [False, True])
def test_matches_brute_force(spark, monkeypatch, small_parts):
    if small_parts:
        monkeypatch.setattr(D, "HELD", 20)
        monkeypatch.setattr(D, "BLOCK_ROWS", 30)
        monkeypatch.setattr(D, "CELLS", 12)
    r = random.Random(3)
    vocabulary = [*(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)), "Ünï", "ünï", "日本", "Ab-cD", "x1y", "\x7f", "É"]
    rows = [(" ".join(r.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=r.choice([0, 1, 20, 60]))), r.choice(["en", "en", "de", None]), r.choice(["hot"] * 5 + ["a", "B", "ä", None])) for _ in range(300)]
    rows += [("only here", "xx", "one"), (None, "xx", "two"), ("", "en", "silent"), ("12 34", "en", "digits"), ("word " * 3000, "en", "a")]
    rows += [rows[0]] * 20 + [("alone " * 2, "yy", "one")] * 12
    df = spark.createDataFrame([(k, t, la, s, 1, 2, "p") for k, (t, la, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, g int, count int, term string")
    got = sorted(tuple(x) for x in D.audit(df.repartition(6)).collect())
    assert got == brute(rows)


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(10**11 + 7, 3 * 10**12 + 1, 12345), (0, 1, 1)]
    df = spark.createDataFrame(rows, "count long, n long, v long").select(D.share(F.col("count"), F.col("n"), F.col("v")).alias("p"))
    assert [x.p for x in df.collect()] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert D.audit(empty).collect() == []
