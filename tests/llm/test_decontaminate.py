import random
import re

import pytest

from tidemark.llm import decontaminate as D


def sets(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs, items, t=0.8):
    owned = {}
    for i, text in items:
        if i is not None and text is not None:
            owned.setdefault(i, set()).update(sets(text))
    out = {}
    for d, text in docs:
        if d is None or text is None:
            continue
        for i, s in owned.items():
            n = len(s & sets(text))
            if s and n / len(s) >= t - 1e-12:
                out[d, i] = max(out.get((d, i), (0, 0)), (n, len(s)))
    return {(d, i, size, n) for (d, i), (n, size) in out.items()}


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_ROWS", limit)
    r = random.Random(4)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([4, 5, 6, 20, 45])))) for i in range(40)]
    items += [(100, None), (101, ""), (None, "a b c d e f"), (7, items[7][1] + " more words of the same item"), (102, items[3][1])]
    docs = []
    for d in range(300):
        words = r.choices(vocabulary, k=r.choice([0, 3, 50, 600]))
        if r.random() < 0.5:
            leak = r.choice(items)[1] or ""
            leak = leak.split()
            for _ in range(r.randrange(4)):
                if leak:
                    leak[r.randrange(len(leak))] = r.choice(vocabulary)
            at = r.randrange(len(words) + 1)
            words[at:at] = [r.choice([w, w.upper(), w + "%%%", w + ",\n"]) for w in leak]
        docs.append((d, " ".join(words)))
    docs += [(None, items[5][1]), (900, None), (901, ""), (5, docs[5][1]), (902, "same " * 50_000)]
    items += [(103, "same same same same same")]
    dd = spark.createDataFrame([(d, t, 1, "w", 0.5) for d, t in docs], "doc_id long, text string, item_id int, each string, need double")
    bb = spark.createDataFrame([(i, t, 2, "x") for i, t in items], "item_id long, text string, doc_id int, shingles string")
    got = {(x.doc_id, x.item_id, x.n_shingles, x.n_shared) for x in D.contained(dd, bb).collect()}
    assert got == brute(docs, items) and len(got) > 40
    kept = D.decontaminated(dd, bb)
    hit = {d for d, *_ in got}
    assert sorted(-1 if x.doc_id is None else x.doc_id for x in kept.collect()) == sorted(-1 if d is None else d for d, _ in docs if d not in hit)
    assert kept.columns == dd.columns


def test_empty(spark):
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contained(some.limit(0), items).collect() == [] and D.contained(some, items.limit(0)).collect() == []
    assert D.decontaminated(some, items.limit(0)).count() == 1
