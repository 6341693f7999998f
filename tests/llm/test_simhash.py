import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, id long, fp string, component string"


def brute(rows, size=4, budget=4):
    fps = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        runs = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
        fps.append(sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, fps[i], least[find(i)]) for i, (d, _) in enumerate(rows))


def texts(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.7:
            words = r.choice(out).split()
            for _ in range(r.randrange(4)):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = r.choices(vocabulary, k=r.choice([0, 1, 3, 8, 60, 300]))
        out.append(" ".join(words))
    return out


def test_matches_brute_force(spark):
    rows = [(d, t) for d, t in enumerate(texts(300, 3))]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "A b C d e"), (904, "a B c D E"), (905, "É x y z q"), (906, "x " * 60_000)]
    df = spark.createDataFrame([(d, t, "en", "s", 1, "fp", "c") for d, t in rows], SCHEMA)
    got = sorted((r.id, r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(df).collect())
    assert got == brute(rows)


def test_empty_null_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "a b c d e"), (None, "q r s t u v w x"), (9, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id or -1, r.component or -1) for r in got) == [(-1, -1), (-1, 5), (5, 5), (5, 5), (7, 5), (9, 9)]


@pytest.mark.parametrize("budget", [0, 2, 4])
def test_trie_finds_every_pair(spark, budget):
    r = random.Random(budget)
    centres = [r.getrandbits(64) for _ in range(6)]
    values = {r.choice(centres) ^ sum(1 << k for k in r.sample(range(64), r.randrange(7))) for _ in range(700)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "id long, fp long"), budget).collect()

    def classes(pairs):
        label = list(range(len(values)))
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                m = min(label[a], label[b])
                changed |= label[a] != m or label[b] != m
                label[a] = label[b] = m
        return label

    every = [(i, j) for i in range(len(values)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= budget]
    assert classes(links) == classes(every)


def test_dense_groups_are_linked_in_linear_steps():
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(3)]
    values = np.array(sorted({r.choice(centres) ^ sum(1 << k for k in r.sample(range(20), r.randrange(9))) for _ in range(3000)}), dtype=np.uint64)
    for budget in (3, 6):
        labels, i, j = simhash.trie_links(values, np.array([0, len(values)]), 0, budget)
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= budget
        own = np.arange(len(values))
        while True:
            least = np.where(near, own[None, :], len(values)).min(axis=1)
            if (least == own).all():
                break
            own = least
        assert (labels == own).all() and (np.bitwise_count(values[i] ^ values[j]) <= budget).all()
        assert len(i) == len(values) - len(set(labels.tolist()))  # a forest
        again, _ = simhash._union(np.arange(len(values)), i, j)
        assert (again == labels).all()


def test_paths_grow_with_the_table():
    for n in (0, 1, 1000, 10**6, 10**8, 10**12):
        bits, several = simhash.plan_paths(n)
        assert 16 <= bits <= 32 and 1 - (1 - simhash.EQUAL_BITS**bits) ** (several * (64 // bits)) >= simhash.MEET
    assert simhash.plan_paths(10**6)[0] == 20 and simhash.plan_paths(10**12)[0] == 32


def test_similar_texts_go_and_others_stay(spark):
    r = random.Random(17)
    words = [f"w{k}" for k in range(3000)]
    rows, near, far = [], [], []
    for d in range(240):
        text = r.choices(words, k=r.randrange(80, 400))
        other = list(text)
        if d % 3 == 0:  # words here and there
            for k in r.sample(range(len(text)), max(1, len(text) // r.choice([46, 60, 90, 25]))):
                other[k] = "edited"
        elif d % 3 == 1:  # a passage
            n = int(len(text) * r.choice([0.05, 0.08, 0.1, 0.2]))
            at = r.randrange(len(text) - n)
            other[at : at + n] = r.choices(words, k=n)
        else:
            other += r.choices(words, k=int(len(text) * r.choice([0.1, 0.2, 0.24, 0.4])))
        s = simhash.similarity([w.encode() for w in text], [w.encode() for w in other], 5)
        (near if s >= 0.8 else far).append(d)
        rows += [(d, " ".join(text)), (1000 + d, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id for x in simhash.deduplicated(docs).collect()}
    assert set(range(240)) <= kept and {1000 + d for d in far} <= kept and len(far) > 40
    assert sum(1000 + d not in kept for d in near) >= 0.9 * len(near) and len(near) > 100


def test_edited_copies_go(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for d in range(40):
        text = r.choices(words, k=300)
        rows.append((d, " ".join(text), "x"))
        text[150] = "edited"
        rows.append((100 + d, " ".join(text), "x"))
    rows += [(None, rows[0][1], "x"), (7, rows[14][1], "again"), (500, None, "x"), (501, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    got = [x.doc_id for x in out.collect()]
    assert got.count(None) == 1 and sorted(d for d in got if d is not None) == [*range(40), 500]


def test_different_texts_of_one_id_stay(spark):
    r = random.Random(8)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(120))
    a, b, c = text(), text(), text()
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "y"), (2, b + " more", "x"), (3, c, "x"), (3, c, "x"), (4, None, "x"), (None, a, "x")]
    for n in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n)
        got = [(x.doc_id or 0, x.text or "") for x in simhash.deduplicated(docs).collect()]
        assert sorted(got) == sorted([(0, a), (1, a), (1, b), (3, c), (4, "")])


def test_every_similar_text_goes(spark):
    r = random.Random(29)
    words = [f"w{k}" for k in range(4000)]
    rows, line = [], [f"line{k}" for k in range(30)]
    for d in range(700):
        text = r.choices(words, k=r.randrange(100, 300)) + (line if d % 2 else [])
        other, many = list(text), 0
        # As many words as just leave a similarity of 0.8.
        for k in r.sample(range(len(text)), len(text)):
            tried = [*other[:k], "edited", *other[k + 1 :]]
            if simhash.similarity([w.encode() for w in text], [w.encode() for w in tried], 5) < 0.8:
                break
            other, many = tried, many + 1
        assert many
        rows += [(d, " ".join(text)), (1000 + d, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.deduplicated(docs).collect()) == list(range(700))


@pytest.mark.parametrize("block", [3, 5, 4096])
def test_holders_of_a_shingle_are_paired_across_components(monkeypatch, block):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PAIRS", 7)
    r = random.Random(block)
    rows = sorted((r.choice([-5, 1, 2, 3, 4]), r.randrange(6), i, r.randrange(20, 40), r.randrange(4)) for i in range(60))
    batches = [pa.RecordBatch.from_pylist([dict(zip(["shingle", "component", "id", "n", "place"], x, strict=True)) for x in rows[k : k + 9]]) for k in range(0, 60, 9)]
    pairs, blocks = simhash._sharing(0.8)
    out = pa.Table.from_batches(list(pairs(iter(batches))))
    dealt = out.filter(pa.compute.is_valid(out["left"])).select(["left", "right"])
    got = [(x["a"], x["b"]) for x in out.to_pylist() if x["a"] is not None]
    got += [(x["a"], x["b"]) for b in blocks(iter(dealt.to_batches())) for x in b.to_pylist()]
    want = set()
    for s, c, i, n, p in rows:
        for s2, c2, j, m, q in rows:
            if s == s2 and c != c2 and i < j and min(n - p, m - q) >= 0.8 / 1.8 * (n + m) - 1e-6:
                want.add((i, j))
    assert set(got) == want and want
    assert bool(dealt.num_rows) == (block < 60)


def test_words_of_a_batch_are_not_held_together():
    import tracemalloc

    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    texts = [" ".join(f"w{k}x{i % 97}" for i in range(400)) for k in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "text"])
    run = simhash._prints("k", 5, 2, 0.8, none)
    next(run(iter([batch.slice(0, 5)])))
    tracemalloc.start()
    try:
        out = next(run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # As objects the batch's 240,000 words take some 10 MB.
    assert most < 3_000_000
    assert out.num_rows == len(texts) and out.column(3).to_pylist()[0] == len(np.unique(np.array(simhash.shingle_hashes(texts[0].encode().split(), 5), dtype=np.uint64)))


def test_marks_never_rule_out_a_similar_pair():
    r = random.Random(4)
    sets, marks = [], []
    for n in (1, 14, 16, 17, 40, 150, 700, 3000):
        for keep in (1.0, 0.97, 0.9, 0.8, 0.5, 0.0):
            own = {r.getrandbits(64) for _ in range(n)}
            other = set(r.sample(sorted(own), int(keep * n))) | {r.getrandbits(64) for _ in range(n - int(keep * n) + r.randrange(2))}
            sets += [own, other]
    marks = [simhash._mark(np.array(sorted(s), dtype=np.uint64)) for s in sets]
    n = np.array([len(s) for s in sets], dtype=np.int32)
    assert [len(m) for m in marks] == simhash._mark_sizes(n).tolist()
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    side = n, np.concatenate(marks)
    got = simhash._mark_differences(side, side, i, j)
    for a, b, d in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
        assert d <= len(sets[a] ^ sets[b]) and (a != b or d == 0)
    # And those that are far apart are told apart.
    far = [(a, b) for a in range(0, len(sets), 2) for b in (a + 1,) if len(sets[a]) >= 40 and len(sets[a] & sets[b]) <= len(sets[a]) / 2]
    assert far and all(got[(i == a) & (j == b)][0] > 2 / 9 * (len(sets[a]) + len(sets[b])) for a, b in far if len(sets[a]) <= 700)


def test_dense_group_of_unlike_copies_gives_few_candidates(spark, monkeypatch):
    """Copies that differ from each other by more than the limit share most shingles; they aren't handed out pair by pair."""
    r = random.Random(6)
    words = [f"w{k}" for k in range(20_000)]
    base = r.choices(words, k=150)
    rows = []
    for d in range(300):
        text = list(base)
        for k in r.sample(range(150), r.choice([2, 6, 6, 6, 7])):
            text[k] = r.choice(words)
        rows.append((d, " ".join(text)))
    asked = []
    real = simhash._similar

    def spy(docs, names, pairs, *rest):
        pairs = simhash.cut(pairs)
        asked.append(pairs.count())
        return real(docs, names, pairs, *rest)

    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in rows]
    label = list(range(300))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(300):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    monkeypatch.setattr(simhash, "_similar", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.deduplicated(docs).collect()) == sorted({find(i) for i in range(300)})
    assert len({find(i) for i in range(300)}) > 30
    assert sum(asked[1:]) < 500, asked


@pytest.mark.parametrize("block", [3, 5, 4096])
def test_marks_go_with_the_holders_of_a_block(monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PAIRS", 7)
    r = random.Random(block)
    base = [r.getrandbits(64) for _ in range(64)]
    sets = [set(base[: r.choice([14, 30, 60])]) | {r.getrandbits(64) for _ in range(r.choice([2, 4, 9]))} for _ in range(60)]
    marks = [simhash._mark(np.array(sorted(s), dtype=np.uint64)) for s in sets]
    rows = sorted((r.choice([1, 2]), r.randrange(20), i, len(s), 0, marks[i].tobytes()) for i, s in enumerate(sets))
    names = ["shingle", "component", "id", "n", "place", "mark"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows[k : k + 9]]) for k in range(0, 60, 9)]

    def found(forest):
        pairs, blocks = simhash._sharing(0.8, forest)
        out = pa.Table.from_batches(list(pairs(iter(batches))))
        dealt = out.filter(pa.compute.is_valid(out["left"])).select(["left", "right"])
        got = [(x["a"], x["b"]) for x in out.to_pylist() if x["a"] is not None]
        return {*got, *((x["a"], x["b"]) for b in blocks(iter(dealt.to_batches())) for x in b.to_pylist())}

    apart = lambda a, b: int(simhash._mark_differences((np.array([len(sets[a])]), marks[a]), (np.array([len(sets[b])]), marks[b]), np.zeros(1, int), np.zeros(1, int))[0])
    want, similar = set(), set()
    for s, c, i, n, _, _ in rows:
        for s2, c2, j, m, _, _ in rows:
            if s == s2 and c != c2 and i < j and min(n, m) >= 0.8 / 1.8 * (n + m) - 1e-6:
                if apart(i, j) <= (n + m) / 9 + 1e-6:
                    want.add((i, j))
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    similar.add((i, j))
    assert found(False) == want and similar <= want and similar
    assert found(True) <= want and found(True)
