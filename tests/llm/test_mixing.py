import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import mixing as M


def levels(sizes, budget=1.5, most=2):
    """Targets by sharing out the excess again and again."""
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, full = budget * sum(sizes.values()), set()
    while True:
        open_ = [s for s in sizes if s not in full]
        if not open_:
            return {s: most * sizes[s] for s in sizes}
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in sizes}
        full |= over


def corpus(seed):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices("ab cd efg\x0bh".split(" "), k=r.choice([0, 1, 30, 200]))), r.choice(["hot"] * 6 + ["a", "B", "ä", "z", "", None])) for i in range(400)]
    rows += [(500, None, "a"), (501, "", "none"), (502, "\t \n", "none"), (503, "w " * 5000, "long"), (None, "x y z", "a"), (504, "x", "tiny"), (505, "x y", "tiny2")]
    return rows + [(7, "same row here", "hot")] * 60 + [(8, None, "hot")] * 3


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, 2, "s", 3) for x in rows], "doc_id long, text string, source string, size int, target int, s string, n int")


@pytest.mark.parametrize(("block", "width", "copies"), [(64, 4, 16), (1024, 1024, 4096)])
def test_mix(spark, monkeypatch, block, width, copies):
    monkeypatch.setattr(M, "WIDTH", width)
    monkeypatch.setattr(M, "COPIES", copies)
    rows = corpus(1)
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    want = levels(sizes)
    mix = M.Mix(frame(spark, rows).repartition(7), block=block)
    found = mix.taken().collect()
    assert Counter((x.doc_id, x.size) for x in found) == Counter((i, words(t)) for i, t, _ in rows)
    assert all(0 <= x.taken <= 2 * x.size for x in found)
    target = {x.source: x.target for x in mix.sources.collect()}
    assert target.keys() == want.keys() and all(target[s] == pytest.approx(want[s]) for s in want)
    by_target = defaultdict(int)
    for x in found:
        by_target[round(x.target, 6), x.source_size] += x.taken
    expected = defaultdict(int)
    for s, t in want.items():
        expected[round(t, 6), sizes[s]] += int(t + 0.5)
    assert by_target == expected
    # A rerun over other partitions agrees.
    again = M.Mix(frame(spark, rows[::-1]).repartition(3), block=block).taken().collect()
    assert Counter(found) == Counter(again)


def test_schedule_is_in_proportion_and_shuffled(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.randrange(1, 40), r.choice("aaab")) for i in range(3000)]
    mix = M.Mix(frame(spark, rows), block=16)
    order = sorted(mix.schedule().collect(), key=lambda x: (x.slot, x.start))
    assert all(0 <= x.first and x.first + x.length <= x.size for x in order)
    total = {x.s: x.goal for x in mix.sources.collect()}
    words = sum(total.values())
    so_far, done, worst = Counter(), 0, 0
    for x in order:
        so_far[x.s] += x.length
        done += x.length
        worst = max([worst, *(abs(so_far[s] - total[s] * done / words) for s in total)])
    assert so_far == total and worst < 16 * 10
    # The points are van der Corput's, and blocks come in the order of their hashes.
    slots = {}
    for x in order:
        slots.setdefault(x.slot, (x.s, (x.start + x.first) // 16))
    bits, n = (-(-words // 16) - 1).bit_length(), -(-words // 16)
    for slot, (s, _) in slots.items():
        if slot < n:
            p = int(int(f"{slot:0{bits}b}"[::-1], 2) / (1 << bits) * words)
            assert s == (0 if p < total[0] else 1)
    for s in total:
        whole = sum(len(t.split()) for i, t, c in rows if c == "ab"[s]) // 16
        blocks = sorted(range(whole), key=lambda b: hashlib.md5(f"{s}:{b}".encode()).hexdigest())
        taken = [b for slot, (o, b) in sorted(slots.items()) if o == s and b < whole]
        assert taken[:whole] == blocks[: len(taken)]


def test_empty(spark):
    assert M.mixed(frame(spark, []).limit(0)).collect() == []
    only = M.mixed(frame(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert sorted(tuple(x) for x in only) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
