import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening as W


def brute(rows, components, scale=64, offset=1_000_000):
    """Deviations by rational arithmetic; eigenvalues and vectors by numpy, of the exact covariance."""
    own = [(i, tuple(math.floor(scale * c) + offset for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = defaultdict(list)
    for dim in {len(x) for _, x in own}:
        fitted = {x for _, x in own if len(x) == dim}
        n, sums = len(fitted), [sum(c) for c in zip(*fitted, strict=True)]
        mean = [Fraction(s, n) for s in sums]
        centred = [[a - m for a, m in zip(x, mean, strict=True)] for x in fitted]
        v = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(dim)] for i in range(dim)])
        e, q = np.linalg.eigh(v)
        for i, x in own:
            if len(x) == dim:
                deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
                y = np.array([float(a - m) for a, m in zip(x, mean, strict=True)])
                for k in range(min(components, dim)):
                    out[i].append((k + 1, n, deviation if deviation < 2**63 else None, y @ q[:, -1 - k] / math.sqrt(e[-1 - k]), e[-1 - k] / e.sum()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, n int, component string, x int")


@pytest.mark.parametrize("kind", ["plain", "offset", "graded"])
def test_matches_brute_force(spark, kind):
    r = random.Random(kind)
    wide = [1e6, 1e3, 10, 5, 2] if kind == "graded" else [4, 3, 2, 1.5, 1]
    make = lambda: [r.gauss(1e7 if kind == "offset" else 0, s) for s in wide]
    rows = [(i, make()) for i in range(150)]
    rows += [(900, rows[3][1]), (3, rows[5][1]), (None, rows[7][1]), (901, None), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [])]
    rows += [(1000 + i, [r.gauss(0, 1), r.gauss(0, 3)]) for i in range(20)]
    got = defaultdict(list)
    for x in W.whiten(frame(spark, rows).repartition(5), components=4).collect():
        got[x.vec_id].append((x.component, x.n, x.deviation, x.whitened, x.explained))
        assert x.identity_error < 1e-9
    want = brute(rows, 4)
    assert got.keys() == want.keys()
    for i, own in want.items():
        assert len(own) == len(got[i])
        if i == 3:  # the id is repeated
            continue
        near = 1e-4 if kind == "graded" else 1e-6  # the brute force's own error
        for a, b in zip(sorted(own), sorted(got[i]), strict=True):
            assert a[:3] == b[:3] and abs(a[3]) == pytest.approx(abs(b[3]), abs=near) and a[4] == pytest.approx(b[4], rel=near)


def test_signs_are_the_same_for_all_rows(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 6)) * [9, 7, 5, 3, 2, 1]
    rows = W.whiten(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), components=6).collect()
    w = np.zeros((300, 6))
    for row in rows:
        w[row.vec_id, row.component - 1] = row.whitened
    assert np.allclose(w.mean(axis=0), 0, atol=1e-9) and np.allclose(w.T @ w / 300, np.eye(6), atol=1e-9)


def test_products_of_large_integers_are_exact():
    r = random.Random(2)
    for size, kind in ((1 << 10, np.int64), (1 << 61, np.int64), (1 << 90, object)):
        y = np.array([[r.randrange(-size, size) for _ in range(3)] for _ in range(50)], dtype=kind)
        own = y.tolist()
        assert W.gram(y).tolist() == [[sum(a[i] * a[j] for a in own) for j in range(3)] for i in range(3)]


def test_small_eigenvalues_keep_their_precision():
    d = [10**18, 10**12, 10**7, 10**4]
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(4, 4)))[0]
    v = np.array([[round(sum(Fraction(q[i, k]) * Fraction(q[j, k]) * d[k] for k in range(4)) * 10**12) for j in range(4)] for i in range(4)], dtype=object)
    parts, vectors = W.eigen(v, 4)
    assert np.allclose(parts.astype(float) * sum(d), d, rtol=1e-4)
    assert np.allclose((vectors.T @ vectors).astype(float), np.eye(4), atol=1e-14)


def test_without_variance(spark):
    one = W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(x.vec_id, x.component, x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in sorted(one)] == [(i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)]
    flat = W.whiten(frame(spark, [(i, [float(i), 5.0, -float(i)]) for i in range(9)])).collect()
    assert all((x.whitened is None) == (x.component > 1) and x.identity_error < 1e-9 for x in flat) and len(flat) == 27
    large = W.whiten(frame(spark, [(1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [0.0, 4.0])])).collect()
    assert len(large) == 6 and all(x.deviation is None for x in large if x.vec_id < 3)
    assert W.whiten(frame(spark, []).limit(0)).collect() == []
    assert W.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
