import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tidemark.llm import unigram as U


@pytest.fixture(scope="module")
def v():
    return U.vocabulary()


def reference(v):
    vocab = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *zip(v.pieces, v.scores, strict=True)]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=U.MARK, prepend_scheme="always", split=True)
    return t


TEXTS = ["", " ", "a", "  two  spaces ", "Hello world, this is text.\nNew line", "éàü ñ ß 漢字 🙂🙂 \x00", "aaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, "▁mark ▁ inside▁it", "12 3456 7.8%", "<0x0A> <unk>"]


def test_counts_are_those_of_the_reference_tokenizer(spark, v):
    r = random.Random(5)
    letters = "abcdefghijklmnop etaoin éß\n.%1漢"
    texts = TEXTS + ["".join(r.choices(letters, k=r.randrange(200))) for _ in range(300)]
    t = reference(v)
    rows = [(i, x) for i, x in enumerate(texts)] + [(None, "no id"), (3, "again"), (9000, None)]
    got = U.count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    literal = {i for i, x in rows if x and ("<0x" in x or "<unk>" in x)}
    assert sorted((x.id or -1, x.n_tokens) for x in got if x.id not in literal) == sorted((i or -1, len(t.encode(x or "").ids)) for i, x in rows if i not in literal)
    assert U.count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def segmentations(segment, lattice):
    for cuts in itertools.product([0, 1], repeat=len(segment) - 1):
        bounds = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(segment)]
        p = 1.0
        for s, e in zip(bounds, bounds[1:], strict=False):
            part = segment[s:e]
            if part in index(lattice):
                p *= lattice.p[index(lattice)[part]]
            elif len(part) == 1:
                p *= lattice.unknown * 256.0 ** -len(part.encode())
            else:
                p = 0.0
        yield p, [segment[s:e] for s, e in zip(bounds, bounds[1:], strict=False)]


def index(lattice, kept={}):
    if not kept:
        kept.update({p: k for k, p in enumerate(lattice.v.pieces)})
    return kept


def test_lattice_sums_over_all_segmentations(v, monkeypatch):
    lattice = U.Lattice.prior(v)
    assert math.isclose(sum(lattice.p) + lattice.unknown + lattice.end, 1.0)
    for part in (U.Lattice.PART, 3):
        monkeypatch.setattr(U.Lattice, "PART", part)
        for word in ["the", "a", "thering", "é漢x", "zzq", ""]:
            every = list(segmentations(U.MARK + word, lattice))
            total = sum(p for p, _ in every)
            assert math.isclose(lattice.log_probability(word), math.log(total), rel_tol=1e-9)
            expected, got = Counter(), [0.0] * (len(lattice.p) + 1)
            for p, parts in every:
                for x in parts:
                    expected[index(lattice).get(x, -1)] += 3 * p / total
            lattice.expect(word, 3, got)
            assert all(math.isclose(got[k], x, rel_tol=1e-9, abs_tol=1e-12) for k, x in expected.items())
    monkeypatch.undo()
    into = [0.0] * (len(lattice.p) + 1)
    lattice.expect("ab漢" * 5000, 1, into)
    assert math.isclose(into[-1], 5000, rel_tol=1e-6) and -1e6 < lattice.log_probability("ab漢" * 5000) < -1e4


def test_all_segmentations_of_whole_texts(spark, v):
    texts = ["a bc", "the de", "Ab  c", "", "é x", "漢 a"]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string")
    training = [t for d, t in enumerate(texts * 3) if not U.held_out(d)]
    words = U.word_counts(spark.createDataFrame([(t,) for t in training], "text string"))
    lattice = U.Lattice(v, *U.learn(words, len(training)))
    # Learning, by enumeration: expected uses under the vocabulary's own scores.
    prior, uses = U.Lattice.prior(v), Counter()
    for t in training:
        for w in t.lower().split():
            every = list(segmentations(U.MARK + w, prior))
            total = sum(p for p, _ in every)
            for p, parts in every:
                for x in parts:
                    uses[index(prior).get(x, -1)] += p / total
    weight = len(v.pieces)
    total = sum(uses.values()) + len(training) + weight
    for x in ("▁", "a", "▁the", "de", "▁de", "bc"):
        k = index(prior)[x]
        assert math.isclose(lattice.p[k], (uses[k] + weight * prior.p[k]) / total, rel_tol=1e-6), x
    assert math.isclose(lattice.unknown, (uses[-1] + weight * prior.unknown) / total, rel_tol=1e-6) and math.isclose(lattice.end, (len(training) + weight * prior.end) / total, rel_tol=1e-6)
    for r in U.score(docs).collect():
        text = "".join(U.MARK + w for w in (texts * 3)[r.id].lower().split())
        want = sum(p for p, _ in segmentations(text, lattice)) * lattice.end if text else lattice.end
        assert math.isclose(r.score, math.log10(want), rel_tol=1e-9), (r, text)


@pytest.mark.parametrize("frequent", [0, 5, 50_000])
def test_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(U, "FREQUENT_WORDS", frequent)
    r = random.Random(2)
    stems = ["the", "of", "thering", "Onan", "whist", "élan", "x9", "tion"]
    rows = [(d, " ".join(r.choice(stems) + r.choice(["", "", "s", "ed", "%%"]) for _ in range(r.randrange(60)))) for d in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "\x85 a\x1cb \t\n c"), (7, "the same id"), (None, "no id"), (1003, "y" * 40_000)]
    got = U.score(spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, n int, word string")).collect()
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    counts = Counter(w for (d, _), ws in zip(rows, tokens, strict=True) if not U.held_out(d) for w in ws)
    n, distinct = sum(counts.values()), len(counts)
    expected = sorted(
        (d or -1, U.held_out(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (distinct + 1))) for w in ws), 6))
        for (d, _), ws in zip(rows, tokens, strict=True)
    )
    assert sorted((x.id or -1, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == expected
    training = [(t,) for d, t in rows if not U.held_out(d)]
    lattice = U.Lattice(U.vocabulary(), *U.learn(U.word_counts(spark.createDataFrame(training, "text string")), len(training)))
    mine = sorted((d or -1, (sum(lattice.log_probability(w.decode()) for w in ws[:-1]) + math.log(lattice.end)) / math.log(10)) for (d, _), ws in zip(rows, tokens, strict=True))
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], abs_tol=1e-4) for a, b in zip(sorted((x.id or -1, x.score) for x in got), mine, strict=True))
    assert np.isfinite([x.score for x in got]).all()


def test_empty(spark):
    assert U.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_most_frequent_words(spark, monkeypatch):
    counts = spark.createDataFrame([(f"w{k}".encode(), n) for k, n in enumerate((900, 500, 90, 90, 7, 1, 1))] + [(b"x" * 70, 10_000)], "word binary, n long")
    for most, found in ((7, 7), (6, 5), (4, 4), (3, 2), (0, 0)):
        monkeypatch.setattr(U, "FREQUENT_WORDS", most)
        assert sorted(bytes(r.word) for r in U.most_frequent(counts).collect()) == [f"w{k}".encode() for k in range(found)]
