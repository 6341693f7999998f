import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.tokens import encoder


def test_ids_are_those_of_the_tokenizer():
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoder()
    for text in ["", " ", "Plain words, don't!", "é ñ ß 漢字 🙂", "a<|endoftext|>b", "\n\n \t x", "0123 4567", "a" * 5000, " " * 3000 + "x", "\u0000‍"]:
        assert encode(text) == reference.encode(text, add_special_tokens=False).ids, text[:20]


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=40, deadline=None)
def test_plan_covers_every_piece(lengths):
    pieces = np.bincount(lengths, minlength=41)[1:] if lengths else np.zeros(40, dtype=int)
    made = packing.plan(pieces, 40)
    got = np.zeros(40, dtype=int)
    for c, n in made:
        assert sum(length * k for length, k in c) <= 40
        for length, k in c:
            got[length - 1] += n * k
    assert (got == pieces).all()
    assert sum(n for _, n in made) <= -(-sum(lengths) * 11 // (40 * 9)) + 6  # the guarantee of best fit decreasing


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        k = min(fits, key=lambda k: rooms[k], default=None)
        if k is None:
            rooms.append(capacity)
            k = len(rooms) - 1
        rooms[k] -= n
    return sorted(rooms)


@given(st.lists(st.integers(1, 40), max_size=150))
@settings(max_examples=60, deadline=None)
def test_best_fit_by_groups_is_best_fit(lengths):
    pieces = np.bincount(lengths, minlength=41)[1:] if lengths else np.zeros(40, dtype=int)
    made = packing.best_fit(pieces, 40)
    got = sorted(40 - sum(n * k for n, k in c) for c, times in made.items() for _ in range(times))
    assert got == plain_best_fit(lengths, 40)
    assert sum(n for _, n in packing.plan(pieces, 40)) <= len(got)


def test_the_program_covers_all_and_reaches_its_bound():
    r = np.random.default_rng(3)
    lengths = np.minimum(1 + r.gamma(1.5, 90, size=20_000).astype(int), 512)
    pieces = np.bincount(lengths, minlength=513)[1:]
    uses = packing.solve(pieces, 512, *packing.PRICES[0])
    covered = np.zeros(512)
    for c, x in uses.items():
        assert sum(n * k for n, k in c) <= 512
        for n, k in c:
            covered[n - 1] += k * x
    assert np.allclose(covered, pieces)
    bound = lengths.sum() / 512
    assert sum(uses.values()) <= bound * (1 + packing.GAP)
    assert sum(n for _, n in packing.plan(pieces, 512)) <= np.ceil(bound) + 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_no_more_sequences_than_best_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs).select("length", "sequence_id").toPandas()
    assert rows.sequence_id.nunique() <= len(plain_best_fit(rows.length.tolist(), 1024)) and rows.length.sum() / 1024 + 3 > rows.sequence_id.nunique()


def test_plan_reaches_the_optimum_where_pairs_fit():
    pieces = np.zeros(100, dtype=int)
    pieces[59], pieces[39], pieces[69], pieces[29] = 500, 500, 300, 300
    assert sum(n for _, n in packing.plan(pieces, 100)) == 800


@pytest.mark.parametrize("keep_ids", [False, True])
def test_pieces_are_lossless_and_gapless(spark, keep_ids):
    texts = [(1, "word " * 5000), (4, "Some long text. " * 60_000), (2, None), (3, ""), (3, "again"), (None, "no id"), *((k, "tok " * (k % 97)) for k in range(10, 300))]
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in texts], "doc_id long, text string, length int, start int")
    rows = packing.pack(docs, capacity=128, keep_ids=keep_ids).collect()
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for i, t in texts:
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 128 + 1
        bounds = [0, *range(head, len(ids) + 1, 128)]
        expected += [(i or -1, k, s, e - s, zlib.crc32(np.array(ids[s:e], dtype="<u4").tobytes())) for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False))]
        assert all(e - s == 128 for s, e in zip(bounds[1:], bounds[2:], strict=False))
    assert sorted((r.id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if keep_ids:
            assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
    assert sorted(at) == list(range(len(at)))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 128
    assert len(at) <= -(-sum(r.length for r in rows) // 128) + 2


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
