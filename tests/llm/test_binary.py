import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import binary, queries
from tidemark.llm.tokens import encoder


@given(st.lists(st.integers(1, 30), max_size=80))
@settings(max_examples=100, deadline=None)
def test_best_fit_decreasing(lengths):
    rooms, expected = [], []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= lengths[k]]
        room = min(fits)[0] if fits else None
        if room is None:
            rooms.append(30 - lengths[k])
        else:
            rooms[next(b for x, b in fits if x == room)] -= lengths[k]
    got = binary.best_fit_decreasing(lengths, 30)
    assert sorted(k for b in got for k in b) == list(range(len(lengths)))
    assert sorted(30 - sum(lengths[k] for k in b) for b in got) == sorted(rooms)


def test_round_trip(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(binary, "WINDOW", 3000)
    r = random.Random(4)
    rows = [(d, " ".join(r.choices(["alpha", "be", "gamma's", "Ω"], k=r.choice([0, 3, 40, 700])))) for d in range(120)]
    rows += [(900, None), (None, "no id"), (901, "twice"), (902, "last")]
    docs = spark.createDataFrame([(d, t, b"x") for d, t in rows], "doc_id long, text string, ids binary")
    binary.write(binary.packed(docs, capacity=128, pad_id=7), str(tmp_path / "out"))
    lines = spark.read.parquet(str(tmp_path / "out")).collect()
    parts = {}
    for x in lines:
        ids, places = np.frombuffer(x.ids, dtype="<u4"), np.frombuffer(x.positions, dtype="<i4")
        assert len(ids) == len(places) == 128 and (ids[x.n_tokens :] == 7).all() and x.cu_seqlens[-1] == x.n_tokens
        assert zlib.crc32(ids[: x.n_tokens].tobytes()) == x.ids_crc32
        for d, start, s, e in zip(x.doc_ids, x.starts, x.cu_seqlens, x.cu_seqlens[1:], strict=False):
            assert (places[s:e] == np.arange(e - s)).all()
            assert (d, start) not in parts
            parts[d, start] = ids[s:e].tolist()
    encode = encoder()
    for d, t in rows:
        whole, start = [], 0
        while (d, start) in parts:
            whole += parts.pop((d, start))
            start = len(whole)
        assert whole == [*encode(t or ""), 50256]
    assert not parts and len({x.sequence_id for x in lines}) == len(lines)


def test_query_has_positions(spark, tmp_path):
    rows = [(d, "alpha be gamma's " * n) for d, n in enumerate([1, 30, 400, 3000])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lines = queries.op5_packed_ids(spark, str(tmp_path)).collect()
    assert lines
    for x in lines:
        places = np.frombuffer(x.positions, dtype="<i4")
        assert len(places) * 4 == len(x.ids)
        bounds = [*x.cu_seqlens, len(places)]
        assert all((places[s:e] == np.arange(e - s)).all() for s, e in zip(bounds, bounds[1:], strict=False))


def test_empty(spark):
    assert binary.packed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
