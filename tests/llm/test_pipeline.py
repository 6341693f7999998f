import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm.tokens import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    words = [f"word{k}" for k in range(3000)]
    items = [" ".join(f"item{i}x{k}" for k in range(30)) for i in range(3)]
    rows, labels, expected = [], [], {}
    for d in range(600):
        text = " ".join(r.choices(words, k=r.choice([30, 120, 500])))
        kind = r.choice(["clean"] * 6 + ["shout", "copy", "near", "leak", "mail"])
        result = text
        if kind == "shout":
            text, result = " ".join(w.upper() + "!!" for w in text.split()), None
        elif kind == "copy" and expected:
            text, result = rows[next(iter(expected))][1].upper().replace("WORD", "word"), None
        elif kind == "near" and expected:
            base = rows[max(expected, key=lambda e: len(rows[e][1]) if "mail" not in expected[e] and "[" not in expected[e] else 0)][1].split()
            text, result = " ".join(base + ["word5"]), None
        elif kind == "leak":
            text, result = f"{text} {r.choice(items).upper()}. {text}", None
        elif kind == "mail":
            text, result = f"{text} ann.lee@host.example.org {text}", f"{text} [EMAIL] {text}"
        rows.append((d, text, "en", "s", len(text)))
        labels.append((d, int(kind != "shout"), 0))
        if result is not None:
            expected[d] = result
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), expected


def test_run(spark, folder):
    path, expected = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in rows} == set(expected)
    encode = encoder()
    for d, text in expected.items():
        ids = np.array([*encode(text), 2], dtype="<u4")
        parts = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n, _ in parts] == [c for _, _, c in parts] and sum(n for _, n, _ in parts) == len(ids)


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    odd = [(None, "no id", "en", "s", 5), (1, None, None, None, None), (1, "twice", "en", "s", 5), (1, "twice", "en", "s", 5)]
    for docs in (spark.createDataFrame(odd, SCHEMA), spark.createDataFrame([], SCHEMA)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
