import hashlib
import itertools
import random
import tracemalloc
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@given(st.text(alphabet="019.@+-_ ()ab%é\n", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_luhn_and_long_texts():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans("9" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []
    assert pii.base_spans("x 4111 1111-1111 1111 y") == [("card", 2, 21)]
    assert len(pii.base_spans("a@b.co " * 5000)) == 5000


def test_dynamic_program_finds_the_best_set():
    r = random.Random(1)
    for _ in range(200):
        n = r.randrange(1, 9)
        segments = []
        for k in range(r.randrange(7)):
            i = r.randrange(n)
            segments.append((i, r.randrange(i + 1, n + 1), "ip", [f"f{k}"]))
        weights = {f"f{k}": r.randrange(-3, 9) for k in range(7)}
        best = max(
            sum(weights[g[3][0]] for g in some)
            for m in range(len(segments) + 1)
            for some in itertools.combinations(segments, m)
            if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(some, 2))
        )
        scored = [(i, j, kind, weights[f]) for i, j, kind, (f,) in sorted(segments)]
        found = pii._best(n, iter(scored))
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(found))
        assert sum(max(s for i, j, k, s in scored if (i, j, k) == g) for g in found) == best


def test_long_numeric_text_takes_little_memory():
    r = random.Random(4)
    weights = pii.trained()
    for size in (20_000, 60_000):
        text = " ".join(str(r.randrange(10 ** r.randrange(1, 9))) for _ in range(size // 5))
        base = pii.base_spans(text)
        tracemalloc.start()
        spans = pii.added_spans(text, base, weights)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # So 5 MB stay under 300 MB.
        assert peak < 60 * len(text) and spans, peak / len(text)
        assert all(a[2] <= b[1] for a, b in itertools.pairwise(sorted(spans, key=lambda x: x[1])))


def test_held_out_sentences():
    weights = pii.trained()
    right = found = true = 0
    for text, spans in pii.made_up(400, seed=99):
        base = pii.base_spans(text)
        got = {*base, *pii.added_spans(text, base, weights)}
        right, found, true = right + len(got & {*spans}), found + len(got), true + len(spans)
    assert right / found > 0.95 and right / true > 0.93, (right / found, right / true)


def test_query(spark):
    text = "é a.b@c.de, 10.0.0.256 10.0.0.1 +1 (017) 555-7713 call 555-123-4567 now"
    rows = [(1, text), (2, None), (3, ""), (None, text), (1, text), (4, "clean words only " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, n_ip int")
    got = {(r.id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii.find(docs).collect()}
    base = "email:2:10,ip:23:31,phone:32:49"
    digest, nothing = hashlib.sha256(base.encode()).hexdigest(), hashlib.sha256(b"").hexdigest()
    spans = base + ",phone:55:67"
    assert got == {(1, 1, 1, 0, 1, digest, spans), (None, 1, 1, 0, 1, digest, spans), (2, 0, 0, 0, 0, nothing, ""), (3, 0, 0, 0, 0, nothing, ""), (4, 0, 0, 0, 0, nothing, "")}
    out = {(r.doc_id, r.text) for r in pii.redact(docs).where("doc_id < 4").collect()}
    assert out == {(1, "é [EMAIL], 10.0.0.256 [IP] [PHONE] call [PHONE] now"), (2, None), (3, "")}
    assert pii.redact(docs).columns == docs.columns
    assert pii.find(docs.limit(0)).collect() == []
