"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans to them.

The patterns give the base spans, which always stay. Around digits and at-signs the field scores whole candidate
segments: a segment of a kind has the sum of the weights of its features, which look at the segment as a whole
(shape, digits, check sum, parts) and at its surroundings; text outside of segments scores zero. Dynamic programming over
the ends of segments of bounded length finds the boundaries and kinds of the best set of disjoint segments, in
which the base spans are fixed. The weights maximise the conditional likelihood of made-up sentences, in which the
true spans are known; they are trained on the driver in a second or two and are the same on every run.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Within a run of digits only its beginning can begin an address: what would have to follow is the same for all of the run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, leftmost and disjoint within a kind, by kind and start. All take linear time."""
    out: list[Span] = []
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = m.end() if m else at + 1
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# The field.

#: Bounds of a segment, in tokens and characters.
MAX_TOKENS, MAX_CHARS = 24, 64
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
#: What any candidate holds: seven digits or more close together, or a written-out or plain at-sign.
_TRIGGER = re.compile(r"(?:[0-9][ ().\-/]{0,3}){6}[0-9]|@|[\[({<] ?(?:at|AT) ?[\])}>]")
_AT = re.compile(r"@|[\[({<] ?(?:at|AT) ?[\])}>]")
_EMAIL_LIKE = re.compile(r"[\w.%+-]+ ?(?:@|[\[({<] ?(?:at|AT) ?[\])}>]) ?[\w-]+(?: ?(?:\.|[\[({<] ?(?:dot|DOT) ?[\])}>]) ?[\w-]+)+")
#: Words before a span that tell of its kind.
CUES = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telephone"),
}


class _Segment:
    """What the features of a candidate look at, whatever its kind."""

    def __init__(self, text: str, start: int, end: int):
        s = text[start:end]
        self.text, self.digits = s, _digits(s)
        self.groups = re.findall(r"[0-9]+", s)
        separators = "".join(sorted(set(re.sub(r"[\w]", "", s))))
        before, after = text[max(0, start - 24) : start], text[end : end + 2]
        cue = re.findall(r"[A-Za-z]+", before)
        self.common = [
            "bias",
            f"digits={len(self.digits) if len(self.digits) < 20 else 20}",
            f"separators={separators[:6]}",
            f"plus={s[0] == '+'}",
            f"paren={'(' in s}{s.count('(') == s.count(')')}",
            f"first={s[0] if not s[0].isalnum() else 'a' if s[0].isalpha() else '0'}",
            f"letters={any(c.isalpha() for c in s)}",
            f"touch={before[-1:].isalnum() or before[-1:] in ('.', '-', '/', '+', '@', '_')}{after[:1].isalnum() or (after[:1] in ('.', '-', '/', '@', '_', ':') and after[1:].isalnum())}",
            f"cue={next((k for w in cue[-1:] for k, ws in CUES.items() if w.lower() in ws), '')}",
        ]

    def of(self, kind: str) -> list[str]:
        s, digits, groups = self.text, self.digits, self.groups
        if kind == "card":
            own = [f"luhn={13 <= len(digits) <= 19 and luhn(digits)}", f"fours={len(groups) > 1 and all(len(g) == 4 for g in groups[:-1])}"]
        elif kind == "ip":
            own = [f"octets={len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)}"]
        elif kind == "phone":
            own = [f"groups={'-'.join(str(len(g)) for g in groups[-4:]) if all(len(g) < 6 for g in groups) else 'long'}", f"luhn={len(digits) >= 13 and luhn(digits)}"]
        else:
            own = [f"form={bool(_EMAIL_LIKE.fullmatch(s))}", f"at={len(_AT.findall(s))}", f"written={'@' not in s}"]
        return [f"{kind}:{x}" for x in self.common + own]


def _candidates(text: str, begins: array, fixed: bytes) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """(first token, token after the last, kinds) of every segment that is scored, by its first token.

    begins: where each token begins, and the end of the text; fixed: 1 at characters of base spans.
    """
    n = len(begins) - 1
    taken = bytes(fixed.find(1, begins[i], begins[i + 1]) >= 0 for i in range(n))
    for i in range(n):
        start = begins[i]
        if taken[i] or not (text[start].isalnum() or text[start] in "+("):
            continue
        digits = has_at = letters = 0
        for j in range(i, min(n, i + MAX_TOKENS)):
            s, e = begins[j], begins[j + 1]
            if taken[j] or e - start > MAX_CHARS:
                break
            c = text[s]
            digits += (e - s) * ("0" <= c <= "9")
            letters += c.isalpha()
            has_at += c == "@" or text[s:e] in ("at", "AT")
            if "\n" in text[s:e]:
                break
            if not c.isalnum():
                continue
            kinds = ("ip", "card", "phone") if 7 <= digits <= 19 and not letters else ()
            if has_at and text[start].isalnum() and _AT.search(text, start, e):
                kinds += ("email",)
            if kinds:
                yield i, j + 1, kinds


def _begins(text: str) -> array:
    """Where the tokens begin, which leave nothing out, and the end of the text."""
    out = array("q", (m.start() for m in _TOKEN.finditer(text)))
    out.append(len(text))
    return out


def _windows(text: str) -> list[tuple[int, int]]:
    """Parts of the text that hold every candidate whole, with its surroundings; cut at white space where there is some."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MAX_CHARS - 30), min(len(text), m.end() + MAX_CHARS + 30)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


Segment = tuple[int, int, str, list[str]]


def _segments(text: str, fixed: bytes) -> tuple[array, list[Segment]]:
    """All candidates with their features; for sentences that the field is trained on."""
    begins, out = _begins(text), []
    for i, j, kinds in _candidates(text, begins, fixed):
        segment = _Segment(text, begins[i], begins[j])
        out += [(i, j, kind, segment.of(kind)) for kind in kinds]
    return begins, out


def _best(n: int, scored: Iterator[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The disjoint segments (begin, end, kind) of n tokens with the largest total; ties leave text outside, then go to the one found first.

    ``scored`` (begin, end, kind, score) comes by rising begin and none is kept: what is held are a few numbers a token.
    """
    best, ending = array("d", [0.0]) * (n + 1), array("d", [0.0]) * (n + 1)
    came, which = array("q", [-1]) * (n + 1), bytearray(n + 1)
    settled = 0
    for i, j, kind, score in scored:
        while settled < i:  # no segment that is yet to come ends here
            settled += 1
            best[settled] = max(best[settled - 1], ending[settled])
        if score > 0 and best[i] + score > ending[j]:
            ending[j], came[j], which[j] = best[i] + score, i, KINDS.index(kind)
    while settled < n:
        settled += 1
        best[settled] = max(best[settled - 1], ending[settled])
    out, j = [], n
    while j > 0:
        if ending[j] > best[j - 1]:
            out.append((came[j], j, KINDS[which[j]]))
            j = came[j]
        else:
            j -= 1
    return out[::-1]


def _found(text: str, fixed: bytes, weights: dict[str, float]) -> list[Span]:
    begins = _begins(text)

    def scored() -> Iterator[tuple[int, int, str, float]]:
        for i, j, kinds in _candidates(text, begins, fixed):
            segment = _Segment(text, begins[i], begins[j])
            for kind in kinds:
                yield i, j, kind, sum(weights.get(x, 0.0) for x in segment.of(kind))

    return [(kind, begins[i], begins[j]) for i, j, kind in _best(len(begins) - 1, scored())]


def added_spans(text: str, base: list[Span], weights: dict[str, float]) -> list[Span]:
    """Spans that the field finds beside the base spans."""
    out: list[Span] = []
    if not (windows := _windows(text)):
        return out
    fixed = bytearray(len(text))
    for _, s, e in base:
        fixed[s:e] = b"\1" * (e - s)
    for a, b in windows:
        out += [(kind, a + s, a + e) for kind, s, e in _found(text[a:b], bytes(fixed[a:b]), weights)]
    return out


def made_up(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Sentences with known spans in plain and disguised forms, among numbers that are none."""
    r = random.Random(seed)
    words = ["the", "order", "of", "and", "is", "paid", "on", "from", "with", "this", "was", "to", "for", "new"]

    def number(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = number(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", " ", "-", "."])
        return sep.join(d[k : k + 4] for k in range(0, 16, 4)) if sep else d

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+{number(2)} {number(3)} {number(3)} {number(3)}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}"])

    def email() -> str:
        name, host, top = r.choice(["jo", "ann.lee", "x_9", "info"]), r.choice(["mail", "example", "host7"]), r.choice(["com", "org", "net"])
        return r.choice([f"{name}@{host}.{top}", f"{name} [at] {host} [dot] {top}", f"{name} (at) {host}.{top}", f"{name}[at]{host}.{top}", f"{name} @ {host}.{top}"])

    def ip() -> str:
        return ".".join(str(r.randrange(256)) for _ in range(4))

    def none() -> str:
        return r.choice(
            [
                number(r.randrange(7, 20)),
                f"{number(4)}-{number(2)}-{number(2)} {number(2)}:{number(2)}",
                f"{r.randrange(300, 999)}.{number(3)}.{number(3)}.{number(3)}",
                f"{number(3)}.{number(2)}.{number(4)}.{number(1)}",
                f"{number(1)},{number(3)},{number(3)}",
                f"{number(3)}-{number(2)}-{number(5)}-{number(3)}",
                f"a{number(6)}f{number(9)}b",
                f"v{number(2)}.{number(3)}.{number(5)}",
                f"{number(5)} {number(5)}",
                f"{number(4)} {number(4)} {number(4)} {number(3)}",
                f"{number(3)} {number(3)} {number(4)}",
                "meet @ noon",
                "(at) home",
            ]
        )

    makers = {"card": card, "phone": phone, "email": email, "ip": ip}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randrange(1, 4)):
            text += " ".join(r.choices(words, k=r.randrange(1, 5))) + " "
            kind = r.choice([*KINDS, "", "", ""])
            if kind and r.random() < 0.4:
                text += r.choice(CUES[kind]) + r.choice([" ", ": "])
            made = makers[kind]() if kind else none()
            if kind:
                spans.append((kind, len(text), len(text) + len(made)))
            text += made + r.choice([" ", ". ", ", ", "\n"])
        out.append((text, spans))
    return out


def _log_add(x: float, y: float) -> float:
    return y if x == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))


@lru_cache(maxsize=2)
def trained(sentences: int = 400, rounds: int = 6, seed: int = 7) -> dict[str, float]:
    """Weights by stochastic ascent of the conditional log likelihood, by forward and backward sums over all sets of segments."""
    data = []
    for text, spans in made_up(sentences, seed):
        begins, segments = _segments(text, bytes(len(text)))
        data.append((len(begins) - 1, segments, [(k, begins[i], begins[j]) in spans for i, j, k, _ in segments]))
    weights: dict[str, float] = {}
    square: dict[str, float] = {}
    order = random.Random(seed)
    for _ in range(rounds):
        order.shuffle(data)
        for n, segments, truth in data:
            scores = [sum(weights.get(x, 0.0) for x in g[3]) for g in segments]
            ending: list[list[int]] = [[] for _ in range(n + 1)]
            beginning: list[list[int]] = [[] for _ in range(n + 1)]
            for k, g in enumerate(segments):
                ending[g[1]].append(k)
                beginning[g[0]].append(k)
            a, b = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
            for j in range(1, n + 1):
                a[j] = a[j - 1]
                for k in ending[j]:
                    a[j] = _log_add(a[j], a[segments[k][0]] + scores[k])
            for i in range(n - 1, -1, -1):
                b[i] = b[i + 1]
                for k in beginning[i]:
                    b[i] = _log_add(b[i], b[segments[k][1]] + scores[k])
            slope: dict[str, float] = {}
            for g, s, t in zip(segments, scores, truth, strict=True):
                x = t - math.exp(a[g[0]] + s + b[g[1]] - a[n])
                if abs(x) > 1e-4:
                    for f in g[3]:
                        slope[f] = slope.get(f, 0.0) + x
            for f, x in slope.items():
                square[f] = square.get(f, 0.0) + x * x
                weights[f] = weights.get(f, 0.0) * 0.9995 + 0.3 * x / math.sqrt(square[f] + 1e-6)
    return weights


def _in_order(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row, over its whole text.

    The counts and the digest are those of the base spans; ``spans`` holds those and the ones added. Offsets count
    code points. A null text is an empty one, whose digest is that of the empty string. Rows that repeat an id or have
    none stay.
    """
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans, added = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, weights)
                for kind, c in zip(KINDS, counts, strict=True):
                    c.append(sum(k == kind for k, _, _ in base))
                digests.append(hashlib.sha256(_in_order(base).encode()).hexdigest())
                spans.append(_in_order(base + more))
                added.append(len(more))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def masked(text: str, weights: dict[str, float]) -> str:
    """The text with every span replaced by its kind in capitals and brackets; of overlapping spans the union, named after the first."""
    base = base_spans(text)
    out, end, cut = [], 0, 0
    for kind, s, e in sorted(base + added_spans(text, base, weights), key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[cut:s], f"[{kind.upper()}]"]
        end = cut = max(end, e)
    return "".join(out) + text[cut:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text masked; null texts and the other columns stay as they are."""
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = pa.array([None if t is None else masked(t, weights) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, text_col, texts)

    return docs.mapInArrow(run, docs.schema)
