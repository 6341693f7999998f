"""Unigram pieces: count-only Viterbi, and the likelihood of a text over the lattice of its segmentations.

The vocabulary is an existing one (pieces with scores); pieces of it that occur in a text are enumerated by an
Aho-Corasick automaton. A white space mark, the first character of a word, occurs in no piece past its first place, so the
best or the summed segmentation of a text is put together from those of its words, which are kept.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteBound, cut

MARK = "▁"


class Vocabulary:
    """Pieces and scores of a sentencepiece file; its byte pieces stand for characters that have no piece."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        whole = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = [sp.id_to_piece(i) for i in whole]
        self.scores = [sp.get_score(i) for i in whole]
        # Runs of marks are split by the mark rule before any piece is looked up.
        usable = [k for k, p in enumerate(self.pieces) if MARK not in p[1:]]
        self.pieces, self.scores = [self.pieces[k] for k in usable], [self.scores[k] for k in usable]
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(self.pieces):
            self.automaton.add_word(p, (len(p), k, self.scores[k]))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.pieces))
        self.singles = {p for p in self.pieces if len(p) == 1}
        #: A character without a piece scores this much, 10 below the worst piece.
        self.unknown = min(self.scores) - 10.0


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> Vocabulary:
    return Vocabulary(path)


class PieceCounts(ByteBound):
    """word -> number of pieces in its best segmentation.

    Ties go to the piece that begins first, as where candidates are taken in the order of their beginnings and a later one has
    to score more. A character without a piece counts as its UTF-8 bytes.
    """

    LIMIT = 150_000_000

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v = v

    def __missing__(self, word: str) -> int:
        v, segment = self.v, MARK + word
        singles, unknown = v.singles, v.unknown
        n, at = len(segment), 1
        best, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for last, (length, _, score) in v.automaton.iter(segment):
            end = last + 1
            while at < end:
                if segment[at - 1] not in singles and best[at - 1] + unknown > best[at]:
                    best[at], count[at] = best[at - 1] + unknown, count[at - 1] + len(segment[at - 1].encode())
                at += 1
            # Longest first, that is in the order of their beginnings.
            total = best[end - length] + score
            if total > best[end]:
                best[end], count[end] = total, count[end - length] + 1
        while at <= n:
            if segment[at - 1] not in singles and best[at - 1] + unknown > best[at]:
                best[at], count[at] = best[at - 1] + unknown, count[at - 1] + len(segment[at - 1].encode())
            at += 1
        return self.keep(word, count[n])


_counts: dict[str | None, PieceCounts] = {}


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row: pieces of the best segmentation of its whole text.

    Spaces become marks and one is put in front unless there is one. An empty or null text has no tokens. Rows that
    repeat an id, or have none, stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts.get(path) or _counts.setdefault(path, PieceCounts(vocabulary(path)))
        for b in batches:
            out = []
            for value in b.column(1):
                text = (value.as_py() or "").replace(MARK, " ")
                out.append(sum(map(counts.__getitem__, text.removeprefix(" ").split(" "))) if text else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_tokens long")


class Lattice:
    """Probabilities of pieces, of a character without a piece and of the end of a text; they sum up to one.

    A text is a sequence of pieces and its end. The probability of a text is the sum over all its segmentations; no piece goes
    past the white space mark that a word begins with, so its logarithm is the sum of those of its words and of the end.
    """

    #: Places whose edges are held at once on the way back through a word.
    PART = 4_096

    def __init__(self, v: Vocabulary, pieces: np.ndarray, unknown: float, end: float):
        total = pieces.sum() + unknown + end
        self.v, self.p, self.logs = v, (pieces / total).tolist(), np.log(pieces / total).tolist()
        self.unknown, self.end = unknown / total, end / total

    @classmethod
    def prior(cls, v: Vocabulary) -> Lattice:
        """From the vocabulary's scores: these are falling ranks, which Mandelbrot's law turns into probabilities."""
        rank = max(v.scores) - np.array(v.scores)
        weight = 1.0 / (rank + 10.0)
        return cls(v, weight, weight.sum() * 1e-4, weight.sum() * 1e-3)

    def byte(self, character: str) -> float:
        """Logarithm of the probability of a character without a piece, by its bytes."""
        return math.log(self.unknown) - len(character.encode()) * math.log(256.0)

    def edges(self, segment: str, after: int, to: int) -> Iterator[tuple[int, int, int, float]]:
        """(begin, end, piece or -1, log probability) of the edges that end past ``after``, up to ``to``, by rising end."""
        at, logs, singles = after + 1, self.logs, self.v.singles
        for last, (length, k, _) in self.v.automaton.iter(segment, max(0, after + 1 - self.v.longest), to):
            end = last + 1
            if end <= after:
                continue
            while at < end:
                if segment[at - 1] not in singles:
                    yield at - 1, at, -1, self.byte(segment[at - 1])
                at += 1
            yield end - length, end, k, logs[k]
        for end in range(at, to + 1):
            if segment[end - 1] not in singles:
                yield end - 1, end, -1, self.byte(segment[end - 1])

    def forward(self, segment: str) -> list[float]:
        """Natural logarithm of the sum over all segmentations, up to each place."""
        exp, log1p, none, logs, singles = math.exp, math.log1p, -math.inf, self.logs, self.v.singles
        a = [none] * (len(segment) + 1)
        a[0] = 0.0
        # Where every character is a piece there are no other edges.
        at, to = (1, len(segment)) if not singles.issuperset(segment) else (len(segment) + 1, 0)
        for last, (length, k, _) in self.v.automaton.iter(segment):
            end = last + 1
            while at < end:
                if segment[at - 1] not in singles:
                    a[at] = a[at - 1] + self.byte(segment[at - 1])
                at += 1
            x, y = a[end], a[end - length] + logs[k]
            if x == none:
                a[end] = y
            else:
                a[end] = x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
        for end in range(at, to + 1):
            if segment[end - 1] not in singles:
                a[end] = a[end - 1] + self.byte(segment[end - 1])
        return a

    def log_probability(self, word: str) -> float:
        return self.forward(MARK + word)[-1]

    def expect(self, word: str, n: float, into: list[float]) -> None:
        """Adds the expected uses of pieces in ``n`` occurrences of a word; those without a piece go last."""
        segment = MARK + word
        size = len(segment)
        if size < 40:
            # Edges of a short word, and products that can't underflow before it is seen to.
            edges = [(last + 1 - length, last + 1, k, self.p[k]) for last, (length, k, _) in self.v.automaton.iter(segment)]
            if not self.v.singles.issuperset(segment):
                edges += [(at, at + 1, -1, math.exp(self.byte(c))) for at, c in enumerate(segment) if c not in self.v.singles]
                edges.sort(key=lambda e: e[1])
            forward, back = [1.0] + [0.0] * size, [0.0] * size + [1.0]
            for begin, end, _, p in edges:
                forward[end] += forward[begin] * p
            if forward[size] > 1e-250:
                scale = n / forward[size]
                for begin, end, k, p in reversed(edges):
                    x = p * back[end]
                    back[begin] += x
                    into[k] += scale * forward[begin] * x
                return
        a = array("d", self.forward(segment))
        b = array("d", [-math.inf]) * (size + 1)
        b[size] = 0.0
        exp, log1p, none, whole = math.exp, math.log1p, -math.inf, a[size]
        for to in range(size, 0, -self.PART):
            for begin, end, k, p in reversed(list(self.edges(segment, max(0, to - self.PART), to))):
                x, y = b[begin], p + b[end]
                if x == none:
                    b[begin] = y
                else:
                    b[begin] = x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
                into[k] += n * exp(a[begin] + y - whole)


class WordScores(ByteBound):
    """word as bytes -> natural logarithm of its probability over the lattice."""

    LIMIT = 150_000_000

    def __init__(self, lattice: Lattice):
        super().__init__()
        self.lattice = lattice

    def __missing__(self, word: bytes) -> float:
        return self.keep(word, self.lattice.log_probability(word.decode()))


#: Most frequent training words, of so many bytes at most, whose counts are sent to every task (under 4 MB); those of the others are joined.
FREQUENT_WORDS, FREQUENT_BYTES = 50_000, 64


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n long) over all rows; each batch is counted before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for t in b.column(0):
                n.update((t.as_py() or "").encode().lower().split())
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64())], ["word", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame) -> DataFrame:
    """The words of ``counts`` above a frequency that at most FREQUENT_WORDS have, none longer than FREQUENT_BYTES.

    The frequency is found on a histogram of eight steps an octave, so that no task sees the words of all others.
    """
    short = counts.where(F.length("word") <= FREQUENT_BYTES).withColumn("step", F.floor(F.log2("n") * 8))
    held, least = 0, None
    for step, n in sorted(short.groupBy("step").agg(F.count("*")).collect(), reverse=True):
        held += n
        if held > FREQUENT_WORDS:
            break
        least = step
    return short.where(F.col("step") >= least if least is not None else F.lit(False)).select("word", "n")


def learn(words: DataFrame, n_docs: int, path: str | None = None, rounds: int = 1) -> tuple[np.ndarray, float, float]:
    """Probabilities of pieces, of characters without one and of the end, from their expected uses in all training texts.

    The vocabulary's scores weight the segmentations of every counted word (expectation), and stay as a prior of as many pieces as the
    vocabulary has (maximisation). Only sums by piece leave the tasks: as many numbers as there are pieces.
    """
    v = vocabulary(path)
    lattice = prior = Lattice.prior(v)
    weight = float(len(v.pieces))
    for _ in range(rounds):
        state = (np.array(lattice.p), lattice.unknown, lattice.end)

        def run(batches: Iterator[pa.RecordBatch], state: tuple = state) -> Iterator[pa.RecordBatch]:
            own = Lattice(vocabulary(path), *state)
            into = [0.0] * (len(own.p) + 1)
            for b in batches:
                for word, n in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    own.expect(word.as_py().decode(), n, into)
            some = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.array(into)[some])], ["k", "x"])

        uses = np.zeros(len(v.pieces) + 1)
        for k, x in words.select("word", "n").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x")).collect():
            uses[k] = x
        # The last of ``into`` is that of the characters without a piece.
        lattice = Lattice(v, uses[:-1] + weight * np.array(prior.p), uses[-1] + weight * prior.unknown, n_docs + weight * prior.end)
    return np.array(lattice.p), lattice.unknown, lattice.end


def score(docs: DataFrame, path: str | None = None, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32 of the id as text leaves 1 by 5 are held out; all others are learnt from. A null text is empty and
    has one token, its end; a null id counts as an empty text. Rows that repeat an id are scored and learnt from like
    any other. base_score is that of single words with half a count added; score is the log10 probability of the text, over all
    segmentations into pieces.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    held_out = (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 5) == 1
    training = source.where(~held_out)
    counts = cut(word_counts(training))
    n_docs = training.count()
    row = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = (row[0] or 0) + n_docs, row[1] + (n_docs > 0)
    below = math.log10(total + 0.5 * (distinct + 1))
    state = learn(counts, n_docs, path, rounds)
    frequent = most_frequent(counts).toArrow()
    known = dict(zip(frequent.column("word").to_pylist(), (math.log10(n + 0.5) - below for n in frequent.column("n").to_pylist()), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast((state, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (p, unknown, end), known = shared.value
        lattice = Lattice(vocabulary(path), p, unknown, end)
        scores = WordScores(lattice)
        end_base, end_score, ten = math.log10(n_docs + 0.5) - below, math.log(lattice.end), math.log(10)
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for value in b.column(1):
                words = (value.as_py() or "").encode().lower().split()
                base, found, n_known = [end_base], [end_score], n_docs > 0
                rare, times = [], []
                for w, n in Counter(words).items():
                    found.append(n * scores[w])
                    x = known.get(w)
                    if x is None:
                        rare.append(w)
                        times.append(n)
                    else:
                        base.append(n * x)
                        n_known += n
                for c, x in zip(cols, (len(words) + 1, int(n_known), math.fsum(base), math.fsum(found) / ten, rare, times), strict=True):
                    c.append(x)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *arrays], ["id", "row", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times"])

    numbered = source.select("id", "text", F.monotonically_increasing_id().alias("row"), held_out.alias("held_out"))
    schema = "id long, row long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<binary>, times array<int>"
    found = cut(numbered.mapInArrow(run, schema))

    # The other words meet their counts; those that no training row has are left without one.
    rare = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r"))
    rare = rare.select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times")).join(counts, "word", "left")
    more = rare.groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - below)).alias("more_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    whole = found.select("id", "row", "held_out", "n_tokens", "n_known", "base", "score").join(more, "row", "left")
    zero = F.lit(0)
    return whole.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        "score",
    )


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1
