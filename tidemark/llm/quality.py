"""Quality filter by importance resampling of hashed n-grams.

Words, pairs of words and shapes of words (case, digits, marks, whether it repeats the last one) are hashed into buckets.
A generative model gives the rate at which documents hold each. The target is the text labelled good and not toxic; raw text is modelled
by kind, as toxic and as poor text, since a document is raw in either way. The target's rates are smoothed by that
of the whole corpus. A raw kind has the rates of the target but in the buckets in which its counts depart from it
significantly; so the thousands of rare words of a long document do not add up to a verdict. The weight of a document is its
smallest log ratio of target to raw probability. Documents are sampled without replacement in proportion to their
weights: Gumbel noise is added and the k largest are kept. k is the number of documents that the weights expect to
come from the target.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteBound, cut

#: Buckets of each of the two tables of words and of pairs of words; of shapes, of pairs of shapes and of shapes with the share
#: of words that have them.
WORDS, SHAPES = 1 << 16, 1 << 12
SIZE = 4 * WORDS + 3 * SHAPES
CORPUS, TARGET, TOXIC, POOR = range(4)
#: Evidence for the target from all that a document lacks, at most: buckets of one kind of text go together.
MOST_LACKED = 4.5
#: Labelled rows that a model is fitted to at most, taken in the order of a hash.
LABELLED_ROWS = 100_000
#: Weight of the corpus in the target's model, and of the target in a raw kind's, as a multiple of its own documents.
PULL = 0.02
#: A raw kind's count of a bucket departs from the target beyond so many standard deviations and rows.
DEVIATIONS, LEAST = 4.0, 2.0
#: It also has to be so many times the target's rate, and so many of the kind's documents have to hold the bucket. Small
#: differences over the thousands of words of a long document, and the words of one passage that is copied a lot, say nothing of its kind.
TIMES, HELD_BY = 3.0, 0.01
KEY = "__tidemark_key"


def shape(word: bytes) -> tuple[bytes, bytes]:
    """(the word without marks around it, its shape: case, whether it has digits, and the marks at its end)."""
    text = word.decode(errors="replace")
    marks = "".join({c for c in text if not c.isalnum()})
    core = text.rstrip(marks)
    letters = [c for c in core if c.isalpha()]
    case = b"-" if not letters else b"U" if len(letters) > 1 and all(c.isupper() for c in letters) else b"l"
    digits = b"d" if any(c.isdigit() for c in core) else b""
    return (core.lstrip(marks).lower() or text).encode(), case + digits + text[len(core) :].encode()[-3:]


class Buckets(ByteBound):
    """word -> 32 bits of the word's hash, then 16 bits for the bucket of its shape."""

    LIMIT = 100_000_000

    def __missing__(self, word: bytes) -> int:
        core, form = shape(word)
        own = xxhash.xxh64_intdigest(core, 11) & 0xFFFFFFFF
        return self.keep(word, own << 16 | xxhash.xxh64_intdigest(form, 12) % (SHAPES // 2))


_buckets = Buckets()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text: one long or repetitive document must not outweigh the others of its class.

    Each feature has a bucket in two tables, the same one for shapes. Two features that share one rarely share the other.
    """
    words = text.encode().split() if text else []
    both = np.fromiter(map(_buckets.__getitem__, words), dtype=np.int64, count=len(words))
    own, form = both >> 16, both & 0xFFFF
    again = np.concatenate(([False], own[1:] == own[:-1])) if len(words) else np.zeros(0, dtype=bool)
    counts = np.bincount(form + again * (SHAPES // 2), minlength=SHAPES)
    kinds = np.flatnonzero(counts)
    shares = (kinds * 1571 + np.ceil(-2 * np.log2(counts[kinds] / max(1, len(words)))).astype(np.int64) * 97 + 5) % SHAPES
    forms = np.flatnonzero(np.bincount((form[:-1] * 2477 + form[1:] * 883 + 3) % SHAPES, minlength=SHAPES))
    shapes = np.concatenate((kinds, SHAPES + forms, 2 * SHAPES + shares)) + 4 * WORDS
    single = np.unique(own)
    pairs = np.unique(((own[:-1] * 0x9E3779B1 + own[1:]) * 0x85EBCA6B) >> 8 & 0xFFFFFFFF)
    first = np.concatenate((single & 0xFFFF, 2 * WORDS + (pairs & 0xFFFF), shapes))
    second = np.concatenate((WORDS + (single >> 16), 3 * WORDS + (pairs >> 16), shapes))
    return first, second


def classes(labels: DataFrame) -> DataFrame:
    """(doc_id, class) of at most LABELLED_ROWS labelled documents. Of several labels of one the worst counts; incomplete ones don't."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    kind = F.when(F.col("toxic") > 0, TOXIC).when(F.col("quality") <= 0, POOR).otherwise(TARGET)
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS).select("doc_id", kind.alias("class"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log ratios of target to toxic and to poor text: by bucket that a document holds, and for what it lacks; and the
    log of these kinds' shares of the labelled rows by the target's."""
    label = F.broadcast(classes(labels).withColumnRenamed("doc_id", "labelled"))
    source = docs.select("doc_id", "text").join(label, F.col("doc_id") == F.col("labelled"), "left").select("text", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros((4, SIZE), dtype=np.int64), np.zeros(4, dtype=np.int64)
        for b in batches:
            held: list[list[np.ndarray]] = [[] for _ in range(4)]
            waiting = 0
            for text, kind in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                first, second = features(text.as_py())
                found = np.concatenate((first, second[second < 4 * WORDS]))
                kind = kind or CORPUS
                rows[kind] += 1
                held[kind].append(found)
                waiting += len(found)
                if waiting > 2_000_000:
                    for k, x in enumerate(held):
                        counts[k] += np.bincount(np.concatenate(x), minlength=SIZE) if x else 0
                    held, waiting = [[] for _ in range(4)], 0
            for k, x in enumerate(held):
                counts[k] += np.bincount(np.concatenate(x), minlength=SIZE) if x else 0
        kind, bucket = np.nonzero(counts)
        kinds, buckets, n = np.concatenate((kind, np.arange(4))), np.concatenate((bucket, np.full(4, SIZE))), np.concatenate((counts[kind, bucket], rows))
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(buckets), pa.array(n)], ["kind", "bucket", "n"])

    counts = np.zeros((4, SIZE + 1))
    found = source.mapInArrow(run, "kind long, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("kind").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    rows, counts = counts[:, SIZE], counts[:, :SIZE]
    every = (counts.sum(axis=0) + 1e-3) / (rows.sum() + 1)
    target = (counts[TARGET] + (PULL * rows[TARGET] + 1e-6) * every) / (rows[TARGET] * (1 + PULL) + 1e-6)
    held, lacked = np.zeros((2, SIZE)), np.zeros((2, SIZE))
    for k, kind in enumerate((TOXIC, POOR)):
        expected = rows[kind] * target
        departs = counts[kind] - expected > DEVIATIONS * np.sqrt(expected + 1) + LEAST
        departs &= (counts[kind] > TIMES * expected) & (counts[kind] > HELD_BY * rows[kind])
        raw = (counts[kind] + PULL * expected + 1e-6 * target) / (rows[kind] * (1 + PULL) + 1e-6)
        held[k] = np.where(departs, np.log(target) - np.log(raw), 0.0)
        lacked[k] = np.where(departs, np.log1p(-np.minimum(target, 0.99)) - np.log1p(-np.minimum(raw, 0.99)), 0.0)
    odds = np.log((rows[[TOXIC, POOR]] + 0.5) / (rows[TARGET] + 0.5))
    return held, np.minimum(lacked.sum(axis=1), MOST_LACKED), odds


def _noise(ids: np.ndarray) -> np.ndarray:
    """Gumbel noise from a hash of the id."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return -np.log(-np.log(((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53))


def weigh(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` with three columns more: log weight, sampling key and probability of the target."""
    ratios, none, odds = docs.sparkSession.sparkContext.broadcast(model[0]), *model[1:]
    names = [f"{KEY}_{x}" for x in ("weight", "key", "target")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratios.value
        for b in batches:
            # Evidence is at most zero; of the two buckets of a feature the one with less counts.
            each = (features(t.as_py()) for t in b.column(b.schema.get_field_index("text")))
            totals = np.array([np.maximum(table[:, x], table[:, y]).sum(axis=1) for x, y in each]).reshape(-1, 2) + none
            weight = totals.min(axis=1)
            target = 1 / (1 + np.exp(np.clip(odds - totals, -50, 50)).sum(axis=1))
            ids = b.column(b.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x) for x in (weight, weight + _noise(ids), target))], [*b.schema.names, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, *(f"{n} double" for n in names)]))


def threshold(keys: DataFrame, key: str, k: int) -> float:
    """The k-th largest key, exactly: a histogram is refined around it until few keys are left to look at."""
    if k <= 0:
        return float("inf")
    lo, hi, n = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if k >= n:
        return float("-inf")
    while True:
        inside = keys.where(F.col(key).between(lo, hi))
        bins = inside.select(F.least(F.floor((F.col(key) - lo) / (hi - lo) * 1000), F.lit(999)).alias("bin"), F.col(key).alias("x")) if hi > lo else None
        if bins is None:
            return lo
        found = sorted(bins.groupBy("bin").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), reverse=True)
        for _, n, low, high in found:
            if k <= n:
                lo, hi = low, high
                break
            k -= n
        if n <= 1000:
            return sorted((r[0] for r in keys.where(F.col(key).between(lo, hi)).select(key).collect()), reverse=True)[k - 1]


def least_key(weighed: DataFrame) -> float:
    """The smallest key that is kept of ``weighed`` rows: of the k largest, k being the expected number of target documents, rounded up."""
    k = ceil((weighed.agg(F.sum(f"{KEY}_target")).first()[0] or 0) - 1e-6)
    return threshold(weighed, f"{KEY}_key", k)


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, weight, key, kept) of every row.

    A null text is an empty one. Rows that repeat an id and a text have one key and share its fate; rows tied with the
    last kept are kept. Without labels all weights are zero. Empty tables give empty results.
    """
    weighed = weigh(docs.select("doc_id", "text"), fit(docs, labels))
    weighed = cut(weighed.select("doc_id", *(f"{KEY}_{x}" for x in ("weight", "key", "target"))))
    kept = F.col(f"{KEY}_key") >= least_key(weighed)
    return weighed.select("doc_id", F.col(f"{KEY}_weight").alias("weight"), F.col(f"{KEY}_key").alias("key"), kept.alias("kept"))


def resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``. They are weighed twice rather than stored with their texts."""
    weighed = weigh(docs, fit(docs, labels))
    least = least_key(cut(weighed.select(f"{KEY}_key", f"{KEY}_target")))
    return weighed.where(F.col(f"{KEY}_key") >= least).select(*docs.columns)
