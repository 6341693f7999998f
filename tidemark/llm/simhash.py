"""SimHash near-duplicates: fingerprints, linked by a self-join of a binary trie.

Two fingerprints that differ in at most ``budget`` bits leave at least two of ``budget + 2`` blocks of bits
intact. For every choice of two blocks the bits are permuted so that these come first; they are the path to a
subtrie, the unit that is dealt to tasks, and only equal paths can still meet. Within a subtrie pairs of trie
nodes are traversed together from the pair (root, root): the bits in which the two paths differ are added up, and a pair
of nodes is dropped as soon as they exceed the budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, connected_components, cut, words_of

BITS = 64
#: Pairs of nodes held at once; more wait on a stack.
FRONTIER = 1 << 18
#: Below so many pairs of leaves, a pair of nodes is compared leaf by leaf.
LEAVES = 16


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``size`` words, repeats included; of the whole where there are fewer."""
    h = xxhash.xxh64_intdigest
    if len(words) < size:
        return [h(b" ".join(words), 42)] if words else []
    text = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda e, n: e + 1 + n))
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    return [h(text[s:e], 42) for s, e in zip(starts, ends[size - 1 :], strict=True)]


def fingerprint(words: list[bytes], size: int, several: int = 1) -> np.ndarray:
    """Unsigned fingerprints; a bit is 1 if it is set in over half of the hashes; zero without words.

    The first is of the hashes as they are, any others are of hashes of these.
    """
    hashes = np.array(shingle_hashes(words, size), dtype="<u8")
    ones = np.zeros((several, BITS), dtype=np.int64)
    for k in range(0, len(hashes), 50_000):
        for m in range(several):
            part = hashes[k : k + 50_000]
            if m:
                part = part * np.uint64(0x9E3779B97F4A7C15 + 2 * m)
                part = (part ^ (part >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                part ^= part >> np.uint64(29)
            ones[m] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit number. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(words_of(t.as_py()), size)[0] for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _blocks(budget: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.arange(BITS), budget + 2)]


def _permutations(budget: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of two blocks: the moves (first bit from the top, length) that bring them to the top, and their bits."""
    out = []
    blocks = _blocks(budget)
    for pick in combinations(range(len(blocks)), 2):
        order = [*pick, *(k for k in range(len(blocks)) if k not in pick)]
        out.append(([(blocks[k][0], len(blocks[k])) for k in order], sum(len(blocks[k]) for k in pick)))
    return out


_TOP = np.uint64(1 << 63)


def _dealt(perms: list[tuple[list[tuple[int, int]], int]]):
    """Rows (perm, path, value, id) of every permutation of every fingerprint; values have the top bit flipped, so that they sort as signed."""
    depth = min(bits for _, bits in perms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.ascontiguousarray(b.column(1).to_numpy()).view(np.uint64)
            for k, (moves, _) in enumerate(perms):
                value, at = np.zeros_like(fp), 0
                for first, n in moves:
                    block = fp >> np.uint64(BITS - first - n) & np.uint64((1 << n) - 1)
                    value |= block << np.uint64(BITS - at - n)
                    at += n
                path = (value >> np.uint64(BITS - depth)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, dtype=np.int32)), pa.array(path), pa.array((value ^ _TOP).view(np.int64)), b.column(0)], ["perm", "path", "value", "id"])

    return run


def _union(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """labels, each the smallest index of its class, after the links i-j; and the positions of links that make up the same classes."""
    used, at = [], np.arange(len(i))
    while True:
        a, b = labels[i[at]], labels[j[at]]
        open_ = a != b
        if not open_.any():
            return labels, np.concatenate(used) if used else at[:0]
        at, a, b = at[open_], a[open_], b[open_]
        # Of the links of a class to smaller ones one is used in a round.
        high, one = np.unique(np.maximum(a, b), return_index=True)
        labels[high] = np.minimum(a, b)[one]
        used.append(at[one])
        while not np.array_equal(jump := labels[labels], labels):
            labels = jump


def trie_links(values: np.ndarray, roots: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, i, j): the class of each value, as its smallest index, where values within ``budget`` bits are linked; and links
    that make up the classes, each of two near values.

    values: sorted, unsigned; roots: bounds of the subtries, whose values agree in their first ``depth`` bits. Neighbours are linked
    first. Pairs of nodes that lie in one class already are dropped, so that a dense group doesn't cost its pairs.
    """
    labels = np.arange(len(values))
    ones: dict[int, np.ndarray] = {}
    links: list[tuple[np.ndarray, np.ndarray]] = []
    inside = np.ones(len(values), dtype=bool)
    inside[roots[:-1][roots[:-1] < len(values)]] = False
    changes = np.zeros(len(values) + 1, dtype=np.int64)

    def link(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal labels
        near = np.bitwise_count(values[i] ^ values[j]) <= budget
        i, j = i[near], j[near]
        if len(i):
            order = np.argsort(np.bitwise_count(values[i] ^ values[j]), kind="stable")
            i, j = i[order], j[order]
            labels, used = _union(labels, i, j)
            if len(used):
                links.append((i[used], j[used]))
                changes[2:] = np.cumsum(labels[1:] != labels[:-1])

    changes[2:] = np.arange(1, len(values))
    follows = np.flatnonzero(inside)
    link(follows - 1, follows)

    def zero_part(d: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the values with bit d set begin in each node."""
        if d not in ones:
            bit = (values >> np.uint64(BITS - 1 - d)) & np.uint64(1)
            ones[d] = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
        return hi - (ones[d][hi] - ones[d][lo])

    lo, hi = roots[:-1], roots[1:]
    several = hi - lo > 1
    stack = [(depth, np.stack((lo[several], hi[several], lo[several], hi[several], np.zeros(several.sum(), dtype=np.int64))))]
    while stack:
        d, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            stack.append((d, pairs[:, FRONTIER:]))
            pairs = pairs[:, :FRONTIER]
        a, b, c, e, err = pairs
        one_class = (labels[a] == labels[c]) & (changes[b] == changes[a + 1]) & (changes[e] == changes[c + 1])
        pairs = pairs[:, ~one_class]
        a, b, c, e, err = pairs
        leaf = ((b - a) * (e - c) <= LEAVES) | (d >= BITS)
        if leaf.any():
            x, y, z, w, _ = pairs[:, leaf]
            n = (y - x) * (w - z)
            which = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            i, j = x[which] + k // (w - z)[which], z[which] + k % (w - z)[which]
            link(i[i < j], j[i < j])
            a, b, c, e, err = pairs[:, ~leaf]
        if not len(a):
            continue
        m, n = zero_part(d, a, b), zero_part(d, c, e)
        same = a == c
        children = np.concatenate(
            (
                np.stack((a, m, c, n, err)),
                np.stack((m, b, n, e, err)),
                np.stack((a, m, n, e, err + 1)),
                np.stack((m, b, c, n, err + 1))[:, ~same],
            ),
            axis=1,
        )
        keep = (children[4] <= budget) & (children[1] > children[0]) & (children[3] > children[2])
        keep &= ~((children[0] == children[2]) & (children[1] - children[0] == 1))
        stack.append((d + 1, children[:, keep]))
    i, j = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (labels[:0], labels[:0])
    return labels, i, j


def _joined(perms: list[int], budget: int):
    """Reads rows sorted by permutation and permuted fingerprint; keeps at most a batch and one subtrie. Rows with equal values are linked to their first."""

    def classes(perm: np.ndarray, values: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
        out = []
        for p in np.unique(perm):
            at = perm == p
            v, own = values[at], ids[at]
            fresh = np.concatenate(([True], v[1:] != v[:-1]))
            unique, place = v[fresh], np.flatnonzero(fresh)
            paths = unique >> np.uint64(BITS - perms[p])
            roots = np.concatenate(([0], np.flatnonzero(paths[1:] != paths[:-1]) + 1, [len(unique)]))
            _, i, j = trie_links(unique, roots, perms[p], budget)
            equal = np.flatnonzero(~fresh)
            out.append((own[np.concatenate((place[i], place[(np.cumsum(fresh) - 1)[equal]]))], own[np.concatenate((place[j], equal))]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            new = (b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64) ^ _TOP, b.column(2).to_numpy())
            perm, values, ids = (np.concatenate(x) for x in zip(*held, new, strict=True))
            depth = np.array(perms, dtype=np.uint64)[perm]
            path = values >> (np.uint64(BITS) - depth)
            end = len(perm)
            last = np.flatnonzero((perm != perm[-1]) | (path != path[-1]))
            begin = int(last[-1]) + 1 if len(last) else 0
            if begin:
                yield classes(perm[:begin], values[:begin], ids[:begin])
            held = [(perm[begin:end], values[begin:end], ids[begin:end])]
        if held:
            yield classes(*held[0])

    return run


def _linked(rows: DataFrame, depths: list[int], budget: int) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "perm", "path").select("perm", "value", "id").sortWithinPartitions("perm", "value")
    return rows.mapInArrow(_joined(depths, budget), "a long, b long")


def near_links(reps: DataFrame, budget: int = 4) -> DataFrame:
    """(a, b): links that join up all of ``reps`` (fp unique, id) whose fingerprints are within ``budget`` bits.

    Of each subtrie the links of a spanning forest are given rather than all pairs.
    """
    perms = _permutations(budget)
    rows = reps.where("id IS NOT NULL").select("id", "fp").mapInArrow(_dealt(perms), "perm int, path long, value long, id long")
    return _linked(rows, [bits for _, bits in perms], budget)


def near_duplicates(docs: DataFrame, size: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): fingerprint of every row and the smallest id that its links reach, itself included.

    Rows with one fingerprint are
    linked, whatever their texts; rows without words have fingerprint zero and are linked like any other. Null texts count as
    empty. A row with a null id keeps its fingerprint and gets the component of the other rows with it (null if there are
    none). Rows that repeat an id stay. Empty tables give empty results.
    """
    found = cut(fingerprints(docs, size, id_col, text_col))
    reps = cut(found.groupBy("fp").agg(F.min("id").alias("id")))
    links = cut(near_links(reps, budget).distinct())
    classes = connected_components(links).select(F.col("node").alias("id"), "component")
    of_fp = cut(reps.select("fp", "id").join(classes, "id", "left").select("fp", F.coalesce("component", "id").alias("component")))
    return found.select("id", "fp").join(of_fp, "fp").select("id", "fp", "component")


def hexadecimal(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Near-duplicates by similarity: fingerprints find most links, prefixes of the texts' shingle sets the candidates of all others; the texts decide.

#: Share of equal bits of two fingerprints at a similarity (Jaccard) of 0.8: 1 - acos(1.6 / 1.8) / pi.
EQUAL_BITS = 0.848
#: Share of the pairs of that similarity whose paths must meet, by that figure; differing bits of 64 that such a pair may have.
MEET, ROOM = 0.96, 17
#: Fingerprints of a text whose paths are used: links that they miss are found by prefixes.
FIRST = 2
#: Texts among which frequent shingles are sought, at least one in so many of all, and holders among them that make a shingle frequent.
SAMPLE, SAMPLED, LEAST = 100_000, 8, 3
#: Holders of a shingle from which on their pairs are dealt as blocks; pairs looked at at once.
BLOCK, PAIRS = 4_096, 1 << 17
#: 64-bit numbers of a set's mark at most.
MARK = 32


def plan_paths(texts: int) -> tuple[int, int]:
    """(bits of a path, fingerprints of a text): paths are rotations of a fingerprint, as many as give MEET.

    A path has as many bits as number the texts, 16 at least, so that the subtries of unrelated texts stay small at every size.
    """
    bits = min(32, max(16, (max(texts, 1) - 1).bit_length()))
    paths = ceil(log(1 - MEET) / log1p(-(EQUAL_BITS**bits)))
    return bits, ceil(paths / (BITS // bits))


def _paths(bits: int, several: int):
    """Rows (perm, path, value, id): every fingerprint is rotated so that each of its paths comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<u8").reshape(-1, several)
            for m in range(several):
                for k in range(BITS // bits):
                    turn = np.uint64(k * bits)
                    value = fps[:, m] << turn | fps[:, m] >> (np.uint64(BITS) - turn) if k else fps[:, m].copy()
                    perm = np.full(len(value), m * (BITS // bits) + k, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(perm), pa.array((value >> np.uint64(BITS - bits)).astype(np.int64)), pa.array((value ^ _TOP).view(np.int64)), b.column(0)], ["perm", "path", "value", "id"])

    return run


def similarity(a: list[bytes], b: list[bytes], size: int) -> float:
    """Jaccard similarity of the sets of runs of ``size`` words; texts with fewer words are one run, none where there are no words."""
    sets = [{tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for w in (a, b)]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def _shingle_set(words: list[bytes], size: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(words, size), dtype=np.uint64))


def _frequent(docs: DataFrame, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, level) of the shingles that a sample shows to be frequent, sorted by hash; level: the holders' number of binary digits."""
    every = max(SAMPLED, n // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_shingle_set(words_of(t.as_py()), size) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], ["h"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct()
    held = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    rows = held.select("h", F.ceil(F.log2("n")).cast("int").alias("level")).toArrow()
    h, level = (rows.column(k).to_numpy() for k in range(2))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], level[order]


def prefix(hashes: np.ndarray, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first members of a set in an order that is the same for all sets: two sets of similarity ``least`` have one of these in common.

    Each has so much of the other that the members past its prefix are too few. Frequent members come last; the order only decides how many candidates there are.
    """
    level = np.zeros(len(hashes), dtype=np.int64)
    if len(frequent[0]) and len(hashes):
        k = np.minimum(np.searchsorted(frequent[0], hashes), len(frequent[0]) - 1)
        level = np.where(frequent[0][k] == hashes, frequent[1][k], 0)
    return hashes[np.lexsort((hashes, level))][: len(hashes) - ceil(least * len(hashes) - 1e-9) + 1]


def _mark_sizes(n: np.ndarray) -> np.ndarray:
    """64-bit numbers of the marks of sets of n members: a power of two, with four bits a member where MARK allows."""
    return np.minimum(1 << np.ceil(np.log2(np.maximum(n, 16) / 16)).astype(np.int64), MARK)


def _mark(hashes: np.ndarray) -> np.ndarray:
    """Bits of a set: each is the parity of the members that fall on it, so two sets differ in as many members at least as their marks in bits."""
    size = int(_mark_sizes(np.array([len(hashes)]))[0])
    at = (hashes & np.uint64(64 * size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * size) & 1).astype(np.uint8), bitorder="little").view("<u8")


def _mark_differences(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the marks i of x and j of y differ; x, y: sizes of the sets, and their marks one after another. A larger mark is folded to the smaller one's size."""
    (m, left), (n, right) = x, y
    sizes = _mark_sizes(m), _mark_sizes(n)
    starts = [np.cumsum(w) - w for w in sizes]
    kind = sizes[0][i] * (2 * MARK) + sizes[1][j]
    out = np.zeros(len(i), dtype=np.int64)
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        a, b = int(k) // (2 * MARK), int(k) % (2 * MARK)
        one, other = left[starts[0][i[at]][:, None] + np.arange(a)], right[starts[1][j[at]][:, None] + np.arange(b)]
        one, other = (np.bitwise_xor.reduce(v.reshape(len(at), -1, min(a, b)), axis=1) for v in (one, other))
        out[at] = np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64)
    return out


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, component, id, n, place) of each text's prefix."""
    for b in batches:
        own = [np.frombuffer(x, dtype="<i8") for x in b.column(3).to_pylist()]
        sizes = np.array([len(x) for x in own], dtype=np.int64)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns = [np.repeat(b.column(k).to_numpy(), sizes) for k in range(3)]
        shingle = np.concatenate(own) if own else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shingle, columns[1], columns[0], columns[2], place.astype(np.int32))], ["shingle", "component", "id", "n", "place"])


def _candidates(left: np.ndarray, right: np.ndarray, n: np.ndarray, place: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of n members that have those at ``place`` in common, and none before, can be of similarity ``least``."""
    x, y = n[left].astype(np.int64), n[right].astype(np.int64)
    common = np.minimum(x - place[left], y - place[right])
    return common >= least / (1 + least) * (x + y) - 1e-6


def _sharing(least: float, forest: bool = False):
    """Reads holders sorted by shingle and component, with their sets' marks (equal ones where there are none): candidates of different components as (a, b), and for shingles of more
    than BLOCK holders blocks (left, right) of these; holds a batch and the holders of one shingle.

    Candidates are pairs whose sizes, places and marks don't rule out that they are similar. ``forest``: of those looked at at once only some, nearest first,
    that join up their components."""
    kind = np.dtype([("component", "<i8"), ("id", "<i8"), ("n", "<i4"), ("place", "<i4")])
    Side = tuple[np.ndarray, np.ndarray]

    def block(side: Side) -> bytes:
        return np.int64(len(side[0])).tobytes() + side[0].tobytes() + side[1].tobytes()

    def unblock(held: bytes) -> Side:
        many = int(np.frombuffer(held[:8], dtype="<i8")[0])
        rows = np.frombuffer(held[8 : 8 + many * kind.itemsize], dtype=kind)
        return rows, np.frombuffer(held[8 + many * kind.itemsize :], dtype="<u8")

    def part(side: Side, some: np.ndarray | slice) -> Side:
        sizes = _mark_sizes(side[0]["n"])
        if isinstance(some, slice):
            ends = np.concatenate(([0], np.cumsum(sizes)))
            return side[0][some], side[1][ends[some.start] : ends[some.stop]]
        return side[0][some], side[1][np.repeat(some, sizes)]

    def pairs(shingle: np.ndarray, side: Side) -> Iterator[pa.RecordBatch]:
        rows = side[0]
        begins = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
        for s, e in zip(begins.tolist(), np.append(begins[1:], len(rows)).tolist(), strict=True):
            if e - s > BLOCK and rows["component"][s] != rows["component"][e - 1]:
                parts = [part(side, slice(k, min(e, k + BLOCK))) for k in range(s, e, BLOCK)]
                for k, x in enumerate(parts):
                    for y in parts[k:]:
                        if x[0]["component"][0] != y[0]["component"][-1]:
                            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([block(x)], pa.binary()), pa.array([b"" if y is x else block(y)], pa.binary())], ["a", "b", "left", "right"])
        sizes = np.diff(np.append(begins, len(rows)))
        some = np.repeat((sizes > 1) & (sizes <= BLOCK), sizes)
        yield from across(shingle[some], part(side, some))

    def across(shingle: np.ndarray, side: Side) -> Iterator[pa.RecordBatch]:
        """Pairs of each row and the rows of its shingle's later components."""
        rows = side[0]
        if not len(rows):
            return
        new = shingle[1:] != shingle[:-1]
        apart = np.flatnonzero(new | (rows["component"][1:] != rows["component"][:-1])) + 1
        group = np.append(np.flatnonzero(new) + 1, len(rows))
        own = np.arange(len(rows))
        segment_end = np.append(apart, len(rows))[np.searchsorted(apart, own, side="right")]
        group_end = group[np.searchsorted(group, own, side="right")]
        yield from tested(side, segment_end, group_end - segment_end, side)

    def tested(side: Side, first: np.ndarray, many: np.ndarray, others: Side) -> Iterator[pa.RecordBatch]:
        rows, right = side[0], others[0]
        ends = np.cumsum(many)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            n = many[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = np.repeat(first[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.concatenate((rows[["n", "place"]][i], right[["n", "place"]][j]))
            k = np.arange(len(i))
            good = _candidates(k, k + len(i), both["n"], both["place"], least)
            i, j = i[good], j[good]
            x, y = rows["n"][i].astype(np.int64), right["n"][j].astype(np.int64)
            apart = _mark_differences((rows["n"], side[1]), (right["n"], others[1]), i, j)
            near = apart <= (1 - least) / (1 + least) * (x + y) + 1e-6
            i, j, apart = i[near], j[near], apart[near]
            if forest and len(i):
                order = np.argsort(apart, kind="stable")
                i, j = i[order], j[order]
                names, of = np.unique(np.concatenate((rows["component"][i], right["component"][j])), return_inverse=True)
                used = _union(np.arange(len(names)), of[: len(i)], of[len(i) :])[1]
                i, j = i[used], j[used]
            a, b = rows["id"][i], right["id"][j]
            if len(a):
                ab = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
                none = pa.nulls(ab.shape[1], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1]), none, none], ["a", "b", "left", "right"])
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, Side]] = []

        def done(more: list[tuple[np.ndarray, Side]]) -> Iterator[pa.RecordBatch]:
            shingles, sides = zip(*more, strict=True)
            yield from pairs(np.concatenate(shingles), tuple(np.concatenate(x) for x in zip(*sides, strict=True)))

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.empty(b.num_rows, dtype=kind)
            for name in kind.names:
                rows[name] = b.column(b.schema.get_field_index(name)).to_numpy()
            at = b.schema.get_field_index("mark")
            marks = np.frombuffer(b"".join(b.column(at).to_pylist()), dtype="<u8") if at >= 0 else np.zeros(_mark_sizes(rows["n"]).sum(), dtype="<u8")
            side = rows, marks
            shingle = b.column(0).to_numpy()
            last = int(np.searchsorted(shingle, shingle[-1]))
            if last or (held and held[0][0][0] != shingle[0]):
                yield from done([*held, (shingle[:last], part(side, slice(0, last)))])
                held = []
            held.append((shingle[last:], part(side, slice(last, len(rows)))))
        if held:
            yield from done(held)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0), b.column(1), strict=True):
                left = unblock(x.as_py())
                if not len(y.as_py()):
                    yield from across(np.zeros(len(left[0]), dtype=np.int64), left)
                else:
                    right = unblock(y.as_py())
                    first = np.searchsorted(right[0]["component"], left[0]["component"], side="right")
                    yield from tested(left, first, len(right[0]) - first, right)

    return run, blocks


def _number(words: list[bytes]) -> int:
    x = xxhash.xxh64_intdigest(b" ".join(words), 7)
    return x - (x >> 63 << 64)


def _prints(key: str, size: int, several: int, least: float, frequent: tuple[np.ndarray, np.ndarray]):
    """Rows (key, id, fps, n, prefix, mark). One text is cut up at a time: a whole batch's words, as objects, take ten times its bytes."""

    def of(text: str | None) -> tuple[int, bytes, int, bytes, bytes]:
        words = words_of(text)
        own = _shingle_set(words, size)
        return _number(words), fingerprint(words, size, several).tobytes(), len(own), prefix(own, least, frequent).tobytes() if len(own) else b"", _mark(own).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps, sizes, own, marks = zip(*(of(t.as_py()) for t in b.column(1)), strict=True) if b.num_rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int64()), pa.array(fps, pa.binary()), pa.array(sizes, pa.int32()), *(pa.array(x, pa.binary()) for x in (own, marks))], [key, "id", "fps", "n", "prefix", "mark"])

    return run


def similar_texts(docs: DataFrame, size: int, least: float, key: str) -> tuple[DataFrame, DataFrame]:
    """((key, text) of every row, (a, b) of similar texts): texts are numbered by a hash of their words; the links make up the classes of
    all pairs of similarity ``least`` or more.

    First candidates share a path of one of several fingerprints and differ in at most ROOM bits of it: node pairs of the subtrie, cut off there.
    Of each subtrie those of a spanning forest are taken, and their similarity is worked out on the whole texts. Then texts that are in different
    classes still and share a member of their prefixes are candidates, all of them that sizes and marks allow, so that no link between classes is missed.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.count()
    bits, several = plan_paths(rows)[0], FIRST
    frequent = _frequent(docs, size, rows)

    found = cut(docs.select(key, "text").mapInArrow(_prints(key, size, several, least, frequent), f"{key} long, id long, fps binary, n int, prefix binary, mark binary"))
    reps = found.groupBy("id").agg(F.min("fps").alias("fps"))
    rows = reps.mapInArrow(_paths(bits, several), "perm int, path long, value long, id long")
    names = found.select(key, "id")
    links = cut(_similar(docs, names, _linked(rows, [bits] * (several * (BITS // bits)), ROOM).distinct(), size, least))

    def labelled(rows: DataFrame) -> DataFrame:
        classes = connected_components(links).select(F.col("node").alias("id"), "component")
        return rows.join(classes, "id", "left").withColumn("component", F.coalesce("component", "id"))

    # Most shingles are held within one class: only the holders of the others get their marks.
    def spread(holders: DataFrame) -> DataFrame:
        of_shingle = Window.partitionBy("shingle")
        several = F.min("component").over(of_shingle) < F.max("component").over(of_shingle)
        return cut(holders.repartition(n, "shingle").withColumn("several", several).where("several").drop("several"))

    marks = found.groupBy("id").agg(F.min("mark").alias("mark"))
    prefixes = found.groupBy("id").agg(F.min(F.struct("n", "prefix")).alias("p"))
    held = labelled(prefixes).select("id", "component", "p.n", "p.prefix").mapInArrow(_holders, "shingle long, component long, id long, n int, place int")
    schema = "a long, b long, left binary, right binary"
    # First some candidates that join up classes, then all that are in different classes still: a dense group would else be compared pair by pair.
    for forest in (True, False):
        held = spread(held if forest else labelled(held.drop("component")).select(*held.columns))
        marked = held.join(marks, "id").select("shingle", "component", "id", "n", "place", "mark")
        pairs, blocks = _sharing(least, forest)
        shared = cut(marked.repartition(n, "shingle").sortWithinPartitions("shingle", "component").mapInArrow(pairs, schema))
        dealt = shared.where("left IS NOT NULL").select("left", "right").repartition(n).mapInArrow(blocks, schema)
        others = shared.where("a IS NOT NULL").unionAll(dealt).select("a", "b").distinct()
        links = cut(links.unionAll(_similar(docs, names, others, size, least)))
    return names, links


def _similar(docs: DataFrame, names: DataFrame, pairs: DataFrame, size: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) of texts' numbers whose texts are of similarity ``least`` or more; names: (key, number) of the rows of ``docs``."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = cut(pairs)

    # One row of each text that is asked for, where their keys are few; else all rows go to the sort.
    key = names.columns[0]
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    keys = cut(names.join(ids, "id").groupBy("id").agg(F.min(key).alias(key)).select(key))
    if keys.count() * 32 <= BROADCAST_BYTES:
        docs = docs.join(F.broadcast(keys), key, "left_semi")

    # Texts and the pairs that ask for them meet in one sort; each text is read once, whatever the number of its pairs.
    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            texts = (b" ".join(words_of(t.as_py())) for t in b.column(0))
            ids, packed = zip(*((_number([t]), pack(t)) for t in texts), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["id", "text"])

    asked = pairs.withColumn("pair", F.monotonically_increasing_id()).select("pair", F.explode(F.array("a", "b")).alias("id"))
    texts = docs.select("text").mapInArrow(small, "id long, text binary").select("id", F.lit(None).cast("long").alias("pair"), "text")
    both = texts.unionAll(asked.select("id", "pair", F.lit(None).cast("binary"))).repartition(n, "id").sortWithinPartitions("id", F.col("pair").asc_nulls_first())

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = None
        for b in batches:
            out: list[list] = [[], [], []]
            held = 0
            for i, pair, t in zip(*b.columns, strict=True):
                if not pair.is_valid:
                    text = t
                    continue
                for c, v in zip(out, (pair.as_py(), i.as_py(), text.as_py()), strict=True):
                    c.append(v)
                held += len(out[2][-1])
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["pair", "id", "text"])
                    out, held = [[], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["pair", "id", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        before = None
        for b in batches:
            out: list[list[int]] = [[], []]
            for pair, i, t in zip(*b.columns, strict=True):
                now = (pair.as_py(), i.as_py(), t)
                if before is None or before[0] != now[0]:
                    before = now
                elif similarity(unpack(before[2].as_py()).split(), unpack(t.as_py()).split(), size) >= least:
                    out[0].append(before[1])
                    out[1].append(now[1])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    sides = both.mapInArrow(hand_out, "pair long, id long, text binary").repartition(n, "pair").sortWithinPartitions("pair", "id")
    return sides.mapInArrow(compare, "a long, b long")


def deduplicated(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates: one with the smallest doc_id. Rows without an id stay.

    Texts are linked whose sets of five-word shingles have a similarity (Jaccard) of ``least`` or more; texts with equal words are one. Null
    texts are empty. Rows that repeat an id with different texts are judged each by its own links; of rows with the same id and text one stays.
    """
    key = "__tidemark_key"
    named = docs.where("doc_id IS NOT NULL").withColumn(key, F.xxhash64("doc_id", "text"))
    texts, links = similar_texts(named, size, least, key)
    classes = connected_components(links).select(F.col("node").alias("id"), "component")
    of_key = texts.distinct().join(classes, "id", "left").select(key, F.coalesce("component", "id").alias("component"))
    kept = named.select(key, "doc_id").distinct().join(of_key, key).groupBy("component").agg(F.min(F.struct("doc_id", key)).alias("kept"))
    named = named.join(cut(kept.select(f"kept.{key}")), key, "left_semi")
    first = Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns))
    named = named.withColumn("__tidemark_row", F.row_number().over(first)).where("__tidemark_row = 1")
    return named.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
