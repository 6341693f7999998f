"""Best-fit packing of tokenised documents into sequences by a configuration linear program.

Only the histogram of piece lengths reaches the driver: at most ``capacity`` numbers, however large the corpus.
A configuration is a multiset of lengths that fit in one sequence. The covering program

    min sum(x_c)   with   sum(count(c, l) * x_c) >= pieces(l) for every length l

is solved by multiplicative weights: each round prices the lengths by their weights, finds the configuration of
most worth by a knapsack dynamic program, uses it for a step and lowers the weights of the lengths that it covers.
The rounds go on until every piece is covered, first by configurations that leave hardly a token free, then by ones that leave more.
The sizes themselves are a dual solution, so that all tokens by the capacity bound the program from below; it is solved
to a gap of GAP where the first prices reach that. The solution is rounded to whole sequences; what rounding leaves is packed best fit, longest first. Best fit
alone, which also takes the histogram, is kept where it needs fewer sequences. Pieces take
the slots of their length in the order of a distributed rank, so that no piece ever reaches the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import encoder

#: A configuration: (length, number of pieces of it) in falling order of length.
Configuration = tuple[tuple[int, int], ...]


def price(worth: np.ndarray, capacity: int) -> list[int]:
    """Lengths of the configuration of most worth; worth[l - 1] is that of a piece of length l. Unbounded knapsack."""
    best = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, dtype=np.int64)
    some = np.flatnonzero(worth > 0) + 1
    value = worth[some - 1]
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(some, room, side="right"))
        best[room] = best[room - 1]
        if n:
            total = value[:n] + best[room - some[:n]]
            k = int(total.argmax())
            if total[k] > best[room]:
                best[room], taken[room] = total[k], some[k]
    out, room = [], capacity
    while room > 0:
        if taken[room]:
            out.append(int(taken[room]))
            room -= int(taken[room])
        else:
            room -= 1
    return out


def solve(pieces: np.ndarray, capacity: int, rounds: int, rate: float, lead: float, waste: int) -> dict[Configuration, float]:
    """A fractional cover of all pieces[l - 1] pieces of each length l, as uses of configurations.

    A length's dual starts near its share of a sequence, with a ``lead`` for long ones, and falls exponentially, at
    ``rate``, with the share of its pieces that is covered, so that all lengths run out together. A round uses the
    configuration of most worth for at most 1/rounds of the whole. Where the best one leaves over ``waste`` tokens free, no fuller
    ones are to be had at these prices, and twice as many may be left from there on.
    """
    need = pieces.astype(float)
    lengths = np.arange(1, capacity + 1)
    step = float((need * lengths).sum()) / capacity / rounds
    uses: dict[Configuration, float] = {}
    covered = np.zeros(capacity)
    while (short := need - covered > 1e-9).any():
        share = np.divide(covered, need, out=np.ones(capacity), where=need > 0)
        fall = np.exp(-rate * (share - share[short].min()))
        found = price(np.where(short, lengths / capacity * (1 + lead * lengths / capacity) * fall, 0.0), capacity)
        if capacity - sum(found) > waste:
            waste = 2 * waste + 1
            continue
        kinds, counts = np.unique(found, return_counts=True)
        use = min(step, float(((need - covered)[kinds - 1] / counts).min()))
        covered[kinds - 1] += counts * use
        key = tuple(zip(kinds[::-1].tolist(), counts[::-1].tolist(), strict=True))
        uses[key] = uses.get(key, 0.0) + use
    return uses


def best_fit(pieces: np.ndarray, capacity: int) -> dict[Configuration, int]:
    """Packs all pieces best fit, longest first: equal sequences are filled together, so that the time depends on the lengths only."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[Configuration, int]]] = {}
    out: dict[Configuration, int] = {}

    def put(room: int, c: Configuration, n: int) -> None:
        if room == 0:
            out[c] = out.get(c, 0) + n
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((c, n))

    for length in range(capacity, 0, -1):
        n = int(pieces[length - 1])
        while n:
            k = bisect_left(rooms, length)
            room, c, same = capacity, (), n
            if k < len(rooms):
                room = rooms[k]
                c, same = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            # A sequence that has taken a piece has the least room from then on, so it takes all that it can.
            each = min(n, room // length)
            taken = min(same, n // each)
            put(room - each * length, (*c, (length, each)), taken)
            n -= taken * each
            if c and same > taken:
                put(room, c, same - taken)
    for groups in open_.values():
        for c, n in groups:
            out[c] = out.get(c, 0) + n
    return out


#: (rounds, rate, lead, waste) of each solution; the next is tried where one leaves a larger gap, as with few pieces a length.
PRICES = [(300, 0.05, 0.05, 2), (300, 0.2, 0.1, 0)]
GAP = 0.0005


def rounded(left: np.ndarray, uses: dict[Configuration, float], capacity: int) -> dict[Configuration, int]:
    """Whole uses of the configurations that cover every length exactly.

    Whole parts of the solution are kept; then the configurations with the largest fractions are used once more
    while enough pieces are left for them; the rest goes best fit.
    """
    left = left.copy()
    out: dict[Configuration, int] = {}

    def use(c: Configuration, n: int) -> None:
        n = min([n, *(int(left[length - 1]) // k for length, k in c)])
        if n > 0:
            out[c] = out.get(c, 0) + n
            for length, k in c:
                left[length - 1] -= n * k

    for c, x in uses.items():
        use(c, int(x + 1e-9))
    for c, x in sorted(uses.items(), key=lambda kv: (int(kv[1] + 1e-9) - kv[1], kv[0])):
        if x - int(x + 1e-9) > 1e-9:
            use(c, 1)
    for c, n in best_fit(left, capacity).items():
        out[c] = out.get(c, 0) + n
    return out


def plan(pieces: np.ndarray, capacity: int) -> list[tuple[Configuration, int]]:
    """Configurations and how often each is used, for pieces[l - 1] pieces of each length l."""
    left = pieces.astype(np.int64)
    full = int(left[capacity - 1])
    left = np.append(left[:-1], 0)
    bound = float((left * np.arange(1, capacity + 1)).sum()) / capacity
    found = [best_fit(left, capacity)]
    for p in PRICES:
        uses = solve(left, capacity, *p)
        found.append(rounded(left, uses, capacity))
        if sum(uses.values()) <= bound * (1 + GAP):
            break
    best = min(reversed(found), key=lambda c: sum(c.values()))
    if full:
        best[((capacity, 1),)] = full
    return sorted(best.items(), reverse=True)


def slots(configurations: list[tuple[Configuration, int]], capacity: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: rank at which each configuration's slots begin, slots a sequence, first sequence, offset, step between slots."""
    of: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
    begin = [0] * (capacity + 1)
    first = 0
    for c, n in configurations:
        offset = 0
        for length, k in c:
            of[length].append((begin[length], k, first, offset))
            begin[length] += n * k
            offset += length * k
        first += n
    empty = np.zeros((0, 4), dtype=np.int64)
    return [tuple((np.array(x, dtype=np.int64) if x else empty).T) for x in of]


def pieces_of(docs: DataFrame, capacity: int, tokenizer: str | None, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """(id, row, piece, start, length, ids_crc32[, ids]) of every piece. Only documents over ``capacity`` are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            doc, text, row = (b.column(k).to_pylist() for k in range(3))
            cols: list[list] = [[] for _ in range(7)]
            for d, t, r in zip(doc, text, row, strict=True):
                ids = np.array([*encode(t or ""), end_id], dtype="<u4")
                head = (len(ids) - 1) % capacity + 1
                bounds = [0, *range(head, len(ids) + 1, capacity)]
                for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    for c, v in zip(cols, (d, r, k, s, e - s, zlib.crc32(ids[s:e].tobytes()), ids[s:e] if keep_ids else None), strict=True):
                        c.append(v)
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 6 + keep_ids], NAMES[: 6 + keep_ids])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return source.mapInArrow(run, "id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


NAMES = ["id", "row", "piece", "start", "length", "ids_crc32", "ids"]


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset): where every piece of every row goes.

    A null text is an empty one and takes one token, the end id. Rows with a null id, and rows that repeat an id, are
    packed like any other. Empty tables give no rows. Sequences are numbered from 0 without gaps.
    """
    pieces = cut(pieces_of(docs, capacity, tokenizer, end_id, id_col, text_col, keep_ids))
    histogram = np.zeros(capacity, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        histogram[length - 1] = n
    at = slots(plan(histogram, capacity), capacity)

    # The rank of a piece within its length: that of its part plus its own within the part. A length with n pieces has
    # about sqrt(n) parts, so neither a part nor the list of parts is long.
    parts = F.element_at(F.array(*(F.lit(max(1, isqrt(int(n)))) for n in histogram)), F.col("length").cast("int"))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("row", "piece"), parts))
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("row", "piece")) - 1
    ranked = dealt.withColumn("own", own.cast("long")).join(bases, ["length", "part"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            length, rank = b.column("length").to_numpy(), b.column("own").to_numpy() + b.column("base").to_numpy()
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = length[part[0]]
                begin, each, first, into = at[n]
                k = np.searchsorted(begin, rank[part], side="right") - 1
                past = rank[part] - begin[k]
                sequence[part] = first[k] + past // each[k]
                offset[part] = into[k] + past % each[k] * n
            kept = [c for c in NAMES if c in names and c != "row"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long")
