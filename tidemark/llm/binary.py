"""Token-id output: best-fit-decreasing packing into id matrices, without a shuffle.

Every task tokenises its own documents and packs them in windows of a bounded number of tokens, so that memory does not
grow with the input and a lost task is simply run again. The rooms of the open sequences are the leaves of a segment tree, in which the
smallest room that a piece fits in is found in a number of steps that is the logarithm of the capacity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

#: Tokens that a task packs at a time.
WINDOW = 8_000_000


class Rooms:
    """Open sequences by the room left in them: a segment tree over rooms, whose nodes count the sequences below."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, sequence) of the smallest room of at least ``least``."""
        node = self.size + least
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return room, self.open[room].pop()

    def _add(self, room: int, n: int) -> None:
        node = self.size + room
        while node:
            self.count[node] += n
            node >>= 1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the pieces of each sequence; each piece goes where the least room is left, longest first."""
    rooms, out = Rooms(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = rooms.take(lengths[k])
        room, sequence = found or (capacity, len(out))
        if found is None:
            out.append([])
        out[sequence].append(k)
        if room > lengths[k]:
            rooms.put(room - lengths[k], sequence)
    return out


SCHEMA = "sequence_id long, n_tokens int, ids binary, ids_crc32 long, cu_seqlens array<int>, doc_ids array<long>, starts array<long>, positions binary"


def packed(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 50256, pad_id: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each sequence: a line of the id matrix and what tells its segments apart.

    ids: ``capacity`` little-endian unsigned 32-bit ids, padded with ``pad_id``; n_tokens of them count. cu_seqlens: where each
    segment begins, and the end of the last; positions (little-endian 32-bit, one for each id) restart there. doc_ids and starts: the
    segments' documents (null: a row without an id) and how many of their ids came before. A document is its ids and the end id; one that
    is longer than a sequence is cut at multiples of the capacity, so that nothing is lost. Null texts are empty ones. Rows
    that repeat an id are packed like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        base, made = TaskContext.get().partitionId() << 33, 0

        def flush(pieces: list[tuple[int | None, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            bins = best_fit_decreasing([len(x) for _, _, x in pieces], capacity)
            for at in range(0, len(bins), 2000):
                cols: list[list] = [[] for _ in range(8)]
                for members in bins[at : at + 2000]:
                    line = np.full(capacity, pad_id, dtype="<u4")
                    ends = [0]
                    for k in members:
                        line[ends[-1] : ends[-1] + len(pieces[k][2])] = pieces[k][2]
                        ends.append(ends[-1] + len(pieces[k][2]))
                    row = (base + made, ends[-1], line.tobytes(), zlib.crc32(line[: ends[-1]].tobytes()), ends, [pieces[k][0] for k in members], [pieces[k][1] for k in members], positions(ends, capacity).tobytes())
                    made += 1
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                types = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["sequence_id", "n_tokens", "ids", "ids_crc32", "cu_seqlens", "doc_ids", "starts", "positions"])

        held: list[tuple[int | None, int, np.ndarray]] = []
        waiting = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                held += [(doc, s, ids[s : s + capacity]) for s in range(0, len(ids), capacity)]
                waiting += len(ids)
                if waiting >= WINDOW:
                    yield from flush(held)
                    held, waiting = [], 0
        yield from flush(held)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def positions(cu_seqlens: list[int], capacity: int) -> np.ndarray:
    """Position of every token of a line within its segment; those of the padding go on from 0."""
    bounds = [*cu_seqlens, capacity] if cu_seqlens[-1] < capacity else cu_seqlens
    return np.concatenate([np.arange(e - s, dtype="<i4") for s, e in zip(bounds, bounds[1:], strict=False)])


def write(sequences: DataFrame, path: str) -> None:
    """Writes the lines of ``packed`` as Parquet at ``path``, which must not exist."""
    sequences.write.mode("errorifexists").parquet(path)
