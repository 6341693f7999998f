"""What a session has seen so far, kept as it streams in: sets of values by kind, and counters.

Each value is a row of the state store by itself, so that a session with many of them is neither read nor written as a whole; values that
have not come again for ``keep`` are forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "session long, kind string, distinct long, steps long, total double, largest double, flagged boolean"
_COUNTS = "distinct long, steps long, total double, largest double, flagged boolean"

#: Values of a batch that are remembered as written; beyond, the state is asked.
MOST_FRESH = 100_000


def _missing(x: object) -> bool:
    return x is None or x != x


class _Running(StatefulProcessor):
    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "kind string, value string", "first boolean", self.keep)
        self.counts = handle.getMapState("counts", "kind string", _COUNTS, self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        touched: dict[str, tuple] = {}
        # Each call of the state is a round trip. A value is written once a batch, and looked for only where its kind is known: counts are written
        # with every value, so that a kind without counts has no values either.
        known: set[str] = set()
        fresh: set[tuple[str, str]] = set()
        for batch in rows:
            for kind, value, amount, flag in zip(*(batch[c].tolist() for c in ("kind", "value", "amount", "flag")), strict=True):
                if _missing(kind):
                    continue
                if kind not in touched:
                    touched[kind] = self.counts.getValue((kind,)) if self.counts.containsKey((kind,)) else (0, 0, 0.0, float("-inf"), False)
                    if touched[kind][1]:
                        known.add(kind)
                distinct, steps, total, largest, flagged = touched[kind]
                if not _missing(value) and (kind, value) not in fresh:
                    if kind not in known or not self.seen.containsKey((kind, value)):
                        distinct += 1
                    self.seen.updateValue((kind, value), (True,))
                    fresh.add((kind, value))
                    if len(fresh) > MOST_FRESH:
                        fresh.clear()
                        known.update(touched)
                if not _missing(amount):
                    total, largest = total + float(amount), max(largest, float(amount))
                touched[kind] = (distinct, steps + 1, total, largest, flagged or (not _missing(flag) and bool(flag)))
        if not touched:
            return
        for kind, state in touched.items():
            self.counts.updateValue((kind,), state)
        columns = zip(*touched.values(), strict=True)
        yield pd.DataFrame({"session": key[0], "kind": list(touched), **dict(zip(("distinct", "steps", "total", "largest", "flagged"), map(list, columns), strict=True))})

    def close(self) -> None:
        pass


def running(steps: DataFrame, keep_seconds: int = 7 * 24 * 3600) -> DataFrame:
    """Updates (session, kind, distinct, steps, total, largest, flagged) from steps (session, kind, value, amount, flag), a row for each kind that a batch touches.

    The streaming session has to use the RocksDB state store.
    """
    return steps.groupBy("session").transformWithStateInPandas(_Running(keep_seconds * 1000), _OUT, "Update", "ProcessingTime")
