"""Whitening of embeddings by an exact covariance, from digit-slice products.

Entries are turned into integers x. With n vectors and the sums S of each dimension, n * x - S is the centred vector times n, an integer too. Its
digits of 20 bits are slices of their own; the products of two slices over 8,192 rows are below 2**53, so that the float64
matrix product of BLAS is exact. Products are put together again as big integers, added up within a task, and the tasks' sums are
merged digit by digit. So the covariance is exact whatever the number of rows, their order and the size of the entries; it is rounded once, before
its eigenvectors are sought.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bits of a slice and rows of a product: two slices' product over so many rows is below 2**53.
SLICE_BITS, PRODUCT_ROWS = 20, 1 << 13
#: Bits of the digits in which tasks' sums are merged; those of 2**22 tasks add up in a long.
DIGIT_BITS = 40
#: Entries are held within these bounds, so that they are longs.
LARGEST = 1 << 62
#: Eigenvalues up to this part of the trace, times the dimension, can't be told from zero in long double.
NOTHING = 1e-18


class Model(NamedTuple):
    n: int
    sums: np.ndarray  # of big integers
    explained: np.ndarray  # by component
    whitener: np.ndarray  # dimensions x components; nan where a component has no variance
    error: float | None = None


def integers(vectors: DataFrame, scale: float, offset: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x array<long>) of the rows whose vector is there and finite."""
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & usable)
    entry = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.lit(scale) * c).cast("long"))) + F.lit(offset)
    return rows.select("id", F.transform("v", entry).alias("x"))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the vectors of each length, and these as a matrix."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums: longs where they suffice, else big integers."""
    if int(np.abs(x).max(initial=0)) * n < LARGEST and max(map(abs, sums), default=0) < LARGEST:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def slices(y: np.ndarray) -> list[np.ndarray]:
    """The signed digits of integers, the lowest first, as float64."""
    sign, rest, out = np.where(y < 0, -1, 1), np.abs(y), []
    while True:
        out.append((sign * (rest & ((1 << SLICE_BITS) - 1))).astype(float))
        rest = rest >> SLICE_BITS
        if not rest.any():
            return out


def gram(y: np.ndarray) -> np.ndarray:
    """y.T @ y of integers as big integers."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for k in range(0, len(y), PRODUCT_ROWS):
        parts = slices(y[k : k + PRODUCT_ROWS])
        for i, a in enumerate(parts):
            for j in range(i + 1):
                product = (a.T @ parts[j]).astype(np.int64).astype(object) << SLICE_BITS * (i + j)
                total += product if i == j else product + product.T
    return total


def merged(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> dict[int, dict[int, int]]:
    """For each length of vector the sums over ``rows`` of what ``part`` gives for a matrix of them, by place; zeros may be missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in by_length(b.column(0)):
                totals[x.shape[1]] = totals.get(x.shape[1], 0) + part(x).astype(object)
        for dim, total in totals.items():
            sign, rest, digit = np.where(total < 0, -1, 1), np.abs(total), 0
            while len(at := np.flatnonzero(rest)):
                value = (sign[at] * (rest[at] & ((1 << DIGIT_BITS) - 1))).astype(np.int64)
                columns = (np.full(len(at), dim), at, np.full(len(at), digit), value)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "at", "digit", "value"])
                rest, digit = rest >> DIGIT_BITS, digit + 1

    found = rows.select("x").mapInArrow(run, "dim long, at long, digit long, value long").groupBy("dim", "at", "digit").agg(F.sum("value").alias("value"))
    out: dict[int, dict[int, int]] = {}
    for r in found.toArrow().to_pylist():
        own = out.setdefault(r["dim"], {})
        own[r["at"]] = own.get(r["at"], 0) + (r["value"] << DIGIT_BITS * r["digit"])
    return out


def eigen(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix of big integers, as parts of its trace, and their unit vectors as columns.

    LAPACK's error is relative to the largest eigenvalue. Rotations in long double make it relative to each one's own.
    """
    dim, trace = len(v), sum(v.diagonal())
    if not trace:
        return np.zeros(k), np.eye(dim)[:, :k]
    a = np.array([[np.longdouble(int(x)) for x in row] for row in v], dtype=np.longdouble) / np.longdouble(int(trace))
    q = np.linalg.eigh(a.astype(float))[1].astype(np.longdouble)
    a = q.T @ a @ q
    for _ in range(12):
        d = np.sqrt(np.maximum(a.diagonal(), NOTHING))
        turns = np.argwhere(np.triu(np.abs(a), 1) > np.maximum(1e-16 * np.outer(d, d), 2e-19 * dim))
        if not len(turns):
            break
        for i, j in turns:
            if a[i, j] == 0:
                continue
            half = (a[j, j] - a[i, i]) / (2 * a[i, j])
            t = (1 if half >= 0 else -1) / (abs(half) + np.sqrt(half * half + 1))
            c = 1 / np.sqrt(t * t + 1)
            turn = np.array([[c, t * c], [-t * c, c]])
            a[[i, j]] = turn.T @ a[[i, j]]
            a[:, [i, j]] = a[:, [i, j]] @ turn
            q[:, [i, j]] = q[:, [i, j]] @ turn
    order = np.argsort(-a.diagonal(), kind="stable")[:k]
    e = a.diagonal()[order]
    q = q[:, order] / np.sqrt((q[:, order] ** 2).sum(axis=0))
    return np.where(e > NOTHING * dim, e, 0), q


def whitened(x: np.ndarray, model: Model) -> np.ndarray:
    """Vectors by components."""
    return centred(x, model.n, model.sums).astype(float) / model.n @ model.whitener


def _float_sums(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> dict[int, dict[int, float]]:
    """As ``merged``, for doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in by_length(b.column(0)):
                totals[x.shape[1]] = totals.get(x.shape[1], 0) + part(x)
        for dim, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), dim)), pa.array(np.arange(len(total))), pa.array(total)], ["dim", "at", "value"])

    out: dict[int, dict[int, float]] = {}
    for r in rows.select("x").mapInArrow(run, "dim long, at long, value double").groupBy("dim", "at").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r.dim, {})[r.at] = r.value
    return out


def fit(vectors: DataFrame, components: int) -> dict[int, Model]:
    """A model for each length of the distinct vectors ``x``. The driver gets numbers by dimension and by pair of dimensions only."""
    fitted = cut(vectors.select("x").where(F.size("x") > 0).distinct())
    sums = merged(fitted, lambda x: np.concatenate(([len(x)], x.sum(axis=0) if int(np.abs(x).max(initial=0)) * len(x) < LARGEST else x.astype(object).sum(axis=0))))
    totals = {dim: (s[0], np.array([s.get(k + 1, 0) for k in range(dim)], dtype=object)) for dim, s in sums.items()}
    upper = {dim: np.triu_indices(dim) for dim in totals}
    products = merged(fitted, lambda x: gram(centred(x, *totals[x.shape[1]]))[upper[x.shape[1]]])
    models = {}
    for dim, (n, s) in totals.items():
        v = np.zeros((dim, dim), dtype=object)
        for at, value in products.get(dim, {}).items():
            i, j = upper[dim][0][at], upper[dim][1][at]
            v[i, j] = v[j, i] = value
        # The sums of products are n**3 times the covariance.
        parts, q = eigen(v, min(components, dim))
        e = parts * (np.longdouble(int(sum(v.diagonal()))) / np.longdouble(n) ** 3)
        with np.errstate(divide="ignore", invalid="ignore"):
            models[dim] = Model(n, s, parts.astype(float), np.where(e > 0, q / np.sqrt(e), np.nan).astype(float))

    def seen(x: np.ndarray) -> np.ndarray:
        return whitened(x, models[x.shape[1]])[:, models[x.shape[1]].explained > 0]

    means = {dim: np.array([s[k] for k in sorted(s)]) / totals[dim][0] for dim, s in _float_sums(fitted, lambda x: seen(x).sum(axis=0)).items()}

    def spread(x: np.ndarray) -> np.ndarray:
        w = seen(x) - means.get(x.shape[1], 0)
        return (w.T @ w).ravel()

    spreads = _float_sums(fitted, spread)
    for dim, model in models.items():
        k = int((model.explained > 0).sum())
        if k:
            found = np.array([spreads[dim][at] for at in range(k * k)]).reshape(k, k) / model.n
            models[dim] = model._replace(error=float(np.abs(found - np.eye(k)).max()))
    return models


def whiten(vectors: DataFrame, components: int = 16, scale: float = 64.0, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and its first components.

    Rows whose vector is null or holds null or non-finite entries are dropped; those without an id, with a repeated one or with a
    repeated vector are not, though the model is fitted to each distinct vector once. Vectors of each length have a model of
    their own; empty ones and empty tables have no rows. A component without variance has a null as its whitened value and is left out of the
    identity error, which is null if there is no other. A deviation beyond a long is null. Entries are held within 2**62 on either side.
    """
    rows = integers(vectors, scale, offset, id_col, vector_col).where(F.size("x") > 0)
    models = fit(rows, components)
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in by_length(b.column(1)):
                model = models[x.shape[1]]
                k, y = len(model.explained), centred(x, model.n, model.sums)
                most = int(np.abs(y).max())
                exact = most * most * y.shape[1] < 1 << 63
                deviation = ((y if exact else y.astype(object)) ** 2).sum(axis=1)
                deviation = pa.array([d if d < 1 << 63 else None for d in deviation.tolist()], pa.int64())
                places = np.repeat(np.arange(len(at)), k)
                values = whitened(x, model).ravel()
                columns = [b.column(0).take(pa.array(at[places])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(values), model.n)), deviation.take(pa.array(places)), pa.array(values, mask=np.isnan(values)), pa.array(np.tile(model.explained, len(at))), pa.array([model.error] * len(values), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    found = rows.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return found.withColumnRenamed("id", id_col)
