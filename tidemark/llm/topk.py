"""Exact top-k inner products by pivot-table elimination.

Components are turned into integers. The distances of all vectors to a set of pivots are a table, worked out once. By the
triangle inequality the largest difference of two rows of the table bounds the distance of their vectors from
below, and with their norms the inner product from above. A query evaluates candidates in falling order of
that bound, until no bound left reaches its k-th score. Queries and candidates meet in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PIVOTS = 32
#: Rows, taken in the order of a hash, among which the pivots are sought.
PIVOT_SAMPLE = 2_000
QUERY_BLOCK, CANDIDATE_BLOCK = 2_048, 2_048
#: Sums up to this are exact in doubles.
EXACT = 2.0**52


def integers(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<long>) of the rows that take part."""
    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("id"), own.alias("v"))


def pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first from the sample's first row."""
    chosen = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def best(q: np.ndarray, q_table: np.ndarray, own: np.ndarray, x: np.ndarray, x_table: np.ndarray, ids: np.ndarray, squares: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the query's k best candidates, by falling score and rising id; not of its own row, at the places ``own``."""
    low = np.zeros(len(x))
    for p in range(x_table.shape[1]):
        np.maximum(low, np.abs(x_table[:, p] - q_table[p]), out=low)
    square = float(q @ q)
    bound = (square + squares - low * low) / 2
    bound += 1e-9 * (square + squares) + 0.5  # what rounding may have taken
    bound[own] = -np.inf
    order = np.argsort(-bound, kind="stable")
    order = order[: np.searchsorted(-bound[order], np.inf)]
    scores = np.zeros(0, dtype=x.dtype)
    done, step = 0, max(32, 4 * k)
    while done < len(order):
        part = order[done : done + step]
        scores = np.concatenate((scores, x[part] @ q))
        done, step = done + len(part), step * 2
        if len(scores) >= k and done < len(order) and bound[order[done]] < np.partition(scores, -k)[-k]:
            break
    seen = order[:done]
    top = np.lexsort((ids[seen], -scores))[:k]
    return ids[seen][top], scores[top]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates all rows but the query's own, of its length. Rows
    with a null id or vector, or a null or non-finite component, take no part. Rows that repeat an id are rows of their own: each is a candidate,
    also for the others, and each asks where the id is one that does. An empty table gives no rows. Scores have to be below 2**63.
    """
    spark = vectors.sparkSession
    # Rows are numbered by their place in the table that is written here, which stays.
    rows = cut(integers(vectors, scale, id_col, vector_col).withColumn("dim", F.size("v"))).withColumn("row", F.monotonically_increasing_id())
    n = rows.count()
    chosen = {}
    for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(PIVOT_SAMPLE).collect():
        chosen.setdefault(r.dim, []).append(r.v)
    chosen = {dim: pivots(np.array(v, dtype=float).reshape(len(v), dim), PIVOTS) for dim, v in chosen.items()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.array(v, dtype=np.int64) for v in b.column(1).to_pylist()]
            table = [np.linalg.norm(chosen[len(v)] - v, axis=1).tobytes() if len(v) in chosen else b"" for v in own]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([v.tobytes() for v in own], pa.binary()), pa.array(table, pa.binary())], ["id", "dim", "row", "v", "t"])

    table = rows.select("id", "v", "dim", "row").mapInArrow(measure, "id long, dim int, row long, v binary, t binary")
    blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n // every // QUERY_BLOCK))
    # By the row, so that rows with one id are dealt out, too.
    own = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    query = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks)).cast("int")
    every_block, every_query = F.sequence(F.lit(0), F.lit(blocks - 1)), F.sequence(F.lit(0), F.lit(query_blocks - 1))
    candidates = table.select("*", own.alias("c"), F.explode(every_query).alias("q"), F.lit(False).alias("asks"))
    asking = table.where(F.col("id") % every == 0).select("*", F.explode(every_block).alias("c"), query.alias("q"), F.lit(True).alias("asks"))

    def search(group: pa.Table) -> pa.Table:
        ids, asks, places = group.column("id").to_numpy(), group.column("asks").to_numpy(), group.column("row").to_numpy()
        v = np.array([np.frombuffer(x, dtype=np.int64) for x in group.column("v").to_pylist()]).reshape(len(ids), -1)
        t = np.array([np.frombuffer(x) for x in group.column("t").to_pylist()]).reshape(len(ids), -1)
        most = float(np.abs(v).max(initial=0))
        x = v[~asks].astype(float) if most * most * max(1, v.shape[1]) < EXACT else v[~asks]
        squares = (x.astype(float) ** 2).sum(axis=1)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for k_ in np.flatnonzero(asks):
            found, scores = best(v[k_].astype(x.dtype), t[k_], places[~asks] == places[k_], x, t[~asks], ids[~asks], squares, k)
            for c, value in zip(out, (np.full(len(found), places[k_]), np.full(len(found), ids[k_]), found, scores.astype(np.int64)), strict=True):
                c.append(value)
        cols = [pa.array(np.concatenate(c) if c else np.zeros(0, dtype=np.int64)) for c in out]
        return pa.Table.from_arrays(cols, ["query", "query_id", "vec_id", "score"])

    found = candidates.unionAll(asking).groupBy("dim", "q", "c").applyInArrow(search, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB: all inner products of the queries.
TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(q.v) = len(c.v)),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 5
"""
