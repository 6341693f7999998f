"""Queries by name, each with the SQL that expresses the same over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def plain_counts(sql: str) -> str:
    """count_if(x) as a filtered count: DuckDB's count_if is wider than a bigint."""
    out, at = "", 0
    while (k := sql.find("count_if(", at)) >= 0:
        end, depth = k + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at:k] + "count(*) FILTER (WHERE " + plain_counts(sql[k + len("count_if(") : end - 1]) + ")"
        at = end
    return out + sql[at:]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = plain_counts(sql)
        return f

    return register
