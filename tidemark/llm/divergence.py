"""Divergence of a language's sources from each other, by joint histograms of counts.

Each source of a language gives each kept term a share p of its words, which depends on the term's count there. The divergence of two
sources is a sum of f(p, q) over all kept terms, those that neither holds among them. It is not summed up term by term: for each pair of sources
the terms are tallied by their (count, count), and f is evaluated once for each such combination, times its tally.
Only terms that both hold are tallied from rows. The cells with a zero are implied: the counts of one source, less what
it shares with the other, and all kept terms less those of either.

The terms of a language are dealt in blocks by their hash; a block tallies its terms for all pairs before anything is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, small

#: What has no place in a term becomes a space, and A-Z are lower-cased. All bytes of other characters are above 0x7F.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Distinct terms that a task holds at most before it gives its counts away.
HELD = 700_000
#: Rows (source, term) of a block as expected, and cells of the dense part that is tallied at once.
BLOCK_ROWS, CELLS = 10_000, 4_000_000
#: What a share is measured in.
UNIT = 1_000_000_000


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and of all characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TERMS).split() if text else []


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, count, docs), and a row with a null term for each (lang, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        held: dict[tuple[str, str], Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in counts.items():
                n = len(own) + 1
                own_docs = held[lang, source]
                columns = [pa.array([lang]).take(pa.array(np.zeros(n, dtype=np.int64))), pa.array([source]).take(pa.array(np.zeros(n, dtype=np.int64)))]
                columns += [pa.array([None, *own], pa.binary()).cast(pa.string()), pa.array([0, *own.values()], pa.int64()), pa.array([0, *(own_docs[t] for t in own)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])
            counts.clear()
            held.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = terms_of(text.as_py())
                counts.setdefault((lang, source), Counter()).update(words)
                held.setdefault((lang, source), Counter()).update(set(words))
            if sum(map(len, counts.values())) > HELD:
                yield from flush()
        yield from flush()

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    # A task's counts have been added up; dealing them out by hand saves Spark from trying again before the shuffle.
    return found.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (n + 2 * v)), in decimals that hold it exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    top, base = wide(count + 2) * F.lit(UNIT).cast("decimal(10,0)"), wide(n + 2 * v)
    return F.call_function("div", top, base) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def joint_counts(kept: DataFrame, blocks: int) -> DataFrame:
    """(a, b, x, y, n): how many terms more the pair of groups a < b has with counts x and y, from the terms that both hold.

    Each of those also leaves the cells (x, 0) and (0, y), where the groups' own histograms put it, and comes back to (0, 0), from which
    both histograms have taken it.
    """

    def tally(block: pa.Table) -> pa.Table:
        term = block.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        groups, group = np.unique(block.column("g").to_numpy(), return_inverse=True)
        order = np.argsort(term, kind="stable")
        term, group, count = term[order], group[order], block.column("count").to_numpy()[order]
        out: list[tuple[np.ndarray, ...]] = []
        step = max(1, CELLS // len(groups))
        for first in range(0, int(term[-1]) + 1, step):
            lo, hi = np.searchsorted(term, (first, first + step))
            dense = np.zeros((len(groups), min(step, int(term[-1]) + 1 - first)), dtype=np.int64)
            dense[group[lo:hi], term[lo:hi] - first] = count[lo:hi]
            # Counts by their rank, so that a pair of them is one number.
            values, ranks = zip(*(np.unique(row, return_inverse=True) for row in dense), strict=True)
            for i, j in combinations(range(len(groups)), 2):
                both = (dense[i] > 0) & (dense[j] > 0)
                if not both.any():
                    continue
                cells, n = np.unique(ranks[i][both] * len(values[j]) + ranks[j][both], return_counts=True)
                x, y = values[i][cells // len(values[j])], values[j][cells % len(values[j])]
                zero, (xs, x_at), (ys, y_at) = np.zeros_like(x), np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
                out.append((np.full(len(x), groups[i]), np.full(len(x), groups[j]), x, y, n))
                out.append((np.full(len(xs), groups[i]), np.full(len(xs), groups[j]), xs, zero[: len(xs)], -np.bincount(x_at, n).astype(np.int64)))
                out.append((np.full(len(ys), groups[i]), np.full(len(ys), groups[j]), zero[: len(ys)], ys, -np.bincount(y_at, n).astype(np.int64)))
                out.append((groups[i : i + 1], groups[j : j + 1], zero[:1], zero[:1], np.array([n.sum()])))
        columns = [np.concatenate(c) if out else np.zeros(0, dtype=np.int64) for c in (zip(*out, strict=True) if out else [()] * 5)]
        return pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["a", "b", "x", "y", "n"])

    dealt = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "g", "term", "count")
    return dealt.groupBy("lang", "block").applyInArrow(tally, "a long, b long, x long, y long, n long")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from its other sources, and in which terms from the language.

    Part ``pair`` has the other sources by falling divergence, part ``term`` the ``top`` terms that the source has more of than its language.
    A language keeps the terms that ``least_docs`` of its rows hold. A null text, language or source is an empty string; texts without
    terms and groups without texts still are sources. Repeated rows count as often as they occur. Ties go to the smaller item. An empty table has
    no rows. Texts are counted one at a time and whole; counts, shares and sums are exact.
    """
    counts = cut(term_counts(docs, lang_col, source_col, text_col))
    terms = counts.where("term IS NOT NULL").withColumn("own", F.col("count"))
    by_term = Window.partitionBy("lang", "term")
    terms = terms.select("lang", "source", "term", "own", F.sum("docs").over(by_term).alias("docs"), F.sum("count").over(by_term).alias("all"))
    terms = cut(terms.where(F.col("docs") >= least_docs).select("lang", "source", "term", F.col("own").alias("count"), "all"))

    n = terms.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("terms"))
    v = terms.select("lang", "term", "all").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("all_n"))
    groups = counts.where("term IS NULL").select("lang", "source")
    groups = groups.join(n, ["lang", "source"], "left").join(v, "lang", "left").fillna(0, ["n", "terms", "v", "all_n"])
    groups = numbered(groups, "g", "lang", "source")
    known = small(groups)
    kept = cut(terms.join(known.select("lang", "source", "g", "n", "v", "all_n"), ["lang", "source"]))

    p = share(F.col("count"), F.col("n"), F.col("v"))
    q = share(F.col("all"), F.col("all_n"), F.col("v"))
    more = kept.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    more = more.select("lang", "source", F.lit("term").alias("part"), "item", distance(F.col("p"), F.col("q")).alias("value"))

    a, b = (groups.select("lang", *(F.col(c).alias(f"{c}_{x}") for c in ("g", "source", "n", "terms")), *(["v"] if x == "a" else [])) for x in "ab")
    pairs = cut(a.join(b, "lang").where("g_a < g_b"))
    rows = kept.count()
    zero = F.lit(0).cast("long")
    histogram = kept.groupBy("g", "count").agg(F.count("*").alias("n"))
    histogram = histogram.select("g", "count", F.col("n").alias("h"))
    ends = pairs.select(F.col("g_a").alias("a"), F.col("g_b").alias("b"))
    cells = [
        joint_counts(kept, max(1, rows // BLOCK_ROWS)),
        ends.join(histogram, ends.a == histogram.g).select("a", "b", F.col("count").alias("x"), zero.alias("y"), F.col("h").alias("n")),
        ends.join(histogram, ends.b == histogram.g).select("a", "b", zero.alias("x"), F.col("count").alias("y"), F.col("h").alias("n")),
        pairs.select(F.col("g_a").alias("a"), F.col("g_b").alias("b"), zero.alias("x"), zero.alias("y"), (F.col("v") - F.col("terms_a") - F.col("terms_b")).alias("n")),
    ]
    tallied = cells[0].unionByName(cells[1]).unionByName(cells[2]).unionByName(cells[3]).groupBy("a", "b", "x", "y").agg(F.sum("n").alias("tally")).where("tally <> 0")
    ends = pairs.select(F.col("g_a").alias("a"), F.col("g_b").alias("b"), "n_a", "n_b", "v")
    each = distance(share(F.col("x"), F.col("n_a"), F.col("v")), share(F.col("y"), F.col("n_b"), F.col("v")))
    sums = tallied.join(small(ends), ["a", "b"]).groupBy("a", "b").agg(F.sum(each * F.col("tally")).alias("value"))
    sums = cut(pairs.join(sums, (F.col("g_a") == F.col("a")) & (F.col("g_b") == F.col("b")), "left").select("lang", "source_a", "source_b", F.coalesce("value", zero).alias("value")))
    pair = [sums.select("lang", F.col(f"source_{x}").alias("source"), F.lit("pair").alias("part"), F.col(f"source_{y}").alias("item"), "value") for x, y in ("ab", "ba")]

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair[0].unionByName(pair[1]).withColumn("rank", F.row_number().over(order)).unionByName(best).select("lang", "source", "part", "item", "value", "rank")


#: DuckDB: f for every pair of sources and every kept term.
AUDIT_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
word AS (SELECT d, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS c FROM word GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
grp AS (SELECT DISTINCT lang, source FROM doc),
counted AS (SELECT lang, source, term, count(*) AS c FROM word GROUP BY ALL),
cell AS (
  SELECT g.lang, g.source, k.term, CAST(coalesce(c.c, 0) AS HUGEINT) AS c, CAST(k.c AS HUGEINT) AS all_c
  FROM grp g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, c,
         1 + (1000000000 * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p,
         1 + (1000000000 * (all_c + 2)) // (sum(all_c) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source))::HUGEINT AS q
  FROM cell),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
