"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

DataFrame functions only. An item with n distinct shingles is contained in a document if the document holds at least
ceil(t * n) of them. Items are partitioned by that number, within factors of two. Such a document lacks at most n - ceil(t * n), so it holds at least one of any
n - ceil(t * n) + 1. The signature of an item is that many of its smallest shingle hashes (bottom-k MinHash), k being that of
its size; a document is searched with its hashes up to the largest one of the signatures in any part of items that it is large enough for. So the search has no misses,
whatever the document's length, which banded signatures of a whole long document cannot offer. Documents too
small to hold ceil(t * n) shingles are left out, and the rest is verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows up to which a side that has been counted is broadcast (some 100 MB); beyond, both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def counted(df: DataFrame) -> DataFrame:
    """Broadcast if a count shows it to be small, else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(each: str, size: int) -> Column:
    """A hash of each run of ``size`` words, from the column of the words' hashes.

    It has to be a column: an expression would be evaluated anew for every run.
    """
    runs = F.transform(F.sequence(F.lit(0), F.size(each) - size), lambda i: F.xxhash64(*(F.get(each, i + k) for k in range(size))))
    return F.when(F.size(each) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def shingles(word_list: str, size: int) -> Column:
    """The distinct runs of ``size`` words, with a space at either end."""
    runs = F.transform(F.sequence(F.lit(1), F.size(word_list) - size + 1), lambda i: F.concat(F.lit(" "), F.array_join(F.slice(word_list, i, size), " "), F.lit(" ")))
    return F.array_distinct(F.when(F.size(word_list) >= size, runs).otherwise(F.array().cast("array<string>")))


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every document that holds an item.

    Words are lower-cased runs of letters and digits; shingles are runs of ``size`` of them. Items without a whole
    shingle, null texts and rows without an id take no part. Rows that repeat an id count as one: of items the
    shingles are put together, of documents the largest containment is given.
    """
    parts = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", words(F.col("text")).alias("w"))
    parts = parts.select("item_id", F.explode(shingles("w", size)).alias("s")).groupBy("item_id").agg(F.collect_set("s").alias("shingles"))
    items = cut(parts.withColumn("need", F.ceil(F.size("shingles") * F.lit(threshold) - 1e-9).cast("int")))
    hashes = F.transform("shingles", lambda s: F.xxhash64(*(F.xxhash64(F.split_part(F.trim(s), F.lit(" "), F.lit(k + 1))) for k in range(size))))
    signature = F.slice(F.array_sort(hashes), F.lit(1), F.size("shingles") - F.col("need") + 1)
    signatures = cut(items.select("item_id", "need", F.explode(signature).alias("h")))
    # Items are partitioned by size, each part with a cut-off of its own: that of a document is the largest of the parts that are small enough for it.
    size_part = F.floor(F.log2("need"))
    parts_of = signatures.groupBy(size_part.alias("part")).agg(F.min("need").alias("least"), F.max("h").alias("top")).collect()
    lowest = F.lit(None).cast("bigint")
    top = F.greatest(lowest, lowest, *(F.when(F.col("n") >= r.least, F.lit(r.top)) for r in parts_of))

    source = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    searched = source.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("each"))
    searched = searched.select("doc_id", (F.size("each") - (size - 1)).alias("n"), shingle_hashes("each", size).alias("h"))
    searched = searched.select("doc_id", "n", "h", top.alias("top")).where("top IS NOT NULL")
    searched = searched.select("doc_id", "n", F.explode(F.filter("h", lambda x: x <= F.col("top"))).alias("h"))
    found = searched.join(counted(signatures), "h").where("n >= need").select("doc_id", "item_id").distinct()
    found = cut(found)

    texts = source.join(counted(found.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = texts.select("doc_id", F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" ")).alias("line"))
    pairs = found.join(counted(items), "item_id").join(texts, "doc_id")
    shared = F.size(F.filter("shingles", lambda s: F.col("line").contains(s)))
    verified = pairs.select("doc_id", "item_id", "need", F.size("shingles").alias("n_shingles"), shared.alias("n_shared"))
    verified = verified.groupBy("doc_id", "item_id", "need", "n_shingles").agg(F.max("n_shared").alias("n_shared")).where("n_shared >= need")
    return verified.select("doc_id", "item_id", "n_shingles", "n_shared", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """``docs`` without the rows that hold an item; rows without an id stay, since they cannot be named."""
    hits = cut(contained(docs, benchmark, threshold, size).select("doc_id").distinct())
    return docs.join(counted(hits), "doc_id", "left_anti").select(*docs.columns)


#: DuckDB: the same by comparing the shingle sets of all documents and items.
CONTAINED_SQL = r"""
WITH item AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL),
item_shingle AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM item),
sized AS (SELECT item_id, count(*) AS n_shingles FROM item_shingle GROUP BY item_id),
doc AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
  WHERE doc_id IS NOT NULL AND text IS NOT NULL),
doc_shingle AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM doc),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingle JOIN item_shingle USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_shingles AS INTEGER) AS n_shingles, CAST(n_shared AS INTEGER) AS n_shared,
       round(n_shared / n_shingles, 6) AS containment
FROM shared JOIN sized USING (item_id)
WHERE n_shared >= ceil(n_shingles * 0.8 - 1e-9)
"""
