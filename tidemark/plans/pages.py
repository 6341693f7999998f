"""Pages under a budget of tokens, over whole texts and whole catalogues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import observation as O
from .registry import query
from .tables import table

WORD_SQL = r"'[^\x09-\x0D\x20]+'"


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x09-\x0D\x20]+"))


#: DuckDB: both ends of a text under a limit on characters, with the footer.
_BOTH_ENDS = r"""CASE WHEN {m} // 5 = 0 THEN '[TRUNCATED_BY_SHOPPING_PROJECTOR]' || chr(10) || foot
  ELSE rtrim(left(body, {m} - {m} // 5), w) || chr(10) || '[TRUNCATED_BY_SHOPPING_PROJECTOR]' || chr(10) || ltrim(right(body, {m} // 5), w) || chr(10) || foot END"""


@query(
    rf"""WITH RECURSIVE page AS (
  SELECT doc_id, coalesce(text, '') AS body,
         '搜索功能是否可用: ' || CASE WHEN doc_id % 3 = 0 THEN 'True' ELSE 'False' END || chr(10) || '可点击的按钮: ["< prev", "' || coalesce(source, '') || '"]' AS foot,
         list_reduce(list_transform([*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288], lambda c: chr(CAST(c AS INTEGER))), lambda a, b: a || b) AS w
  FROM documents),
counted AS (SELECT *, len(regexp_extract_all(body || chr(10) || chr(10) || foot, {WORD_SQL})) AS raw_tokens FROM page),
fit AS (
  SELECT doc_id, body, foot, w, 0 AS low, len(body) AS high, -1 AS best FROM counted WHERE raw_tokens > 200
  UNION ALL
  SELECT doc_id, body, foot, w, CASE WHEN n <= 200 THEN m + 1 ELSE low END, CASE WHEN n <= 200 THEN high ELSE m - 1 END, CASE WHEN n <= 200 THEN m ELSE best END
  FROM (SELECT *, (low + high) // 2 AS m, len(regexp_extract_all({_BOTH_ENDS.format(m="((low + high) // 2)")}, {WORD_SQL})) AS n FROM fit WHERE low <= high)),
best AS (SELECT doc_id, {_BOTH_ENDS.format(m="best")} AS visible FROM fit WHERE low > high)
SELECT doc_id, CASE WHEN foot[11:14] = 'True' THEN 'search_home' ELSE 'generic' END AS page_type, raw_tokens, len(regexp_extract_all(coalesce(visible, body || chr(10) || chr(10) || foot), {WORD_SQL})) AS visible_tokens,
       sha256(coalesce(visible, body || chr(10) || chr(10) || foot)) AS visible, visible IS NOT NULL AS truncated, CAST(2 AS INTEGER) AS visible_button_count
FROM counted LEFT JOIN best USING (doc_id)""".replace(
        "[*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]",
        "list_concat(list_concat(range(9, 14), range(28, 33)), list_concat([133, 160, 5760], list_concat(range(8192, 8203), [8232, 8233, 8239, 8287, 12288])))",
    )
)
def observation_fit(spark, d):
    """Every document as a page of at most 200 words."""
    state = F.when(F.col("doc_id") % 3 == 0, "True").otherwise("False")
    page = F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n搜索功能是否可用: "), state, F.lit('\n可点击的按钮: ["< prev", "'), F.coalesce("source", F.lit("")), F.lit('"]'))
    found = O.fit(table(spark, d, "documents").select("doc_id", "text", "source"), words, page, generic_budget=200)
    f = F.col("fit")
    return found.select("doc_id", f["page_type"].alias("page_type"), f["raw_tokens"].alias("raw_tokens"), f["visible_tokens"].alias("visible_tokens"), F.sha2(f["visible"], 256).alias("visible"), f["truncated"].alias("truncated"), f["visible_button_count"].alias("visible_button_count"))


_SHORT = "CASE WHEN {m} <= 0 THEN '' WHEN len(x) <= {m} THEN x WHEN {m} = 1 THEN '…' WHEN {m} = 2 THEN left(x, 1) || '…' ELSE left(x, greatest(1, ({m} - 1) * 2 // 3)) || '…' || right(x, greatest(1, {m} - 1 - greatest(1, ({m} - 1) * 2 // 3))) END"
_ROWS = (
    "list_transform(ids, lambda i, k: k || '|' || i || '|' || array_to_string(list_transform(fields[k], lambda x: "
    + _SHORT
    + "), '|'))"
)
_RESULTS = (
    "array_to_string(list_concat(['[SHOPPING_OBSERVATION_V2]', 'page_type: search_results', 'Page ' || page], list_concat("
    + _ROWS
    + ", CASE WHEN {m} < longest THEN ['[TRUNCATED_BY_SHOPPING_PROJECTOR] product_fields_compacted=true', foot] ELSE [foot] END)), chr(10))"
)


@query(
    f"""WITH RECURSIVE item AS (
  SELECT p_partkey // 20 AS page, CAST(10000000 + p_partkey AS VARCHAR) AS id, [CAST(p_size AS VARCHAR), p_brand, p_type, '', p_name] AS f FROM part),
page AS (
  SELECT page, list(id ORDER BY id) AS ids, list(f ORDER BY id) AS fields, max(list_max(list_transform(f, lambda x: len(x)))) AS longest,
         '搜索功能是否可用: False' || chr(10) || '可点击的按钮: ["Next >", "' || string_agg(id, '", "' ORDER BY id) || '"]' AS foot
  FROM item GROUP BY page),
raw AS (
  SELECT *, array_to_string(list_concat(['[SHOPPING_OBSERVATION_V2]', 'page_type: search_results', 'Page ' || page],
    list_transform(ids, lambda i, k: k || '|' || i || '|' || array_to_string(fields[k], '|'))), chr(10)) || chr(10) || 'products_shown: ' || len(ids) || chr(10) || chr(10) || foot AS text FROM page),
fit AS (
  SELECT page, ids, fields, longest, foot, CAST(0 AS BIGINT) AS low, CAST(longest AS BIGINT) AS high, CAST(-1 AS BIGINT) AS best FROM raw WHERE len(text) > 1000
  UNION ALL
  SELECT page, ids, fields, longest, foot, CASE WHEN n <= 1000 THEN m + 1 ELSE low END, CASE WHEN n <= 1000 THEN high ELSE m - 1 END, CASE WHEN n <= 1000 THEN m ELSE best END
  FROM (SELECT *, (low + high) // 2 AS m, len({_RESULTS.format(m="((low + high) // 2)")}) AS n FROM fit WHERE low <= high)),
best AS (SELECT page, {_RESULTS.format(m="best")} AS visible FROM fit WHERE low > high AND best >= 0)
SELECT page, len(text) AS raw_tokens, len(coalesce(visible, text)) AS visible_tokens, sha256(coalesce(visible, text)) AS visible, CAST(len(ids) AS INTEGER) AS visible_asin_count, CAST(len(ids) + 1 AS INTEGER) AS visible_button_count
FROM raw LEFT JOIN best USING (page)"""
)
def search_page_fit(spark, d):
    """The whole catalogue as pages of twenty products, each of at most 1,000 characters."""
    part = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 20).alias("page"), (F.col("p_partkey") + 10_000_000).cast("string").alias("id"), F.concat_ws("|", F.col("p_size").cast("string"), "p_brand", "p_type", F.lit(""), "p_name").alias("fields"))
    pages = part.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id", "fields"))).alias("items"))
    rows = F.transform("items", lambda x, i: F.concat_ws("|", (i + 1).cast("string"), x["id"], x["fields"]))
    head = F.array(F.lit(O.STRUCTURED), F.lit("page_type: search_results"), F.concat(F.lit("Page "), F.col("page").cast("string")))
    shown = F.concat(F.lit("products_shown: "), F.size("items").cast("string"))
    foot = F.concat(F.lit(f'{O.SEARCH_STATE} False\n{O.BUTTONS} ["Next >", "'), F.array_join(F.col("items.id"), '", "'), F.lit('"]'))
    text = F.concat(F.array_join(F.concat(head, rows, F.array(shown)), "\n"), F.lit("\n\n"), foot)
    found = O.fit(pages.select("page", text.alias("text")), F.length, F.col("text"), budget=1000)
    f = F.col("fit")
    return found.select("page", f["raw_tokens"].alias("raw_tokens"), f["visible_tokens"].alias("visible_tokens"), F.sha2(f["visible"], 256).alias("visible"), f["visible_asin_count"].alias("visible_asin_count"), f["visible_button_count"].alias("visible_button_count"))
