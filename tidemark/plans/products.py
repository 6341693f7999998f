"""Scoring and search over the driver's tables: parts are products, order lines are purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import features as C
from ..operators import scoring as S
from ..operators import search as R
from ..operators import variants as V
from .registry import query
from .tables import dealt, table

# A line's purchase: the part is the product, and the order's customer wants a brand, a price and a kind.

PURCHASE_SQL = """purchases AS (
  SELECT l_orderkey, l_linenumber, l_quantity, p_partkey, p_brand, p_type, p_name, l_extendedprice / l_quantity AS price,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(400 + 25 * (l_orderkey % 100) AS DOUBLE) END AS price_limit,
    'Brand#' || (l_orderkey % 25 + 1) AS wanted_brand,
    CASE WHEN l_orderkey % 2 = 0 THEN 'ECONOMY' ELSE 'SMALL' END || '›' || split_part(p_name, ' ', 2) AS wanted_category,
    p_type || '›' || split_part(p_name, ' ', 2) AS category, l_returnflag, l_linestatus FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def purchases(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_name")
    leaf, order = F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("l_orderkey")
    return lines.join(parts, "l_partkey").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.col("l_partkey").alias("p_partkey"),
        "p_brand",
        "p_name",
        "l_returnflag",
        "l_linestatus",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise((400 + 25 * (order % 100)).cast("double")).alias("price_limit"),
        F.concat(F.lit("Brand#"), (order % 25 + 1).cast("string")).alias("wanted_brand"),
        F.concat(F.when(order % 2 == 0, "ECONOMY").otherwise("SMALL"), F.lit("›"), leaf).alias("wanted_category"),
        F.concat("p_type", F.lit("›"), leaf).alias("category"),
    )


SCORED_SQL = """scored AS (SELECT *, CASE WHEN split_part(category, '›', 1) = split_part(wanted_category, '›', 1) THEN 'pass' ELSE 'fail' END AS category_status,
  CASE WHEN price_limit IS NULL OR price <= price_limit THEN 'pass' ELSE 'fail' END AS budget_status,
  CASE WHEN p_brand = wanted_brand THEN 1e0 ELSE 0e0 END AS brand_score, CASE WHEN l_returnflag = 'N' THEN 1e0 WHEN l_returnflag = 'A' THEN 0.5e0 ELSE 0e0 END AS option_score,
  l_linestatus = 'O' AS has_options FROM purchases),
matched AS (SELECT *, round((0.35 * brand_score + CASE WHEN has_options THEN 0.15 * option_score ELSE 0.0 END) / (0.35 + CASE WHEN has_options THEN 0.15 ELSE 0.0 END), 6) AS score FROM scored)"""


def scored(spark, d):
    rows = purchases(spark, d)
    rows = rows.select(
        "*",
        S.category_match(F.col("wanted_category"), F.col("category")).alias("category_status"),
        S.price_gate(F.col("price_limit"), F.col("price")).alias("budget_status"),
        (F.col("p_brand") == F.col("wanted_brand")).cast("double").alias("brand_score"),
        F.when(F.col("l_returnflag") == "N", 1.0).when(F.col("l_returnflag") == "A", 0.5).otherwise(0.0).alias("option_score"),
        (F.col("l_linestatus") == "O").alias("has_options"),
    )
    score = S.match_score({"brand": F.col("brand_score"), "key_options": F.col("option_score")}, {"brand": F.lit(True), "key_options": F.col("has_options")})
    return rows.withColumn("score", F.round(score, 6))


@query(f"WITH {PURCHASE_SQL}, {SCORED_SQL} SELECT category, wanted_category, category_status AS status, count(*) AS n FROM scored GROUP BY ALL")
def category_match(spark, d):
    rows = scored(spark, d).groupBy("category", "wanted_category", F.col("category_status").alias("status"))
    return rows.agg(F.count("*").alias("n"))


@query(f"WITH {PURCHASE_SQL}, {SCORED_SQL} SELECT l_linenumber, budget_status AS status, count(*) AS n FROM scored GROUP BY ALL")
def price_gate(spark, d):
    return scored(spark, d).groupBy("l_linenumber", F.col("budget_status").alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {PURCHASE_SQL}, {SCORED_SQL} SELECT brand_score, option_score, has_options, score, count(*) AS n FROM matched GROUP BY ALL")
def weighted_match_score(spark, d):
    return scored(spark, d).groupBy("brand_score", "option_score", "has_options", "score").agg(F.count("*").alias("n"))


OUTCOME_SQL = """outcomes AS (SELECT *, CASE WHEN category_status = 'fail' OR budget_status = 'fail' THEN 'wrong_purchase' WHEN score >= 0.999999 AND l_quantity >= 25 THEN 'gold_purchase'
  WHEN score >= 0.999999 THEN 'valid_alternative_purchase' ELSE 'partial_purchase' END AS reward_type FROM matched)"""


@query(f"""WITH {PURCHASE_SQL}, {SCORED_SQL}, {OUTCOME_SQL} SELECT reward_type, round(CASE reward_type WHEN 'wrong_purchase' THEN -0.85e0 WHEN 'gold_purchase' THEN 1.0
  WHEN 'valid_alternative_purchase' THEN 0.55 ELSE least(0.25, -0.30 + 0.55 * score) END, 6) AS reward, true AS reward_valid, count(*) AS n FROM outcomes GROUP BY ALL""")
def purchase_outcome(spark, d):
    full = F.col("score") >= 0.999999
    x = S.purchase(F.col("category_status"), F.col("budget_status"), full, F.col("l_quantity") >= 25, F.col("score"))
    rows = scored(spark, d).select(x.alias("x")).select("x.reward_type", F.round("x.reward", 6).alias("reward"), "x.reward_valid")
    return rows.groupBy("reward_type", "reward", "reward_valid").agg(F.count("*").alias("n"))


@query(f"""WITH {PURCHASE_SQL}, {SCORED_SQL} SELECT l_orderkey, count_if(category_status = 'pass' AND budget_status = 'pass' AND score >= 0.7) AS eligible, count(*) AS n FROM matched GROUP BY l_orderkey""")
def candidate_eligibility(spark, d):
    rows = scored(spark, d).withColumn("e", S.eligible(F.col("category_status"), F.col("budget_status"), F.col("score"), F.lit(1.0)))
    return rows.groupBy("l_orderkey").agg(F.count_if("e").alias("eligible"), F.count("*").alias("n"))


@query(f"""WITH {PURCHASE_SQL} SELECT l_orderkey, l_linenumber, p_partkey, round(greatest(-1e0, least(1e0, CASE l_returnflag WHEN 'N' THEN 1e0 WHEN 'A' THEN 0.25 ELSE -0.95 END
  - 0.03 * least(l_linenumber - 1, 3) - 0.02 * least(CAST(l_quantity AS INT) % 5, 3))), 6) AS reward FROM purchases""")
def policy_reward_clip(spark, d):
    base = F.when(F.col("l_returnflag") == "N", 1.0).when(F.col("l_returnflag") == "A", 0.25).otherwise(-0.95)
    reward = S.policy_reward(base, F.col("l_linenumber") - 1, F.col("l_quantity").cast("int") % 5)
    return purchases(spark, d).select("l_orderkey", "l_linenumber", "p_partkey", F.round(reward, 6).alias("reward"))


# Variants: a brand's parts are the values of an axis, by type. Every fifth brand lists a combination, of its first type alone; the others' selection
# has the first part of each type, but of every third brand it leaves out the first type.

AXES_SQL = """axes AS (SELECT p_brand, p_type, count(DISTINCT p_retailprice) AS prices, arg_min(p_retailprice, p_partkey) AS first, CAST(substr(p_brand, 7) AS INT) AS b FROM part GROUP BY ALL),
brands AS (SELECT p_brand, b, count(*) AS n, count(*) FILTER (WHERE prices > 1) AS effective, arg_min(prices, p_type) > 1 AS first_effective, any_value(first) FILTER (WHERE prices > 1) AS chosen, count(DISTINCT first) AS firsts,
  min(first) AS lowest FROM axes GROUP BY ALL)"""


@query(f"""WITH {AXES_SQL}, m AS (SELECT *, CASE WHEN b % 5 = 0 AND n - CASE WHEN b % 3 = 0 THEN 1 ELSE 0 END = n THEN 'full_variant_combination' WHEN effective > 1 THEN 'multiple_effective_price_axes'
  WHEN effective = 1 AND b % 3 = 0 AND first_effective THEN 'effective_price_axis_unselected' WHEN effective = 1 THEN 'unique_effective_price_axis' WHEN firsts = 1 THEN 'constant_option_price' ELSE 'price_not_deterministic' END AS method FROM brands)
SELECT p_brand, CASE method WHEN 'full_variant_combination' THEN 900.0 WHEN 'unique_effective_price_axis' THEN chosen WHEN 'constant_option_price' THEN lowest END AS price,
  CASE WHEN method IN ('full_variant_combination', 'unique_effective_price_axis', 'constant_option_price') THEN 'pass' ELSE 'unverifiable' END AS status, method FROM m""")
def variant_price_cascade(spark, d):
    values = F.array_sort(F.collect_list(F.struct("p_partkey", F.concat(F.lit("Ｎ "), F.col("p_partkey").cast("string")).alias("value"), F.col("p_retailprice").alias("price"))))
    parts = table(spark, d, "part").groupBy("p_brand", "p_type").agg(values.alias("values"))
    options = F.array_sort(F.collect_list(F.struct(F.col("p_type").alias("axis"), F.transform("values", lambda v: F.struct(v["value"].alias("value"), v["price"].alias("price"))).alias("values"))))
    brands = parts.groupBy("p_brand").agg(options.alias("options")).withColumn("b", F.substring("p_brand", 7, 9).cast("int"))
    first = F.transform("options", lambda o: F.struct(o["axis"].alias("axis"), F.lower(F.translate(F.get(o["values"], 0)["value"], "Ｎ", "n")).alias("value")))
    selected = F.when(F.col("b") % 3 == 0, F.slice(first, 2, F.size(first))).otherwise(first)
    combinations = F.when(F.col("b") % 5 == 0, F.array(F.struct(first.alias("options"), F.lit(900.0).alias("price")))).otherwise(F.array().cast("array<struct<options:array<struct<axis:string,value:string>>,price:double>>"))
    rows = brands.select("p_brand", V.indexed(F.col("options")).alias("axes"), selected.alias("selected"), combinations.alias("combinations"))
    x = V.variant_price(F.col("axes"), F.col("selected"), F.col("combinations"), F.array().cast("array<double>"))
    return rows.select("p_brand", x.alias("x")).select("p_brand", "x.price", "x.status", "x.method")


@query("SELECT p_type, min(p_retailprice) AS price, arg_min(lower(p_name), (p_retailprice, lower(p_name))) AS name FROM part GROUP BY p_type")
def cheapest_variant(spark, d):
    one = F.array(F.struct(F.col("p_retailprice").alias("price"), F.col("p_name").alias("name")))
    return table(spark, d, "part").groupBy("p_type").agg(F.min(S.cheapest(one)).alias("x")).select("p_type", "x.price", "x.name")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 'unverifiable' WHEN p_size % 4 = 0 THEN CASE WHEN abs(p_size * 10.0 - 250) <= 250e-6 THEN 'pass' ELSE 'fail' END
  WHEN p_size % 4 = 1 THEN CASE WHEN p_size * 10.0 >= 250 - 250e-6 THEN 'pass' ELSE 'fail' END ELSE CASE WHEN p_size * 1.0 <= 250 + 250e-6 THEN 'pass' ELSE 'fail' END END AS status FROM part""")
def numeric_spec_units(spark, d):
    """Sizes as texts with units, against 250 mm: equal, at least or at most."""
    size = F.col("p_size")
    unit = F.when(size % 4 == 3, "kg").when(size % 4 == 2, "mm").otherwise("cm")
    mode = F.when(size % 4 == 0, "eq").when(size % 4 == 1, "min").otherwise("max")
    text = F.concat(F.lit("net size "), size.cast("string"), F.lit(" "), unit, F.lit(" boxed"))
    return table(spark, d, "part").select("p_partkey", S.spec_match(F.lit(250.0), F.lit("mm"), mode, text).alias("status"))


@query("""SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN p_size * 1.1 WHEN 1 THEN p_size WHEN 2 THEN NULL WHEN 3 THEN 10000.0 + 1000 * p_size WHEN 4 THEN p_size + 100.0
  WHEN 5 THEN NULL WHEN 6 THEN p_size * 1000.0 WHEN 7 THEN NULL ELSE p_size END::DOUBLE AS budget FROM part""")
def budget_parse(spark, d):
    """Requests around each part's name and size, in every form of a limit and some that are none."""
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    forms = [("价格在", "元左右"), ("预算", "元以下"), ("预算", "k+"), ("预算1万", "以内"), ("价格30元到1", "元之间"), ("我的预算有限，想买", "个杯子"), ("不超过 ", "千元"), ("", "元左右"), ("256k+内存，预算控制在", "元")]
    text = None
    for k, (before, after) in enumerate(forms):
        number = F.lpad(size, 2, "0") if k == 4 else size
        made = F.concat(name, F.lit(" " + before), number, F.lit(after))
        text = F.when(F.col("p_size") % 9 == k, made) if text is None else text.when(F.col("p_size") % 9 == k, made)
    return table(spark, d, "part").select("p_partkey", F.round(S.budget(text), 4).alias("budget"))


@query("""WITH p AS (SELECT p_partkey, p_size, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, lower(p_type) AS t FROM part),
k AS (SELECT *, CASE WHEN p_size % 3 < 2 AND contains(t, a) OR p_size % 3 = 1 THEN 'attribute' WHEN p_size % 3 = 0 THEN 'negated' WHEN p_size % 2 = 0 THEN 'text_fallback' ELSE 'missing' END AS ka,
  CASE WHEN p_size % 3 < 2 AND contains(t, b) THEN 'attribute' WHEN p_size % 2 = 0 THEN 'text_fallback' ELSE 'negated' END AS kb FROM p)
SELECT p_partkey, CASE WHEN ka IN ('missing', 'negated') OR kb IN ('missing', 'negated') THEN 'fail' ELSE 'pass' END AS status,
  concat_ws(',', CASE WHEN ka IN ('attribute', 'text_fallback') THEN a || '=' || ka END, CASE WHEN kb IN ('attribute', 'text_fallback') THEN b || '=' || kb END) AS matched,
  CASE WHEN ka = 'missing' THEN a ELSE '' END AS missing, concat_ws(',', CASE WHEN ka = 'negated' THEN a END, CASE WHEN kb = 'negated' THEN b END) AS negated FROM k""")
def core_function_polarity(spark, d):
    """The words of each part's name as functions, against attributes that hold or negate the first one, and texts that hold or negate the second."""
    size, words = F.col("p_size"), F.split("p_name", " ")
    first, second = F.get(words, 0), F.get(words, 1)
    attributes = F.when(size % 3 == 0, F.array(F.concat(F.lit("不支持 "), F.upper(first)), F.col("p_type"))).when(size % 3 == 1, F.array(F.col("p_type"), F.concat(first, F.lit("款")))).otherwise(F.array().cast("array<string>"))
    texts = F.when(size % 2 == 0, F.array(F.lit(None).cast("string"), F.col("p_name"))).otherwise(F.array(F.concat(F.lit("无"), second)))
    found = dealt(spark, d, "part", "p_partkey").select("p_partkey", words.alias("w"), attributes.alias("a"), texts.alias("t")).select("p_partkey", S.function_match(F.col("w"), F.col("a"), F.col("t")).alias("f"))
    matched = F.array_join(F.transform("f.matched", lambda m: F.concat_ws("=", m["value"], m["source"])), ",")
    return found.select("p_partkey", "f.status", matched.alias("matched"), F.array_join("f.missing", ",").alias("missing"), F.array_join("f.negated", ",").alias("negated"))


@query("""WITH b AS (SELECT p_partkey, p_size, p_brand, lower(p_brand) AS n, CAST(substr(p_brand, 7) AS INT) AS k FROM part),
c AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'maker' || k WHEN k % 4 = 1 THEN 'brand#' || k ELSE n END AS brand FROM b)
SELECT p_partkey, brand, CASE WHEN p_size % 5 = 0 THEN 'unverifiable' WHEN brand = 'maker' || k OR p_size % 2 = 0 THEN 'pass' ELSE 'fail' END AS status FROM c""")
def brand_alias_join(spark, d):
    """Each part's brand by its canonical name, from a table of aliases made of all brands, against its maker, or its own brand for even sizes."""
    part = table(spark, d, "part")
    k = F.substring("p_brand", 7, 9).cast("int")
    # Every fourth brand is an alias of its maker, in full-width letters; the one after stands for itself.
    named = part.select("p_brand").distinct().where(k % 4 < 2)
    maker = F.concat(F.lit("Maker "), k.cast("string"))
    wide = F.translate("p_brand", "Brand", "Ｂｒａｎｄ")
    aliases = C.alias_table(named.select(F.when(k % 4 == 0, maker).otherwise(F.col("p_brand")).alias("canonical"), F.array(wide).alias("aliases")))
    rows = C.canonical_brands(dealt(spark, d, "part", "p_partkey").select("p_partkey", "p_size", "p_brand"), aliases, "p_brand", "brand")
    required = F.when(F.col("p_size") % 5 == 0, F.array(F.lit(""))).when(F.col("p_size") % 2 == 0, F.array(C.normal(maker), F.col("brand"))).otherwise(F.array(C.normal(maker)))
    return rows.select("p_partkey", "brand", C.brand_comparison(required, F.col("brand")).alias("status"))


# Search: documents with two fields, queries from the benchmark.

FIELDS = {"body": 1.0, "lang": 2.0}
INDEX_SQL = r"""words AS (SELECT doc_id, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+(?:[._+/-][a-z0-9]+)*')) AS body, regexp_extract_all(lower(lang), '[a-z0-9]+') AS lang FROM documents),
sized AS (SELECT doc_id, len(body) + len(lang) AS length FROM words), stats AS (SELECT count(*) AS docs, sum(length) / count(*) AS mean_length FROM sized),
terms AS (SELECT doc_id, unnest(body) AS term, 1.0 AS w FROM words UNION ALL SELECT doc_id, unnest(lang), 2.0 FROM words),
postings AS (SELECT term, doc_id, length, CAST(sum(w) AS DOUBLE) AS tf FROM terms JOIN sized USING (doc_id) GROUP BY ALL),
queries AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+(?:[._+/-][a-z0-9]+)*')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score
  FROM queries JOIN df USING (term) JOIN postings USING (term), stats GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 150)"""


def ranked(spark, d):
    words = R.searchable(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id", {"body": F.col("text"), "lang": F.col("lang")})
    queries = R.asked_terms(table(spark, d, "benchmark"), "item_id", F.col("text"))
    return R.bm25(queries, words, "doc_id", FIELDS)


@query(f"WITH {INDEX_SQL} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def bm25_topk(spark, d):
    return ranked(spark, d).where("rank <= 10").select("query_id", "doc_id", "score", "rank")


@query(f"WITH {INDEX_SQL}, p AS (SELECT query_id, doc_id, rank, CAST(greatest(1, ceil(count(*) OVER (PARTITION BY query_id) / 20)) AS INTEGER) AS pages FROM ranked) SELECT * FROM p WHERE rank BETWEEN 21 AND 40")
def bm25_paged(spark, d):
    return R.page(ranked(spark, d).select("query_id", "doc_id", "rank"), 2)


@query(f"WITH {INDEX_SQL} SELECT term, count(*) AS df, round(sum(tf), 6) AS tf, CAST(max(length) AS INTEGER) AS longest FROM postings GROUP BY term")
def postings_stats(spark, d):
    words = R.searchable(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id", {"body": F.col("text"), "lang": F.col("lang")})
    index = R.postings(words, "doc_id", list(FIELDS), FIELDS)
    return index.groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("tf"), 6).alias("tf"), F.max("length").alias("longest"))


@query(r"""SELECT p_partkey, list_distinct_text AS tokens FROM (SELECT p_partkey, array_to_string(list_transform(list_filter(range(1, len(t) + 1), lambda i: list_position(t, t[i]) = i), lambda i: t[i]), ' ') AS list_distinct_text
  FROM (SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_size || '.5-x'), '[a-z0-9]+(?:[._+/-][a-z0-9]+)*') AS t FROM part))""")
def token_sets(spark, d):
    text = F.lower(F.concat_ws(" ", "p_name", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit(".5-x"))))
    return table(spark, d, "part").select("p_partkey", F.array_join(tokens(text), " ").alias("tokens"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS body FROM documents)
SELECT doc_id, CAST(len(list_filter(range(1, len(body)), lambda i: body[i] = 'of' AND body[i + 1] = 'the')) AS INTEGER) AS times FROM w
WHERE len(list_filter(range(1, len(body)), lambda i: body[i] = 'of' AND body[i + 1] = 'the')) > 0""")
def phrase_match(spark, d):
    words = R.tokenized(table(spark, d, "documents").select("doc_id", "text"), "doc_id", {"body": F.col("text")})
    return R.phrase(words, "doc_id", "body", ["of", "the"])


@query("SELECT p_partkey, p_name, CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS rank FROM part WHERE p_type = 'ECONOMY' ORDER BY p_partkey LIMIT 150")
def category_browse(spark, d):
    from pyspark.sql import Window

    first = table(spark, d, "part").where("p_type = 'ECONOMY'").select("p_partkey", "p_name").orderBy("p_partkey").limit(R.TOP_K)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("p_partkey")))


CATALOG = {"title": "p_name", "brand": "p_brand", "category": "p_type", "model": "concat(p_type, '-', p_size)", "attributes": "p_type", "options": "cast(p_size as string)", "bullets": "p_name"}
CATALOG_SQL = r"""field AS (SELECT p_partkey, f.name, f.w, list_distinct(regexp_extract_all(lower(f.text), '[a-z0-9]+(?:[._+/-][a-z0-9]+)*')) AS t FROM part, (SELECT unnest([
    {'name': 'title', 'w': 2.0, 'text': p_name}, {'name': 'brand', 'w': 2.0, 'text': p_brand}, {'name': 'category', 'w': 2.5, 'text': p_type}, {'name': 'model', 'w': 1.5, 'text': p_type || '-' || p_size},
    {'name': 'attributes', 'w': 1.2, 'text': p_type}, {'name': 'options', 'w': 0.8, 'text': CAST(p_size AS VARCHAR)}, {'name': 'bullets', 'w': 1.0, 'text': p_name}]) AS f)),
sized AS (SELECT p_partkey, sum(len(t)) AS length FROM field GROUP BY 1), stats AS (SELECT count(*) AS docs, sum(length) / count(*) AS mean_length FROM sized),
postings AS (SELECT term, p_partkey, length, CAST(sum(w) AS DOUBLE) AS tf FROM (SELECT p_partkey, w, unnest(t) AS term FROM field) JOIN sized USING (p_partkey) GROUP BY ALL),
queries AS (SELECT DISTINCT s_suppkey AS query_id, unnest(regexp_extract_all(lower(q), '[a-z0-9]+(?:[._+/-][a-z0-9]+)*')) AS term FROM (
  SELECT s_suppkey, p_type || ' ' || p_brand || ', ' || p_size AS q FROM supplier JOIN part ON s_suppkey = p_partkey)),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (SELECT query_id, p_partkey, round(sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score
  FROM queries JOIN df USING (term) JOIN postings USING (term), stats GROUP BY ALL)"""


@query(f"""WITH {CATALOG_SQL}, hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) AS INTEGER) AS rank FROM scored QUALIFY rank <= 20)
SELECT query_id, rank, p_partkey, score, p_name, p_brand, p_retailprice FROM hits JOIN part USING (p_partkey)""")
def catalog_search(spark, d):
    """The first page of hits over seven fields, joined to the catalogue: a query for each supplier, put together from the part of its number."""
    parts = table(spark, d, "part")
    words = R.searchable(parts, "p_partkey", {f: F.expr(e) for f, e in CATALOG.items()})
    text = F.concat_ws(" ", "p_type", F.concat("p_brand", F.lit(",")), F.col("p_size").cast("string"))
    asked = R.asked_terms(table(spark, d, "supplier").join(parts, F.col("s_suppkey") == F.col("p_partkey")), "s_suppkey", text)
    hits = R.bm25(asked, words, "p_partkey", R.EFFECTIVE, R.PAGE)
    return hits.join(parts, "p_partkey").select("query_id", "rank", "p_partkey", "score", "p_name", "p_brand", "p_retailprice")


@query("""WITH p AS (SELECT *, p_partkey % 3 AS v, p_type || '-' || p_size AS m FROM part)
SELECT p_partkey, p_name || ' ' || CASE v WHEN 2 THEN '“q”' ELSE '' END || m AS title, CASE v WHEN 0 THEN p_brand ELSE 'shop ' || p_brand END AS brand, CASE v WHEN 1 THEN '' ELSE p_type END AS category, lower(m) AS model,
  CASE v WHEN 0 THEN p_type || ' ' || p_size ELSE 'a ' || p_size || ' b x y' END AS attributes, CASE v WHEN 0 THEN '' ELSE '颜色 price ' || p_size || '.5 value ' || p_type || ' True' END AS options, p_name AS bullets FROM p""")
def product_fields(spark, d):
    """The fields of raw products in three shapes."""
    part = dealt(spark, d, "part", "p_partkey")
    v, size = F.col("p_partkey") % 3, F.col("p_size")
    title = F.concat(F.col("p_name"), F.lit(" "), F.when(v == 2, "“q”").otherwise(""), F.col("p_type"), F.lit("-"), size.cast("string"))
    flat = F.to_json(F.struct(title.alias("title"), F.col("p_brand").alias("brand"), F.lit("").alias("shop_name"), F.col("p_type").alias("category"), F.array(F.col("p_type"), size.cast("string")).alias("attribute"), F.array().cast("array<string>").alias("options"), F.array("p_name").alias("small_description")))
    option = F.struct(F.col("p_type").alias("value"), (size + 0.5).alias("price"), F.lit(True).alias("with"))
    nested = F.struct(
        title.alias("Title"), F.concat(F.lit("shop "), F.col("p_brand")).alias("shop_name"), F.when(v == 2, F.col("p_type")).alias("product_category"), F.array().cast("array<string>").alias("attribute"),
        F.struct(F.array(F.lit("x"), F.lit("y")).alias("b"), size.alias("a")).alias("Attributes"), F.create_map(F.lit("颜色"), F.array(option)).alias("customization_options"), F.lit("").alias("sub_title"), F.col("p_name").alias("BulletPoints"),
    )
    # The key "with" is left out of the text below, as only its value tells anything here.
    raw = F.replace(F.to_json(nested), F.lit('"with":'), F.lit('"value ":'))
    fields = R.product_fields(F.when(v == 0, flat).otherwise(raw))
    return part.select("p_partkey", *(F.trim(F.replace(F.regexp_replace(c, " +", " "), F.lit("value True"), F.lit("True"))).alias(f) for f, c in fields.items()))
