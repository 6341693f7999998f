"""Options and variants, stated prices, retrieval modes and derived fields over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..operators import search as R
from ..operators import spans as P
from ..operators import variants as V
from .registry import query
from .tables import dealt, table

# A part has a colour axis with its type, a size axis (a second colour axis, where its size is divisible by four), and in some cases a
# capacity axis, which may be empty. A task requires a colour, a size and in some cases a capacity.

PARTS_SQL = """p AS (SELECT *, p_size % 4 = 0 AS twice, p_size % 6 = 1 AS cap, p_size % 12 = 1 AS bare, p_size % 3 = 0 AS wx, p_size % 2 = 1 AS has, p_size % 5 = 0 AS odd, p_size % 7 = 0 AS wcap FROM part),
m AS (SELECT *, CASE WHEN twice THEN 'candidate_axis_collision' WHEN wx AND NOT has OR odd THEN 'candidate_required_value_missing' WHEN wcap AND NOT cap THEN 'candidate_axis_missing'
    WHEN wcap AND bare THEN 'candidate_required_value_missing' END AS fault, CASE WHEN twice OR (wx AND NOT has) THEN 'color' WHEN odd THEN 'size' WHEN wcap AND (bare OR NOT cap) THEN 'capacity' END AS place,
  '颜色=' || CASE WHEN wx THEN ' X / 1' ELSE p_type END || ';尺码=b' || CASE WHEN wcap THEN ';容量=1L' ELSE '' END AS chosen FROM p)"""


def _pair(axis, value):
    return F.struct(axis.alias("axis"), value.alias("value"))


def products(spark, d):
    size, lit, none = F.col("p_size"), F.lit, F.lit(None).cast("double")

    def listed(value, price):
        return F.struct(value.alias("value"), price.cast("double").alias("price"))

    colour = F.struct(lit("颜色").alias("axis"), F.array(listed(F.col("p_type"), F.col("p_retailprice")), listed(F.concat(lit(" X / "), (size % 2).cast("string")), none), listed(lit(" "), lit(1.0))).alias("values"))
    other = F.struct(F.when(size % 4 == 0, "颜色分类").otherwise("尺码").alias("axis"), F.array(listed(lit("a"), lit(2.0)), listed(lit("b"), lit(1.0)), listed(lit("c"), none)).alias("values"))
    room = F.array(listed(lit("2 L"), lit(3.0)), listed(lit("1L"), lit(3.0)), listed(lit("3L"), lit(float("nan"))))
    capacity = F.struct(lit("容量").alias("axis"), F.when(size % 12 == 1, F.slice(room, 1, 0)).otherwise(room).alias("values"))
    wanted = F.array(_pair(lit("color"), F.when(size % 3 == 0, "X/1").otherwise(F.col("p_type"))), _pair(lit("size"), F.when(size % 5 == 0, "zz").otherwise("B ")))
    wanted = F.when(size % 7 == 0, F.concat(wanted, F.array(_pair(lit("capacity"), lit("1l"))))).otherwise(wanted)
    rows = dealt(spark, d, "part", "p_partkey").select("p_partkey", "p_size", "p_type", "p_retailprice", F.when(size % 6 == 1, F.array(colour, other, capacity)).otherwise(F.array(colour, other)).alias("options"), wanted.alias("required"))
    return rows.withColumn("axes", V.indexed(F.col("options")))


def shown(selected):
    return F.array_join(F.transform(selected, lambda s: F.concat_ws("=", s["axis"], s["value"])), ";")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'color' ELSE '' END AS collisions, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'color,size' END || CASE WHEN p_size % 6 <> 1 THEN '' WHEN p_size % 4 = 0 THEN 'capacity' ELSE ',capacity' END AS axes FROM part""")
def option_axes(spark, d):
    axes = F.transform(V.unambiguous(F.col("axes")), lambda a: a["canonical"])
    return products(spark, d).select("p_partkey", F.array_join(V.colliding(F.col("axes")), ",").alias("collisions"), F.array_join(axes, ",").alias("axes"))


@query(f"""WITH {PARTS_SQL} SELECT p_partkey, CASE WHEN fault IS NULL THEN 'pass' WHEN fault = 'candidate_required_value_missing' THEN 'fail' ELSE 'unverifiable' END AS status, fault AS reason, place AS axis,
  CASE WHEN fault IS NULL THEN chosen ELSE '' END AS selected FROM m""")
def matching_options(spark, d):
    rows = products(spark, d).select("p_partkey", V.matching(F.col("axes"), F.col("required")).alias("m"))
    return rows.select("p_partkey", "m.status", "m.reason", "m.axis", shown("m.selected").alias("selected"))


@query(f"""WITH {PARTS_SQL} SELECT p_partkey, CASE WHEN fault = 'candidate_required_value_missing' THEN 'fail' WHEN fault IS NOT NULL OR bare THEN 'unverifiable' ELSE 'pass' END AS status,
  coalesce(fault, CASE WHEN bare THEN 'candidate_axis_has_no_values' END) AS reason, coalesce(place, CASE WHEN fault IS NULL AND bare THEN 'capacity' END) AS axis,
  CASE WHEN fault IS NULL THEN chosen || CASE WHEN cap AND NOT bare AND NOT wcap THEN ';容量=1L' ELSE '' END ELSE '' END AS selected, CASE WHEN fault IS NULL AND cap AND NOT bare AND NOT wcap THEN 'capacity' ELSE '' END AS inferred FROM m""")
def complete_variant(spark, d):
    rows = products(spark, d).withColumn("m", V.matching(F.col("axes"), F.col("required")))
    return rows.select("p_partkey", V.complete(F.col("axes"), F.col("m")).alias("v")).select("p_partkey", "v.status", "v.reason", "v.axis", shown("v.selected").alias("selected"), F.array_join("v.inferred", ",").alias("inferred"))


@query(f"""WITH {PARTS_SQL}, x AS (SELECT p_partkey, p_size, twice, concat_ws(',', CASE WHEN twice THEN 'color,size' END, CASE WHEN wcap AND NOT cap THEN 'capacity' END) AS missing,
  concat_ws(',', CASE WHEN NOT twice AND wx AND NOT has THEN 'color' END, CASE WHEN NOT twice AND odd THEN 'size' END, CASE WHEN wcap AND bare THEN 'capacity' END) AS unavailable,
  concat_ws(',', CASE WHEN NOT twice AND NOT odd AND p_size % 8 = 1 THEN 'size' END, CASE WHEN wcap AND cap AND NOT bare THEN 'capacity' END) AS wrong FROM p)
SELECT p_partkey, CASE WHEN twice OR p_size % 9 = 0 OR missing <> '' THEN 'unverifiable' WHEN unavailable <> '' OR wrong <> '' THEN 'fail' ELSE 'pass' END AS status, missing, unavailable, wrong FROM x""")
def required_option_compare(spark, d):
    size = F.col("p_size")
    picked = F.array(_pair(F.lit("颜色分类"), F.when(size % 3 == 0, "x | 1").otherwise(F.col("p_type"))), _pair(F.lit("鞋码"), F.when(size % 8 == 1, "a").otherwise("B")))
    picked = F.when(size % 9 == 0, F.concat(picked, F.array(_pair(F.lit("颜色"), F.lit("x"))))).otherwise(picked)
    rows = products(spark, d).select("p_partkey", V.compare_required(F.col("axes"), F.col("required"), picked).alias("c"))
    return rows.select("p_partkey", "c.status", *(F.array_join(f"c.{k}", ",").alias(k) for k in ("missing", "unavailable", "wrong")))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN p_retailprice + 1 END AS price FROM part")
def combination_price(spark, d):
    def combination(size, price):
        return F.struct(F.array(_pair(F.lit("尺码"), F.lit(size)), _pair(F.lit("颜色"), F.col("p_type"))).alias("options"), price.cast("double").alias("price"))

    listed = F.array(combination("A", F.col("p_retailprice") + 1), combination("B", F.lit(-1.0)))
    picked = F.array(_pair(F.lit("颜色分类"), F.lower("p_type")), _pair(F.lit("鞋码"), F.when(F.col("p_size") % 2 == 1, "a ").otherwise("b")))
    return dealt(spark, d, "part", "p_partkey").select("p_partkey", V.combination_price(listed, picked).alias("price"))


@query("""SELECT p_partkey, p_type || '>color;b>' || CASE WHEN p_size % 4 = 0 THEN 'canonical_axis_collision' ELSE 'size' END || ';zz>axis_not_found; B>canonical_axis_collision' AS resolved FROM part""")
def option_resolve(spark, d):
    found = V.resolve(F.col("axes"), F.array(F.col("p_type"), F.lit("b"), F.lit("zz"), F.lit(" B")))
    return products(spark, d).select("p_partkey", F.array_join(F.transform(found, lambda f: F.concat_ws(">", f["value"], F.coalesce(f["axis"], f["reason"]))), ";").alias("resolved"))


@query("""WITH w AS (SELECT item_id, string_split(lower(text), 'the') AS p FROM benchmark)
SELECT item_id, array_to_string(list_transform(range(1, len(p)), lambda k: CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + 3 * (k - 1) AS BIGINT)), ',') AS starts FROM w""")
def exact_spans(spark, d):
    starts = F.transform(P.exact_spans(F.col("text"), F.lit("THE")), lambda s: s["start"].cast("string"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(starts, ",").alias("starts"))


@query("""WITH t AS (SELECT p_partkey, p_size, length(p_name) AS n, length(CAST(p_size AS VARCHAR)) AS l FROM part)
SELECT p_partkey, CAST(CASE p_size % 6 WHEN 0 THEN n + 1 WHEN 1 THEN n + 1 WHEN 2 THEN n WHEN 3 THEN n + 1 WHEN 4 THEN n END AS INTEGER) AS start,
  CAST(n + 1 + CASE p_size % 6 WHEN 0 THEN 6 + l WHEN 1 THEN 9 + l WHEN 2 THEN 3 + l WHEN 3 THEN 3 + l WHEN 4 THEN 5 END AS INTEGER) AS "end",
  CASE p_size % 6 WHEN 0 THEN 'lte' WHEN 1 THEN 'between' WHEN 2 THEN 'approximately' WHEN 3 THEN 'gte' WHEN 4 THEN 'lte' END AS operator,
  CAST(CASE p_size % 6 WHEN 3 THEN p_size * 1000 WHEN 4 THEN 12000 ELSE p_size END AS DOUBLE) AS low, CAST(CASE p_size % 6 WHEN 1 THEN 99 WHEN 3 THEN p_size * 1000 WHEN 4 THEN 12000 ELSE p_size END AS DOUBLE) AS high FROM t WHERE p_size % 6 <> 5""")
def price_spans(spark, d):
    size, kind = F.col("p_size").cast("string"), F.col("p_size") % 6
    said = F.when(kind == 0, F.concat(F.lit("预算不超过"), size, F.lit("元"))).when(kind == 1, F.concat(F.lit("价格在"), size, F.lit("到99元之间"))).when(kind == 2, F.concat(size, F.lit("元左右")))
    said = said.when(kind == 3, F.concat(size, F.lit("千以上"))).when(kind == 4, "最高1万2").otherwise("买3个")
    rows = table(spark, d, "part").select("p_partkey", P.price_spans(F.concat_ws(" ", "p_name", said)).alias("s"))
    return rows.select("p_partkey", F.explode_outer("s").alias("s")).where("s IS NOT NULL").select("p_partkey", "s.*")


@query("""WITH q AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN '<a>' WHEN 1 THEN '<c>' WHEN 2 THEN '<q>' ELSE '<x>' END AS mode, CASE s_suppkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE p_name END AS v FROM supplier JOIN part ON s_suppkey = p_partkey),
f AS (SELECT query_id, part.p_partkey FROM q JOIN part ON mode = '<a>' AND v IN (p_brand, p_type) OR mode = '<c>' AND v = p_type OR mode = '<q>' AND v = p_name)
SELECT query_id, p_partkey, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p_partkey) AS INTEGER) AS rank FROM f QUALIFY rank <= 150""")
def retrieval_modes(spark, d):
    parts = table(spark, d, "part").withColumn("attributes", F.array("p_brand", "p_type"))
    asked = table(spark, d, "supplier").join(parts, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("query_id"), "p_brand", "p_type", "p_name")
    kind = F.col("query_id") % 4
    mode = F.when(kind == 0, "<a>").when(kind == 1, "<c>").when(kind == 2, "<q>").otherwise("<x>")
    value = F.when(kind == 0, F.col("p_brand")).when(kind == 1, F.col("p_type")).otherwise(F.col("p_name"))
    return R.by_value(asked, parts, mode, value, "attributes", "p_type", "p_name", "p_partkey")


@query("SELECT l_orderkey, l_linenumber, 2 * l_partkey AS p_partkey FROM lineitem WHERE 2 * l_partkey IN (SELECT p_partkey FROM part)")
def known_ids(spark, d):
    asked = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (2 * F.col("l_partkey")).alias("p_partkey"))
    return R.present(asked, table(spark, d, "part"), "p_partkey").select("l_orderkey", "l_linenumber", "p_partkey")


@query("SELECT p_name || ' ' || (p_size % 5) AS text, count(*) AS requests FROM part GROUP BY 1")
def shared_results(spark, d):
    """Requests that share a result, since their normal forms are equal."""
    said = F.concat(F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.lit(" ,  "), (F.col("p_size") % 5).cast("string"))
    asked, served = R.distinct_queries(table(spark, d, "part"), said)
    return asked.join(served.groupBy("query_id").agg(F.count("*").alias("requests")), "query_id").select("text", "requests")


@query("""SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS purchase_success, o_totalprice < 1000 AS sampling_invalid, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'unverifiable' ELSE 'pass' END AS price_status FROM orders""")
def derived_outcomes(spark, d):
    state, key = F.col("o_orderstatus"), F.col("o_orderkey")
    kind = F.when(state == "F", "gold_purchase").when(state == "O", "valid_alternative_purchase").otherwise("wrong_purchase")
    price = F.when(key % 5 == 0, F.lit(None)).when(key % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", S.derived(kind, F.col("o_totalprice") >= 1000, F.lit(0.5), F.create_map(F.lit("brand"), F.lit(1.0))).alias("x"), S.price_resolution(price).alias("p")).select(
        "o_orderkey", "x.purchase_success", "x.sampling_invalid", F.col("p.status").alias("price_status")
    )
