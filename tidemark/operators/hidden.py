"""Fields that a public record must not hold, found in JSON of any shape and depth.

The records are parsed once, as variants, and walked a level at a time: each step explodes the objects and arrays of the level before, notes
the keys that are forbidden and goes on with what has a level below. A row whose text has neither a forbidden key nor an escape that could
hide one is not parsed at all. Nothing is shuffled. A level is written once, of which only findings and what has a level below: else each level would begin
with the rows' texts again.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import written

#: Keys that tell the goal of a task, in any case.
GOALS = ("goal", "gold", "gold_asin", "hidden_goal", "reward_goal", "target", "target_asin")
#: The path of a text that can't be parsed.
BROKEN = "$!"


def forbidden_paths(rows: DataFrame, key: str, document: Column, forbidden: tuple[str, ...] = GOALS) -> DataFrame:
    """(key, path) of every forbidden name in the rows' JSON, from the root $ on; below a forbidden name, too.

    A text with such a name that is no JSON has the path ``BROKEN``, since nothing can be said of it; a null has none. Names are compared without case.
    """
    names = "|".join(map(re.escape, forbidden))
    said = rows.select(F.col(key).alias("id"), document.alias("text")).where(F.col("text").rlike(rf'(?i)"({names})"\s*:') | F.col("text").contains("\\u"))
    deeper = F.coalesce(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)<"), F.lit(False))
    parsed = said.select("id", F.try_parse_json("text").alias("value"), F.lit("$").alias("path")).withColumns({"broken": F.col("value").isNull(), "deeper": deeper})
    level = written(parsed.where("broken OR deeper"))
    found = [level.where("broken").select("id", F.lit(BROKEN).alias("path"))]
    members = rows.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("pos", "name", "member")
    while not (level := level.where("deeper")).isEmpty():
        step = F.when(F.col("name").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("name")))
        below = level.select("id", "path", "value").lateralJoin(members).select("id", F.concat("path", step).alias("path"), F.coalesce(F.lower("name").isin(*forbidden), F.lit(False)).alias("hit"), F.col("member").alias("value"))
        level = written(below.withColumn("deeper", deeper).where("hit OR deeper"))
        found.append(level.where("hit").select("id", "path"))
    return reduce(DataFrame.unionByName, found).withColumnRenamed("id", key)
