"""The driver's tables in the roles of the engine's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows make much work for their bytes: dealt to all cores, which Spark would not do for the size of its files."""
    return table(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism, key)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the steps of a session: user_id, event_id, ts, tool, k (its argument) and value."""
    events = table(spark, sf_dir, "events")
    return events.select("user_id", "event_id", "ts", F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value")


#: The same in DuckDB, to begin an oracle with.
STEPS_SQL = "steps AS (SELECT user_id, event_id, ts, event_type AS tool, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events)"


def last_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer, as the result of a task: task_id, ok, reward, kind."""
    from ..operators.evaluation import last_per_key

    orders = last_per_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return orders.select(F.col("o_custkey").alias("task_id"), (F.col("o_orderstatus") == "F").alias("ok"), F.col("o_totalprice").alias("reward"), F.col("o_orderpriority").alias("kind"))


LAST_ORDERS_SQL = """last_orders AS (
  SELECT o_custkey AS task_id, o_orderstatus = 'F' AS ok, o_totalprice AS reward, o_orderpriority AS kind FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""
