"""Readers and writers of JSON lines, JSON arrays and Parquet; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.contracts import require, require_unique


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, strict: bool = True) -> DataFrame:
    """One row for each line that is not blank, from plain or gzip files. Strict: a bad line fails the query; else it is dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_json_array(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """The objects of files that are each one array or one object."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_keyed(spark: SparkSession, path: str, schema: StructType | str, *keys: str) -> DataFrame:
    """Strict lines with unique keys."""
    return require_unique(read_jsonl(spark, path, schema), *keys)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, attempt_index) of the sound lines of a log that may be torn; a missing attempt is the first."""
    rows = read_jsonl(spark, path, "task_id long, attempt_index int", strict=False)
    return rows.where("task_id IS NOT NULL").select("task_id", F.coalesce("attempt_index", F.lit(0)).alias("attempt_index")).distinct()


def read_with_lineage(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Strict lines with ``_source`` (path, step, line, group): the file, the number in its name, the line's place among those that are not blank, and
    the file again as the group of its records.

    Files are read in several tasks. Lines are counted by the blocks that the files are cut into, a row each, so that a line's number is its place
    in its block and what the file's earlier blocks hold.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")).where(~F.col("value").rlike(r"^\s*$"))
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = lines.join(blocks, ["path", "block"])
    step = F.nullif(F.regexp_extract("path", r"([0-9]+)\.jsonl?(?:\.gz)?$", 1), F.lit("")).cast("bigint")
    source = F.struct("path", step.alias("step"), (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), F.col("path").alias("group"))
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"), source.alias("_source")).select("row.*", "_source")


def write_jsonl(rows: DataFrame, path: str, force: bool = False) -> None:
    """Commits all or nothing; refuses what is there unless forced."""
    rows.write.mode("overwrite" if force else "errorifexists").json(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_parquet(rows: DataFrame, path: str, force: bool = False) -> None:
    rows.write.mode("overwrite" if force else "errorifexists").parquet(path)


def take(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ``ids``; every id has to be there."""
    require(ids.select(key).join(rows.select(key), key, "left_anti"), f"{key} without a row")
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest, lines): SHA-256 of each file's bytes and its lines that are not blank."""
    files = spark.read.format("binaryFile").load(path)
    lines = F.size(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: F.trim(x) != ""))
    return files.select("path", F.sha2("content", 256).alias("digest"), lines.alias("lines"))


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; more than ``most`` rows are an error, since a report is read by people."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows are no report")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in found]) + "\n"
