"""Sinks of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str) -> None:
    """A named stage; an older one is replaced."""
    df.write.mode("overwrite").parquet(path)


def save_run(df: DataFrame, path: str, stamp: str) -> None:
    """A stage of one run, kept beside those of other runs; the stamp is the partition."""
    df.withColumn("run", F.lit(stamp)).write.mode("append").partitionBy("run").parquet(path)


def save_slot(df: DataFrame, path: str, number: int, slots: int = 9) -> None:
    """The ``number``-th state of a long run, in one of ``slots`` folders taken in turn; ``resume`` reads the newest."""
    df.withColumn("number", F.lit(number)).write.mode("overwrite").partitionBy("number").parquet(f"{path}/slot={number % slots + 1}")


def resume(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Number and content of the newest state that was saved in slots."""
    every = spark.read.parquet(path)
    number = every.agg(F.max("number")).first()[0]
    return number, every.where(F.col("number") == number).drop("slot", "number")


def append_csv(df: DataFrame, path: str) -> None:
    """Lines added to a CSV folder, every value quoted, quotes doubled, blanks at the ends kept."""
    df.write.mode("append").csv(path, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def save_cell_json(df: DataFrame, path: str) -> None:
    """Responses ``(key, body)`` as JSON lines in one folder per table, the first part of the key."""
    parts = df.select(F.split("key", "_")[0].alias("tab_id"), F.to_json(F.struct("key", "body")).alias("value"))
    parts.write.mode("append").partitionBy("tab_id").text(path)


def show_candidates(df: DataFrame, rows: int = 20) -> None:
    """Candidates on the console."""
    df.select("entity_id", "title", "description", "instances", "subclasses").show(rows, truncate=60)
