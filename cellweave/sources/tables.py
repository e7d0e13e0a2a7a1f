"""File sources of the pipeline, each with a fixed schema."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators.suggestion import searches

_NAME = r"([^/]+?)(\.[^./]+)?$"


def csv_cells(spark: SparkSession, folder: str) -> DataFrame:
    """``(table_id, row, col, mention)`` of all CSV tables in a folder.

    The header is row 0; quoted commas and line breaks are honoured; ragged rows
    keep their own width; an empty cell is ``''``. Files are read whole, so row
    numbers hold whatever the file's splits would be.
    """
    files = spark.read.text(f"{folder}/*.csv", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), _NAME, 1).alias("table_id"), "value")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                (t, i, j, cell)
                for t, body in zip(pdf["table_id"], pdf["value"], strict=True)
                for i, line in enumerate(csv.reader(io.StringIO(body.removeprefix("\ufeff"), newline="")))
                for j, cell in enumerate(line)
            ]
            yield pd.DataFrame(out, columns=["table_id", "row", "col", "mention"])

    return files.mapInPandas(parse, "table_id string, row int, col int, mention string")


def annotations(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A headerless annotation file or folder: all text, missing values as ``''``, plus ``file``."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("multiLine", True).option("escape", '"').csv(path, header=False)
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns), F.col("_metadata.file_name").alias("file"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """``(table_id, row, col, url)``; positions as numbers."""
    rows = annotations(spark, path, ["table_id", "row", "col", "url"])
    return rows.select("table_id", F.col("row").try_cast("int").alias("row"), F.col("col").try_cast("int").alias("col"), "url")


def type_hierarchy(spark: SparkSession, ancestors: str, descendants: str) -> DataFrame:
    """``(gt_type, rel, kind, depth)`` from the two JSON maps of maps."""

    def one(path: str, kind: str) -> DataFrame:
        doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
        outer = doc.select(F.explode("m").alias("gt_type", "inner"))
        return outer.select("gt_type", F.explode("inner").alias("rel", "d")).select("gt_type", "rel", F.lit(kind).alias("kind"), F.col("d").try_cast("int").alias("depth"))

    return one(ancestors, "ancestor").unionByName(one(descendants, "descendant"))


def search_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Stored web answers of a folder of JSON files, ready for ``suggestion.lookup``; the first file by name wins."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("response_id"), F.col("value").alias("body"))
    return searches(files.withColumn("received_at", F.lit(None).cast("timestamp")))


def dump(spark: SparkSession, path: str) -> DataFrame:
    """A stored stage."""
    return spark.read.parquet(path)

