"""Queries of the general data-processing operators; each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import hierarchy, nested, rejects
from cellweave.runtime import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    links = hierarchy.class_links(table(spark, folder, "candidate"))
    return hierarchy.hierarchy(links, paths=False).select("node_id", "root_id", "depth")


def p1_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every class with its path from the root, as text, and whether its link closes a cycle."""
    walked = hierarchy.hierarchy(hierarchy.class_links(table(spark, folder, "candidate")))
    return walked.select("node_id", F.array_join("path", "/").alias("path"), "depth", "root_id", "back_edge")


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(hierarchy.class_links(table(spark, folder, "candidate"))))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flat_tables(table(spark, folder, "raw_response"))


def _child(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return nested.flat_table(nested.child_arrays(table(spark, folder, "raw_response")), name)

    return query


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.errors(rejects.records(table(spark, folder, "raw_line")))


def p5_valid(spark: SparkSession, folder: str) -> DataFrame:
    recs = rejects.records(table(spark, folder, "raw_line"))
    return rejects.valid_rows(recs, rejects.errors(recs))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p2_found, p5_found, p5_valid)} | {
    f"p2_{name}": _child(name) for name in ("query", "page", "link", "hit", "display", "alias")
}
