"""Queries of the training-data operators; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import leakage, mapping, overlap, setjoin, textform, tokenizer, variants
from cellweave.runtime import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.expand(*setjoin.similar_sets(table(spark, folder, "candidate")))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record with four or more values: its class of equal sets, and the number of other classes it is linked to."""
    members, links = setjoin.similar_sets(table(spark, folder, "candidate"))
    ends = links.select(F.explode(F.array("key_a", "key_b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(ends, "class", "left").select(F.col("key").alias("id"), "class", F.coalesce("links", F.lit(0)).alias("links"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.repeated_tables(table(spark, folder, "table_rows")).select("tab_a", "tab_b")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(overlap.repeated_tables(table(spark, folder, "table_rows")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return variants.same_entity(p6_entities(spark, folder))


def p6_entities(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each labelled row: the entity it names."""
    return variants.entities(table(spark, folder, "vals_labeled"), table(spark, folder, "name_form"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return mapping.mapped(table(spark, folder, "cea_gt"), table(spark, folder, "kg_item"))


def p7_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return mapping.unmatched(table(spark, folder, "cea_gt"), p7_found(spark, folder))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, folder, "documents"))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Documents decoded from their ids, with whether the text came back unchanged."""
    docs = table(spark, folder, "documents")
    back = tokenizer.decode_corpus(p8_ids(spark, folder)).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").select("doc_id", F.md5("decoded").alias("digest"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leak_report(p9_found(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return textform.same_look(table(spark, folder, "documents"))


def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document: the class of its look, and the number of documents it is linked to."""
    return textform.look_classes(table(spark, folder, "documents"))


def p10_text(spark: SparkSession, folder: str) -> DataFrame:
    return textform.canonical_text(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p3_found, p3_classes, p4_found, p4_report, p6_found, p6_entities, p7_found, p7_unmatched, p8_ids, p8_decoded, p9_found, p9_items, p10_found, p10_classes, p10_text)
}
