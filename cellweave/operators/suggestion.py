"""Spelling suggestions from stored search answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.text import best_title_match, html_unescape
from cellweave.operators.nested import deliveries


def searches(responses: DataFrame) -> DataFrame:
    """``(asked, response_id, altered, has_pages, titles)``: one stored web answer for each question, lower-cased; the smallest response id wins.

    Broken bodies and answers of another kind are left out; a single page counts
    as a list of one; titles keep their order.
    """
    docs = deliveries(responses)
    pages = "try_variant_get(doc, '$.webPages.value', 'variant')"
    listed = (
        f"case when {pages} is null or is_variant_null({pages}) then null"
        f" when schema_of_variant({pages}) like 'ARRAY%' then try_variant_get(doc, '$.webPages.value', 'array<variant>') else array({pages}) end"
    )
    found = docs.select(
        F.expr("lower(try_variant_get(doc, '$.queryContext.originalQuery', 'string'))").alias("asked"),
        "response_id",
        F.expr("try_variant_get(doc, '$.queryContext.alteredQuery', 'string')").alias("altered"),
        F.expr("try_variant_get(doc, '$._type', 'string')").alias("type"),
        F.expr(listed).alias("pages"),
    ).where("type = 'SearchResponse' and asked is not null")
    titles = F.transform("pages", lambda p: F.try_variant_get(p, "$.name", "string"))
    one = found.select("asked", F.struct("response_id", "altered", titles.alias("titles")).alias("r"), "response_id")
    first = one.groupBy("asked").agg(F.min_by("r", "response_id").alias("r"))
    return first.select("asked", "r.response_id", "r.altered", "r.titles")


def lookup(mentions: DataFrame, stored: DataFrame) -> DataFrame:
    """``mentions(mention)`` with the stored answer to the same question, case ignored; nulls where there is none."""
    return mentions.join(stored, F.lower("mention") == F.col("asked"), "left")


def suggestions(mentions: DataFrame, stored: DataFrame) -> DataFrame:
    """``(mention, suggestion)`` of the distinct mentions.

    Without an answer or pages: the mention. With an altered question that some
    title contains: that question. Otherwise the closest word subset of a title.
    Entities are unescaped in what was taken from an answer.
    """
    asked = lookup(mentions.select("mention").where("mention is not null").distinct(), stored)
    there = F.col("titles").isNotNull()
    confirmed = F.coalesce(F.exists("titles", lambda t: F.contains(t, F.col("altered"))), F.lit(False))
    taken = F.when(there & confirmed, F.col("altered")).when(there, best_title_match("mention", "titles"))
    return asked.select("mention", F.coalesce(html_unescape(taken), F.col("mention")).alias("suggestion"))
