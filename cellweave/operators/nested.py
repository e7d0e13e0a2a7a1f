"""Nested JSON answers as flat child tables, by higher-order projection.

Each body is parsed once to a VARIANT. Nested ``transform`` calls carry the
response id and the positions of the ancestors down to each child, ``flatten``
joins the arrays of one response, and one ``inline`` per target table emits the
rows. Nothing is shuffled but the duplicate deliveries of a response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROW = "array<struct<child:string,pos1:int,pos2:int,val:string>>"


def deliveries(responses: DataFrame) -> DataFrame:
    """One body for each response: the latest delivery that can be parsed, ties by the body's text.

    Rows without response id are left out. Bodies that are null, empty, cut off
    or otherwise not JSON have no row. Where an object repeats a key the last
    value counts; the session's parser is set to accept such objects.
    """
    responses.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # The parser ignores what follows a value; inside both kinds of bracket nothing can follow unnoticed.
    whole = "try_parse_json(concat('[', body, ']')) is not null and try_parse_json(concat('{\"x\":', body, '}')) is not null"
    good = responses.where("response_id is not null").where(whole).select("response_id", F.struct("received_at", "body").alias("version"))
    latest = good.groupBy("response_id").agg(F.max("version").alias("version"))
    return latest.select("response_id", F.expr("try_parse_json(version.body)").alias("doc"))


def _text(path: str, of: str = "doc") -> Column:
    return F.expr(f"coalesce(try_variant_get({of}, '{path}', 'string'), '')")


def _elements(path: str, of: str = "doc") -> Column:
    """The array at ``path``; a single value counts as an array of one, null or nothing as an empty one."""
    value = f"try_variant_get({of}, '{path}', 'variant')"
    return F.expr(
        f"case when {value} is null or is_variant_null({value}) then cast(array() as array<variant>)"
        f" when schema_of_variant({value}) like 'ARRAY%' then coalesce(try_variant_get({of}, '{path}', 'array<variant>'), cast(array() as array<variant>))"
        f" else array({value}) end"
    )


def _child(name: str, pos1: Column, pos2: Column, val: Column) -> Column:
    return F.struct(F.lit(name).alias("child"), pos1.cast("int").alias("pos1"), pos2.cast("int").alias("pos2"), val.alias("val"))


def _get(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "string"), F.lit(""))


def _inner(value: Column, path: str) -> Column:
    """As ``_elements``, inside a lambda."""
    part = F.try_variant_get(value, path, "variant")
    none = F.array().cast("array<variant>")
    return (
        F.when(part.isNull() | F.is_variant_null(part), none)
        .when(F.schema_of_variant(part).startswith("ARRAY"), F.coalesce(F.try_variant_get(value, path, "array<variant>"), none))
        .otherwise(F.array(part))
    )


def child_arrays(responses: DataFrame) -> DataFrame:
    """``(response_id, query, page, link, hit, display, alias)``: the arrays of child structs of each response."""
    none = F.lit(-1)
    docs = deliveries(responses).select(
        "response_id",
        F.expr("coalesce(try_variant_get(doc, '$.queryContext.originalQuery', 'string'), try_variant_get(doc, '$.searchinfo.search', 'string'), '')").alias("asked"),
        _elements("$.webPages.value").alias("pages"),
        _elements("$.search").alias("hits"),
    )
    label = lambda h: F.try_variant_get(h, "$.display.label", "variant")
    return docs.select(
        "response_id",
        F.array(_child("query", none, none, F.col("asked"))).alias("query"),
        F.transform("pages", lambda p, i: _child("page", i, none, _get(p, "$.name"))).alias("page"),
        F.flatten(
            F.transform("pages", lambda p, i: F.transform(_inner(p, "$.deepLinks"), lambda d, j: _child("link", i, j, _get(d, "$.name"))))
        ).alias("link"),
        F.transform("hits", lambda h, i: _child("hit", i, none, _get(h, "$.id"))).alias("hit"),
        F.flatten(
            F.transform(
                "hits",
                lambda h, i: F.when(
                    label(h).isNotNull() & ~F.is_variant_null(label(h)), F.array(_child("display", i, none, _get(h, "$.display.label.value")))
                ).otherwise(F.array().cast(_ROW)),
            )
        ).alias("display"),
        F.flatten(F.transform("hits", lambda h, i: F.transform(_inner(h, "$.aliases"), lambda a, j: _child("alias", i, j, _get(a, "$"))))).alias("alias"),
    )


def flat_table(arrays: DataFrame, child: str) -> DataFrame:
    """One target table: ``(response_id, child, pos1, pos2, val)``."""
    return arrays.select("response_id", F.inline(child))


def flat_tables(responses: DataFrame) -> DataFrame:
    """All target tables together. ``pos1`` and ``pos2`` count from 0, -1 where unused; a missing or null field gives ``''``."""
    arrays = child_arrays(responses)
    together = F.concat(*(F.col(c) for c in ("query", "page", "link", "hit", "display", "alias")))
    return arrays.select("response_id", F.inline(together))
