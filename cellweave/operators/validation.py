"""Strict validation of knowledge-graph search answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of an answer and of its parts, and those of a hit that must be text.
TOP = ("searchinfo", "search", "search_continue", "success")
HIT = ("id", "title", "pageid", "display", "repository", "url", "concepturi", "label", "description", "match", "aliases")
HIT_TEXT = ("id", "title", "repository", "url", "concepturi", "label")
IN_LANGUAGE = ("value", "language")
MATCH_KINDS = ("label", "alias")


def _kind(value: Column, path: str) -> Column:
    """Type of a field, as VARIANT names it; null where the field is missing."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _is_text(value: Column, path: str) -> Column:
    return F.coalesce(_kind(value, path) == "STRING", F.lit(False))


def _is_whole(value: Column, path: str) -> Column:
    return F.coalesce(_kind(value, path).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), F.lit(False))


def _object(value: Column, path: str, allowed: tuple[str, ...]) -> Column:
    """Whether there is an object at ``path`` that has no other fields than those."""
    keys = F.json_object_keys(F.to_json(F.try_variant_get(value, path, "variant")))
    return F.coalesce(F.startswith(_kind(value, path), F.lit("OBJECT")) & (F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0), F.lit(False))


def _texts(value: Column, path: str, fields: tuple[str, ...]) -> Column:
    """Whether all these fields of the object at ``path`` are text."""
    return F.forall(F.array(*(_is_text(value, f"{path}.{c}") for c in fields)), lambda ok: ok)


def _in_language(value: Column, path: str) -> Column:
    return _object(value, path, IN_LANGUAGE) & _texts(value, path, IN_LANGUAGE)


def hit_reason(hit: Column, repository: str) -> Column:
    """First rule a hit breaks, or null. A field that is there but null is of the wrong type."""
    missing = lambda p: _kind(hit, p).isNull()
    display = _object(hit, "$.display", ("label", "description")) & _in_language(hit, "$.display.label") & (missing("$.display.description") | _in_language(hit, "$.display.description"))
    kind = F.coalesce(F.try_variant_get(hit, "$.match.type", "string").isin(*MATCH_KINDS), F.lit(False))
    match = _object(hit, "$.match", ("type", "language", "text")) & kind & _texts(hit, "$.match", ("language", "text"))
    listed = F.try_variant_get(hit, "$.aliases", "array<variant>")
    aliases = missing("$.aliases") | F.coalesce(F.startswith(_kind(hit, "$.aliases"), F.lit("ARRAY")) & F.forall(listed, lambda a: F.coalesce(F.schema_of_variant(a) == "STRING", F.lit(False))), F.lit(False))
    return (
        F.when(~F.coalesce(F.startswith(_kind(hit, "$"), F.lit("OBJECT")), F.lit(False)), "hit: not an object")
        .when(~_object(hit, "$", HIT), "hit: unknown field")
        .when(~_texts(hit, "$", HIT_TEXT), "hit: text field")
        .when(~_is_whole(hit, "$.pageid"), "hit: pageid")
        .when(F.try_variant_get(hit, "$.repository", "string") != repository, "hit: repository")
        .when(~display, "hit: display")
        .when(~match, "hit: match")
        .when(~(missing("$.description") | _is_text(hit, "$.description")), "hit: description")
        .when(~aliases, "hit: aliases")
    )


def validated(docs: DataFrame, repository: str = "wikidata") -> DataFrame:
    """``(response_id, is_valid, reason)`` of parsed answers ``(response_id, doc)``: required fields, types, fixed values, and no unknown fields at any level."""
    doc = F.col("doc")
    hits = F.coalesce(F.try_variant_get(doc, "$.search", "array<variant>"), F.array().cast("array<variant>"))
    broken = F.element_at(F.array_append(F.filter(F.transform(hits, lambda h: hit_reason(h, repository)), lambda r: r.isNotNull()), F.lit(None).cast("string")), 1)
    top = (
        F.when(~_kind(doc, "$").startswith("OBJECT"), "not an object")
        .when(~_object(doc, "$", TOP), "unknown field")
        .when(~(_object(doc, "$.searchinfo", ("search",)) & _is_text(doc, "$.searchinfo.search")), "searchinfo")
        .when(~F.coalesce(_kind(doc, "$.search").startswith("ARRAY"), F.lit(False)), "search")
        .when(_kind(doc, "$.search_continue").isNotNull() & ~_is_whole(doc, "$.search_continue"), "search_continue")
        .when(~F.coalesce(F.try_variant_get(doc, "$.success", "int") == 1, F.lit(False)), "success")
    )
    reason = F.coalesce(top, broken)
    return docs.select("response_id", reason.isNull().alias("is_valid"), reason.alias("reason"))
