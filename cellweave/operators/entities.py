"""Knowledge-graph entities: nested JSON to flat rows, claims and class arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LABELS = "map<string,struct<value:string>>"
_CLAIM = "array<struct<mainsnak:struct<snaktype:string,datatype:string,property:string,datavalue:struct<value:string>>>>"
ENTITY_SCHEMA = f"labels {_LABELS}, descriptions {_LABELS}, claims map<string,{_CLAIM}>"
#: Properties that hold an entity's classes.
INSTANCE_OF, SUBCLASS_OF = "P31", "P279"


def parse(raw: DataFrame, body: str = "body", lang: str = "en") -> DataFrame:
    """``(id, title, description, claims)``: missing label or description gives null; the body is read with a fixed schema."""
    doc = F.from_json(body, ENTITY_SCHEMA)
    read = raw.select("id", doc.alias("doc"))
    return read.select(
        "id",
        F.element_at("doc.labels", lang)["value"].alias("title"),
        F.element_at("doc.descriptions", lang)["value"].alias("description"),
        claim_pairs(F.col("doc.claims")).alias("claims"),
    )


def claim_pairs(claims: Column) -> Column:
    """Array of (property, target) of the item claims; novalue, somevalue, other types and incomplete claims are skipped."""
    flat = F.flatten(F.map_values(claims))
    target = lambda c: F.get_json_object(c["mainsnak"]["datavalue"]["value"], "$.id")
    kept = F.filter(
        flat,
        lambda c: ~c["mainsnak"]["snaktype"].isin("novalue", "somevalue")
        & (c["mainsnak"]["datatype"] == "wikibase-item")
        & c["mainsnak"]["property"].isNotNull()
        & target(c).isNotNull(),
    )
    return F.coalesce(F.transform(kept, lambda c: F.struct(c["mainsnak"]["property"].alias("property"), target(c).alias("target"))), F.array())


def targets(claims: Column, prop: str) -> Column:
    """Numbers of the targets of one property, order and duplicates kept."""
    return F.transform(F.filter(claims, lambda c: c["property"] == prop), lambda c: F.substring(c["target"], 2, 40).try_cast("bigint"))


def as_json(entities: DataFrame) -> DataFrame:
    """``(id, body)``: entities as the nested JSON a knowledge graph serves."""

    def claim(prop: str, value: Column) -> Column:
        item = F.struct(F.struct(F.concat(F.lit("Q"), value.cast("string")).alias("id")).alias("value"))
        snak = F.struct(F.lit("value").alias("snaktype"), F.lit("wikibase-item").alias("datatype"), F.lit(prop).alias("property"), item.alias("datavalue"))
        return F.struct(snak.alias("mainsnak"))

    def listed(prop: str, column: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<bigint>")), lambda v: claim(prop, v))

    label = lambda c: F.when(F.col(c).isNotNull(), F.create_map(F.lit("en"), F.struct(F.col(c).alias("value"))))
    claims = F.create_map(F.lit(INSTANCE_OF), listed(INSTANCE_OF, "instances"), F.lit(SUBCLASS_OF), listed(SUBCLASS_OF, "subclasses"))
    return entities.select("id", F.to_json(F.struct(label("title").alias("labels"), label("description").alias("descriptions"), claims.alias("claims"))).alias("body"))


def catalogue(candidates: DataFrame) -> DataFrame:
    """``(id, title, description, instances, subclasses)``: one row for each id, its latest fetch as a whole, ties by content; null texts become ''."""
    none = F.array().cast("array<bigint>")
    sets = (F.array_sort(F.coalesce(c, none)).alias(c) for c in ("instances", "subclasses"))
    when = F.col("fetched_at") if "fetched_at" in candidates.columns else F.lit(None).cast("timestamp").alias("fetched_at")
    latest = candidates.where("id is not null").groupBy("id").agg(F.max(F.struct(when, "title", "description", *sets)).alias("r"))
    text = lambda c: F.coalesce(f"r.{c}", F.lit("")).alias(c)
    return latest.select("id", text("title"), text("description"), "r.instances", "r.subclasses")


def with_items(known: DataFrame, items: DataFrame) -> DataFrame:
    """The catalogue and the reference items it doesn't hold (without classes)."""
    none = F.array().cast("array<bigint>")
    more = items.where("kind = 'item'").groupBy(F.substring("item_id", 2, 40).try_cast("bigint").alias("id")).agg(
        F.coalesce(F.max("label"), F.lit("")).alias("title"), F.coalesce(F.max("description"), F.lit("")).alias("description")
    )
    return known.unionByName(more.join(known.select("id"), "id", "left_anti").select("id", "title", "description", none.alias("instances"), none.alias("subclasses")))
