"""Precision, recall and F1 of the three annotation tasks, all submissions in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.text import with_prefix

ANCESTOR_DECAY, ANCESTOR_DEPTH = 0.8, 5
DESCENDANT_DECAY, DESCENDANT_DEPTH = 0.7, 3


def assert_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``, or an error when a key occurs twice."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    marked = counted.select(*keys, F.when(F.col("_n") > 1, F.raise_error(F.lit(f"duplicate {what}")).cast("int")).otherwise(F.lit(1)).alias("_one"))
    return df.join(marked, keys).where("_one = 1").drop("_one")


def scores(right: Column, annotated: Column, gold: Column) -> list[Column]:
    """Precision, recall and F1; a zero denominator gives 0."""
    p = F.when(annotated > 0, right / annotated).otherwise(F.lit(0.0))
    r = F.when(gold > 0, right / gold).otherwise(F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1")]


def _with_total(each: DataFrame, gold: DataFrame) -> DataFrame:
    """Each submission with the number of gold keys: one row joins on a constant."""
    total = gold.agg(F.count("*").alias("gold_n")).withColumn("_all", F.lit(1))
    return each.withColumn("_all", F.lit(1)).join(total, "_all").drop("_all")


def last_gold(gold: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One gold row for each key: the last wins."""
    return gold.groupBy(*keys).agg(F.max_by(value, order).alias("gold"))


def cell_scores(submissions: DataFrame, gold: DataFrame, keys: list[str], prefix: str, several: bool, by: list[str] | None = None) -> DataFrame:
    """CEA (``several``: the gold holds one or more URLs) or CPA (one property). Rows outside the gold are ignored; a repeated gold cell is an error.

    ``submissions`` has the keys and ``annotation``; ``gold`` the keys and ``gold``; ``by`` names the submission.
    """
    by = by or []
    met = assert_unique(submissions.join(gold, keys), [*by, *keys], "annotation of a gold key")
    said = F.lower(with_prefix(F.col("annotation"), prefix))
    right = F.array_contains(F.split(F.lower("gold"), r"\s+"), said) if several else F.lower("gold") == said
    each = met.groupBy(*by).agg(F.count("*").alias("annotated"), F.count_if(right).cast("double").alias("right"))
    return _with_total(each, gold).select(*by, *scores(F.col("right"), F.col("annotated"), F.col("gold_n")))


def type_scores(submissions: DataFrame, gold: DataFrame, hierarchy: DataFrame, prefix: str, by: list[str] | None = None) -> DataFrame:
    """CTA: exact type 1, else an ancestor 0.8^depth to depth 5, else a descendant 0.7^depth to depth 3; the best gold type of a column counts.

    Every submitted row counts as annotated, in the gold or not; a repeated
    column is an error. ``hierarchy`` is ``(gt_type, rel, kind, depth)``.
    """
    by = by or []
    keys = ["tab_id", "col_id"]
    said = assert_unique(submissions, [*by, *keys], "column").withColumn("said", F.lower(with_prefix(F.col("annotation"), prefix)))
    types = gold.select(*keys, F.explode(F.split(F.trim("gold"), r"\s+")).alias("gt_type"))
    near = hierarchy.select(F.lower("gt_type").alias("gt_low"), F.lower("rel").alias("said"), "kind", "depth")
    up = near.where("kind = 'ancestor'").groupBy("gt_low", "said").agg(F.min("depth").alias("up"))
    down = near.where("kind = 'descendant'").groupBy("gt_low", "said").agg(F.min("depth").alias("down"))
    met = said.join(types, keys, "left").withColumn("gt_low", F.lower("gt_type"))
    full = met.join(up, ["gt_low", "said"], "left").join(down, ["gt_low", "said"], "left")
    score = (
        F.when(F.col("gt_low") == F.col("said"), 1.0)
        .when(F.col("up").isNotNull(), F.when(F.col("up") <= ANCESTOR_DEPTH, F.pow(F.lit(ANCESTOR_DECAY), F.col("up"))).otherwise(0.0))
        .when(F.col("down").isNotNull(), F.when(F.col("down") <= DESCENDANT_DEPTH, F.pow(F.lit(DESCENDANT_DECAY), F.col("down"))).otherwise(0.0))
        .otherwise(0.0)
    )
    column = full.groupBy(*by, *keys).agg(F.max(score).alias("best"))
    each = column.groupBy(*by).agg(F.count("*").alias("annotated"), F.sum("best").alias("right"))
    return _with_total(each, gold).select(*by, *scores(F.col("right"), F.col("annotated"), F.col("gold_n")))


def hierarchy_pairs(below: DataFrame, prefix: str) -> DataFrame:
    """``(gt_type, rel, kind, depth)`` from ``(ancestor, node_id, distance)``: both directions of the closure."""
    url = lambda c: F.concat(F.lit(prefix + "Q"), F.col(c).cast("string"))
    up = below.select(url("node_id").alias("gt_type"), url("ancestor").alias("rel"), F.lit("ancestor").alias("kind"), F.col("distance").alias("depth"))
    down = below.select(url("ancestor").alias("gt_type"), url("node_id").alias("rel"), F.lit("descendant").alias("kind"), F.col("distance").alias("depth"))
    return up.unionByName(down)
