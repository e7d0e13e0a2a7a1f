"""The annotation pipeline as a chain of DataFrames: from cells to accuracy."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators import candidates, cells, entities, features, linking, suggestion
from cellweave.runtime import cut


class Annotated(NamedTuple):
    """The stages of one run; each is lazy but those that several others read."""

    dataset: DataFrame
    corrected: DataFrame
    found: DataFrame
    featured: DataFrame
    chosen: DataFrame
    accuracy: DataFrame


def annotate(rows: DataFrame, gold: DataFrame, fetched: DataFrame, items: DataFrame, responses: DataFrame | None = None, variant: str = "raw", limit: int = candidates.LIMIT) -> Annotated:
    """Link the gold cells with the mention as typed (``raw``) or as corrected (``spell``), by the sum of the four features."""
    dataset = cells.open_dataset(rows, gold)
    corrected = dataset.select("mention").distinct().withColumn("suggestion", F.col("mention"))
    if responses is not None:
        corrected = suggestion.suggestions(dataset, suggestion.searches(responses))
    if variant == "spell":
        dataset = dataset.join(corrected, "mention", "left").withColumn("mention", F.coalesce("suggestion", "mention")).drop("suggestion")
    dataset = cut(dataset)
    known = cut(entities.with_items(entities.catalogue(fetched), items))
    found = cut(candidates.cell_candidates(dataset, candidates.top_candidates(dataset, known, limit)))
    featured = features.column_features(found, known)
    scored = featured.withColumn("score", F.col("lex") + F.col("inst") + F.col("subc") + F.col("descr"))
    chosen = linking.best_candidate(scored)
    return Annotated(dataset, corrected, found, featured, chosen, linking.accuracy(dataset, chosen))
