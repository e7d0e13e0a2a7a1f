"""Table cells, gold cells and their grouping into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("col0", "col1", "col2", "col3", "col4")


def rows_once(rows: DataFrame) -> DataFrame:
    """One row for each (tab_id, row_id): the latest delivery as a whole, ties by its cells; merged by partial aggregation.

    Deliveries without ``loaded_at`` come before all others.
    """
    keyed = rows.where("tab_id is not null and row_id is not null")
    latest = keyed.groupBy("tab_id", "row_id").agg(F.max(F.struct(loaded_at(rows), *COLUMNS)).alias("r"))
    return latest.select("tab_id", "row_id", *(F.col(f"r.{c}").alias(c) for c in COLUMNS))


def loaded_at(rows: DataFrame) -> Column:
    """The time of a delivery; null where the table has no such column."""
    return F.col("loaded_at") if "loaded_at" in rows.columns else F.lit(None).cast("timestamp").alias("loaded_at")


def cells(rows: DataFrame) -> DataFrame:
    """``(tab_id, row, col, mention)``: the cells a table has; null cells don't exist, empty ones do."""
    wide = rows_once(rows)
    parts = F.array(*(F.struct(F.lit(i).alias("col"), F.col(c).alias("mention")) for i, c in enumerate(COLUMNS)))
    return wide.select("tab_id", F.col("row_id").alias("row"), F.inline(parts)).where("mention is not null")


def entity_ids(text: Column) -> Column:
    """All entity numbers in a gold text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit("[Qq]([0-9]+)"), 1), lambda x: x.try_cast("bigint"))


def gold_cells(gold: DataFrame) -> DataFrame:
    """``(tab_id, row, col, ids, correct_id)``: gold per cell. Keys lose their other spellings; of several rows of a cell the largest gt_id counts, in its latest delivery.

    ``correct_id`` is the last id named; rows without an id, a table id or numeric positions are left out.
    """
    latest = gold.where("gt_id is not null").groupBy("gt_id").agg(F.max(F.struct(loaded_at(gold), "tab_id", "row_id", "col_id", "entity")).alias("r"))
    once = latest.select("gt_id", "r.*")
    read = once.select(
        "gt_id",
        F.upper(F.regexp_extract("tab_id", "([0-9A-Za-z]{8})", 1)).alias("tab_id"),
        F.trim("row_id").try_cast("int").alias("row"),
        F.trim("col_id").try_cast("int").alias("col"),
        entity_ids(F.col("entity")).alias("ids"),
    ).where("tab_id <> '' and row is not null and col is not null and size(ids) > 0")
    last = read.groupBy("tab_id", "row", "col").agg(F.max(F.struct("gt_id", "ids")).alias("g"))
    return last.select("tab_id", "row", "col", F.col("g.ids").alias("ids"), F.element_at("g.ids", -1).alias("correct_id"))


def open_dataset(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """``(tab_id, row, col, mention, correct_id)``: gold cells with their text."""
    return cells(rows).join(gold_cells(gold).drop("ids"), ["tab_id", "row", "col"])


def columns_grouped(dataset: DataFrame) -> DataFrame:
    """``(tab_id, col, n, cells)``: each column with its cells in row order."""
    listed = F.sort_array(F.collect_list(F.struct("row", "mention")))
    return dataset.groupBy("tab_id", "col").agg(F.count("*").alias("n"), listed.alias("cells"))


def target_cells(targets: DataFrame, all_cells: DataFrame) -> DataFrame:
    """Cells of the distinct target keys."""
    return targets.select("tab_id", "row", "col").dropDuplicates().join(all_cells, ["tab_id", "row", "col"])


def without(gold: DataFrame, denied: DataFrame, key: str) -> DataFrame:
    """Gold rows whose ``key`` is not in the deny list; null keys stay."""
    return gold.join(denied.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def cell_key(tab: Column, row: Column, col: Column) -> Column:
    """The name under which a cell's response is stored."""
    return F.concat_ws("_", tab, row, col)
