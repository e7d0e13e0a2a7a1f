"""Received records split into loadable rows and rejects with a reason.

Records are cut into cells with array expressions alone, exploded to
(line, position, value), joined with a small rule table, and the errors are
aggregated per line; clean lines are the anti-join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of each feed, and the rule each field must meet.
RULES = [
    ("cea_gt", 0, "tab_id", "table_id"),
    ("cea_gt", 1, "row_id", "digits"),
    ("cea_gt", 2, "col_id", "digits"),
    ("cea_gt", 3, "entity", "not_blank"),
    ("tables", 0, "tab_id", "table_id"),
    ("tables", 1, "row_id", "digits"),
    ("tables", 2, "col0", "any"),
    ("tables", 3, "col1", "number_or_empty"),
]
FIELDS = 4
#: Reasons in the order in which the first one is reported.
REASONS = ["quoting", "column_count", "invalid_value", "unknown_feed"]
#: An escape sign, and what it and a quoted comma are written as while a record is cut.
_ESCAPE, _SIGN, _COMMA = "\x01", "\x01s", "\x01c"


def _with_pieces(record: Column, what: Callable[[Column, Column], Column]) -> Column:
    """``what`` of the pieces between quotes and the index of the last: bound once, so long records stay linear."""
    pieces = F.split(record, '"', -1)
    bound = F.array(F.struct(pieces.alias("p"), (F.size(pieces) - 1).alias("last")))
    return F.element_at(F.transform(bound, lambda x: what(x["p"], x["last"])), 1)


def quoting_ok(record: Column) -> Column:
    """Whether quotes stand only around whole fields, closed and doubled inside.

    Cut at quotes, pieces with an even index lie outside. Between two quoted
    stretches such a piece is empty (a doubled quote) or begins and ends at a comma.
    """

    def well(parts: Column, last: Column) -> Column:
        inner = F.forall(
            F.transform(parts, lambda s, i: (i % 2 == 1) | (i == 0) | (i == last) | (s == "") | (s.startswith(",") & s.endswith(","))), lambda ok: ok
        )
        first, end = F.element_at(parts, 1), F.element_at(parts, -1)
        return (last == 0) | ((last % 2 == 0) & ((first == "") | first.endswith(",")) & ((end == "") | end.startswith(",")) & inner)

    return _with_pieces(record, well)


def cells_of(record: Column) -> Column:
    """The fields of a well-quoted record, without their quotes."""

    def cut_up(parts: Column, last: Column) -> Column:
        swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
        escaped = F.transform(parts, lambda s: swap(s, _ESCAPE, _SIGN))
        masked = F.transform(
            escaped,
            lambda s, i: F.when(i % 2 == 1, swap(s, ",", _COMMA)).when((s == "") & (i > 0) & (i < last), F.lit('"')).otherwise(s),
        )
        return F.transform(F.split(F.array_join(masked, ""), ",", -1), lambda c: swap(swap(c, _COMMA, ","), _SIGN, _ESCAPE))

    return _with_pieces(record, cut_up)


def records(lines: DataFrame) -> DataFrame:
    """``(line_id, feed, record, quoted, cells)``, one for each line id: the first delivery by time, then by text.

    A null line counts as an empty record. A carriage return at the end is cut.
    """
    first = F.min(F.struct("received_at", F.coalesce("line", F.lit("")).alias("line"), "feed")).alias("got")
    one = lines.where("line_id is not null").groupBy("line_id").agg(first)
    record = F.regexp_replace("got.line", r"\r\z", "")
    named = one.select("line_id", F.col("got.feed").alias("feed"), record.alias("record"))
    return named.withColumn("quoted", quoting_ok(F.col("record"))).withColumn("cells", F.when(F.col("quoted"), cells_of(F.col("record"))))


def _passes(rule: Column, value: Column) -> Column:
    return (
        F.when(rule == "table_id", value.rlike(r"\A[0-9A-Z]{8}\z"))
        .when(rule == "digits", value.rlike(r"\A[0-9]+\z"))
        .when(rule == "not_blank", ~value.rlike(r"(?U)\A[\s\p{Cf}]*\z"))
        .when(rule == "number_or_empty", value.rlike(r"\A([+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?)?\z"))
        .otherwise(F.lit(True))
    )


def errors(recs: DataFrame) -> DataFrame:
    """``(line_id, reason)``: the first reason of each line that cannot be loaded; a feed without rules, or none, is one of them."""
    rules = recs.sparkSession.createDataFrame(RULES, "feed string, pos int, field string, rule string")
    shape = recs.select("line_id", F.when(~F.col("quoted"), 0).when(F.size("cells") != FIELDS, 1).alias("rank")).where("rank is not null")
    exploded = recs.where(F.col("quoted") & (F.size("cells") == FIELDS)).select("line_id", "feed", F.posexplode("cells").alias("pos", "value"))
    ruled = exploded.join(F.broadcast(rules), ["feed", "pos"], "left")
    rank = F.when(F.col("rule").isNull(), 3).when(~_passes(F.col("rule"), F.col("value")), 2)
    broken = ruled.select("line_id", rank.alias("rank")).where("rank is not null")
    worst = shape.unionByName(broken).groupBy("line_id").agg(F.min("rank").alias("rank"))
    return worst.select("line_id", F.element_at(F.array(*map(F.lit, REASONS)), F.col("rank") + 1).alias("reason"))


def valid_rows(recs: DataFrame, failed: DataFrame) -> DataFrame:
    """``(line_id, feed, tab_id, row_id, col_id, entity, col0, col1)`` of the lines without error, all as text; fields of the other feed are null."""
    clean = recs.join(failed.select("line_id"), "line_id", "left_anti")
    cell = lambda feed, i: F.when(F.col("feed") == feed, F.element_at("cells", i + 1))
    return clean.select(
        "line_id",
        "feed",
        F.element_at("cells", 1).alias("tab_id"),
        F.element_at("cells", 2).alias("row_id"),
        cell("cea_gt", 2).alias("col_id"),
        cell("cea_gt", 3).alias("entity"),
        cell("tables", 2).alias("col0"),
        cell("tables", 3).alias("col1"),
    )
