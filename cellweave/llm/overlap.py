"""Evaluation tables that turn up again in the training split.

Passages are the folded first-column values of the evaluation tables. Each is
cut in two inside its particular words; a value with at most one slip keeps one
part unharmed, or is the passage with the two letters at the cut exchanged.
These patterns are sharded by their outer letters and each shard is compiled
into one Aho-Corasick automaton, which scans the training values that begin or
end with the shard's letters. Hits are verified, and the matched rows, each an
interval of its training table, are merged into the coverage of each evaluation
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.names import slips, words
from cellweave.runtime import cut, keyed, width

#: Rows of the longer table that must recur, in tenths.
TENTHS = 7
#: Patterns for one automaton, and members of one route beyond which it is salted.
SHARD_PATTERNS = 50_000
ROUTE_PATTERNS = 20_000
#: Training values for one scan of a shard; more are scanned in several tasks.
SHARD_TEXTS = 200_000
#: A word in this share of the values or more doesn't tell values apart.
COMMON_SHARE = 0.005

_START, _END = "\x02", "\x03"
_FOLDED = T.StructType([T.StructField("value", T.StringType()), T.StructField("spelled", T.ArrayType(T.StringType()))])
_PASSAGE = "route string, value string, pattern string"


def table_rows_once(rows: DataFrame) -> DataFrame:
    """``(tab_id, row_id, split, source, value, spelled)``: one row for each delivered key, the latest.

    ``value`` is the folded col0: letters and digits only; it is null where
    nothing is left, and such a row recurs nowhere but counts as a row.
    """
    latest = keyed(rows.where("tab_id is not null and row_id is not null"), "tab_id", "row_id").groupBy("tab_id", "row_id").agg(
        F.max(F.struct("loaded_at", "col0", "split", "source")).alias("r")
    )

    @F.pandas_udf(_FOLDED)
    def folded(texts: pd.Series) -> pd.DataFrame:
        spelled = [words(t) if t else [] for t in texts]
        return pd.DataFrame({"value": ["".join(s) or None for s in spelled], "spelled": spelled}, dtype=object)

    parts = latest.select("tab_id", "row_id", "r.split", "r.source", folded("r.col0").alias("f"))
    return parts.select("tab_id", "row_id", "split", "source", "f.value", "f.spelled")


def common_words(values: DataFrame) -> list[str]:
    """Words in at least ``COMMON_SHARE`` of the values: a few hundred at most, whatever the number of values."""
    total = values.count()
    each = values.select(F.explode(F.array_distinct("spelled")).alias("word")).groupBy("word").count()
    return [r[0] for r in each.where(F.col("count") >= max(3, COMMON_SHARE * total)).select("word").collect()]


def cut_at(spelled: list[str], common: set[str]) -> int:
    """Where a value is cut: in the middle of its longest particular word, else in the middle."""
    best, start, at = 0, 0, None
    for w in spelled:
        if w not in common and len(w) > best:
            best, at = len(w), start + len(w) // 2
        start += len(w)
    size = start
    if at is None or not 0 < at < size:
        at = size // 2
    return at


def patterns(spelled: list[str], common: set[str]) -> list[tuple[str, str]]:
    """``(route, pattern)`` of one passage."""
    value = "".join(spelled)
    if len(value) < 2:
        return [(f"{_START}{value}", f"{_START}{value}{_END}"), (f"^{value[:1]}", f"{_START}{value}"), (f"${value[-1:]}", f"{value}{_END}")]
    at = cut_at(spelled, common)
    swapped = value[: at - 1] + value[at] + value[at - 1] + value[at + 1 :]
    head, tail = value[:at], value[at:]
    return [
        (_head_route(head), _START + head),
        (_tail_route(tail), tail + _END),
        (_head_route(swapped), f"{_START}{swapped}{_END}"),
    ]


#: Outer letters of a piece by which it is routed; shorter pieces go by one letter.
OUTER = 3


def _head_route(piece: str) -> str:
    return "^" + piece[: OUTER if len(piece) >= OUTER else 1]


def _tail_route(piece: str) -> str:
    return "$" + piece[-(OUTER if len(piece) >= OUTER else 1) :]


def same_value(a: str, b: str) -> bool:
    """Equal, or one slip of a letter apart; digits don't slip, and of two single letters none is a slip of the other."""
    if a == b:
        return True
    if len(a) == len(b) == 1 or slips(a, b, 1) > 1:
        return False
    return [c for c in a if c.isdigit()] == [c for c in b if c.isdigit()]


def _scan(key: tuple, passages: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    """One shard: its automaton over all texts routed to it."""
    if passages.empty or texts.empty:
        return pd.DataFrame({"value": pd.Series([], dtype=object), "text": pd.Series([], dtype=object)})
    machine = ahocorasick.Automaton()
    owners: dict[str, list[str]] = {}
    for pattern, value in zip(passages["pattern"], passages["value"], strict=True):
        owners.setdefault(pattern, []).append(value)
    for pattern, values in owners.items():
        machine.add_word(pattern, values)
    machine.make_automaton()
    out_v, out_t = [], []
    for text in dict.fromkeys(texts["text"]):
        met: set[str] = set()
        for _, values in machine.iter(_START + text + _END):
            met.update(values)
        for value in met:
            if same_value(value, text):
                out_v.append(value)
                out_t.append(text)
    return pd.DataFrame({"value": out_v, "text": out_t}, dtype=object)


def matches(passages: DataFrame, texts: DataFrame, common: list[str]) -> DataFrame:
    """``(value, text)``: evaluation and training values that count as the same; inputs are ``(value, spelled)``, distinct."""
    spark = passages.sparkSession
    known = set(common)

    def compiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(route, "".join(s), p) for s in pdf["spelled"] for route, p in patterns(list(s), known)]
            yield pd.DataFrame(rows, columns=["route", "value", "pattern"])

    made = cut(keyed(passages.select("spelled"), "spelled").mapInPandas(compiled, _PASSAGE))
    ends = [F.concat(F.lit("^"), F.substring("value", 1, k)) for k in (OUTER, 1)] + [F.concat(F.lit("$"), F.expr(f"right(value, {k})")) for k in (OUTER, 1)]
    lone = F.when(F.length("value") < 2, F.concat(F.lit(_START), F.col("value")))
    routed = texts.select(F.col("value").alias("text"), F.explode(F.array_distinct(F.array_compact(F.array(*ends, lone)))).alias("route"))
    shards = max(width(spark), -(-made.count() // SHARD_PATTERNS), -(-texts.count() * 4 // SHARD_TEXTS))
    left, right = made.withColumn("i", F.lit(0)).withColumn("j", F.lit(0)), routed.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    hot = _crowded(made, routed)
    if hot is not None:
        share = lambda c, of: F.pmod(F.xxhash64(c), F.coalesce(of, F.lit(1))).cast("int")
        each = lambda of: F.explode(F.sequence(F.lit(0), F.coalesce(of, F.lit(1)) - 1))
        left = made.join(F.broadcast(hot), "route", "left").withColumn("i", share("value", "of_patterns")).withColumn("j", each("of_texts"))
        right = routed.join(F.broadcast(hot), "route", "left").withColumn("j", share("text", "of_texts")).withColumn("i", each("of_patterns"))
    shard = F.pmod(F.xxhash64("route", "i", "j"), F.lit(shards)).alias("shard")
    placed = right.select(shard, "text").distinct()
    return left.select(shard, "value", "pattern").groupBy("shard").cogroup(placed.groupBy("shard")).applyInPandas(_scan, "value string, text string").distinct()


def _crowded(made: DataFrame, routed: DataFrame) -> DataFrame | None:
    """``(route, of_patterns, of_texts)``: routes of too many patterns or texts and the parts each side is split into; None where there is none.

    Their number is bounded by that of all members over the bound, so they fit on the driver.
    """
    sides = made.groupBy("route").agg(F.count("*").alias("p"), F.lit(0).cast("bigint").alias("t")).where(F.col("p") > ROUTE_PATTERNS)
    sides = sides.unionByName(routed.groupBy("route").agg(F.lit(0).cast("bigint").alias("p"), F.count("*").alias("t")).where(F.col("t") > SHARD_TEXTS))
    rows = [(r[0], max(1, -(-r[1] // ROUTE_PATTERNS)), max(1, -(-r[2] // SHARD_TEXTS))) for r in sides.groupBy("route").agg(F.max("p"), F.max("t")).collect()]
    return made.sparkSession.createDataFrame(rows, "route string, of_patterns int, of_texts int") if rows else None


def repeated_tables(rows: DataFrame) -> DataFrame:
    """``(tab_a, tab_b, split, source, tab_held, shared, longer)``: evaluation and training tables of which at least 7/10 of the rows of the longer recur.

    The smaller table id comes first. A table takes part as the longer one only
    if that many of its rows recur anywhere. Of its rows only the rarest look for
    partners, so many that one of them must recur in each: a value that stands in
    a third of all tables never pairs them. Then the rows matched in a partner,
    each the unit interval of its table, are merged into the coverage of the pair.
    Null or blank values recur nowhere; tables of a null split are left out;
    empty input gives no rows.
    """
    every = cut(table_rows_once(rows))
    held = F.when(F.col("split").isin("valid", "test"), True).when(F.col("split") == "train", False)
    sizes = cut(every.groupBy("tab_id").agg(F.count("*").alias("n"), F.max("split").alias("split"), F.max("source").alias("source")))
    filled = every.where("value is not null").select(F.col("tab_id").alias("tab"), F.col("row_id").alias("row"), "value", "spelled", held.alias("held")).where("held is not null")
    values = cut(filled.groupBy("value", "held").agg(F.count("*").alias("df"), F.any_value("spelled").alias("spelled")))
    met = cut(matches(values.where("held").select("value", "spelled"), values.where("not held").select("value", "spelled"), common_words(values)))
    # From here on both directions go together: ``held`` says on which side the longer table is.
    both = cut(met.select("value", F.lit(True).alias("held"), "text").unionAll(met.select(F.col("text").alias("value"), F.lit(False).alias("held"), F.col("value").alias("text"))))
    known = values.select("value", "held", "df").join(both.select("value", "held").distinct(), ["value", "held"])
    matched = cut(filled.drop("spelled").join(known, ["value", "held"]))
    size = sizes.select(F.col("tab_id").alias("tab"), "n")
    enough = matched.groupBy("tab").agg(F.count("*").alias("found")).join(size, "tab").where(F.col("found") * 10 >= F.col("n") * TENTHS)
    recurring = cut(matched.join(enough, "tab"))
    # Rows that recur nowhere are the rarest of all: they come first and take part of the number that is kept.
    keep = F.col("n") - F.ceil(F.col("n") * TENTHS / 10) + 1 - (F.col("n") - F.col("found"))
    rank = F.row_number().over(Window.partitionBy("tab").orderBy("df", "row"))
    rare = recurring.withColumn("rank", rank).where(F.col("rank") <= keep).select(F.col("tab").alias("long"), "n", "value", "held").distinct()
    partner = matched.select(F.col("tab").alias("short"), F.col("value").alias("text"), (~F.col("held")).alias("held")).distinct()
    shorter = sizes.select(F.col("tab_id").alias("short"), F.col("n").alias("short_n"))
    sought = rare.join(both, ["value", "held"]).join(partner, ["text", "held"]).select("long", "n", "short").distinct()
    pairs = cut(sought.join(shorter, "short").where("short_n <= n").select("long", "short"))
    hits = pairs.join(recurring.select(F.col("tab").alias("long"), "row", "n", "value", "held"), "long").join(both, ["value", "held"]).join(partner, ["short", "text", "held"])
    covered = hits.groupBy("long", "short", "n", "held").agg(F.countDistinct("row").alias("shared")).where(F.col("shared") * 10 >= F.col("n") * TENTHS)
    tab_held = F.when(F.col("held"), F.col("long")).otherwise(F.col("short"))
    found = covered.groupBy(tab_held.alias("tab_id"), F.when(F.col("held"), F.col("short")).otherwise(F.col("long")).alias("train_tab")).agg(F.max("shared").alias("shared"), F.max("n").alias("longer"))
    named = found.join(sizes.select("tab_id", "split", "source"), "tab_id").withColumnRenamed("tab_id", "tab_held")
    return named.select(F.least("tab_held", "train_tab").alias("tab_a"), F.greatest("tab_held", "train_tab").alias("tab_b"), "split", "source", "tab_held", "shared", "longer")


def overlap_report(found: DataFrame) -> DataFrame:
    """``(split, source, tables, pairs)``: repeated evaluation tables per split and source; a null source is reported as null."""
    return found.groupBy("split", "source").agg(F.countDistinct("tab_held").alias("tables"), F.count("*").alias("pairs"))
