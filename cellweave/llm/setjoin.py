"""Exact similarity joins of sets.

Two joins live here. ``cross_join_above`` is the prefix-filter join of two
collections: values in one global order, rarest first; only the first values of
each set meet; length, position and distance are checked on what has met.

``self_join`` partitions the records of one collection by pivots under the
Jaccard distance. A part of the records, chosen by hash, are pivots; a record
within ``cover`` of one has its home with the nearest, and the rest, which lie
far from every pivot, become pivots themselves, each of a cell of radius 0. Let
R be the largest distance of a home record to its pivot. By the triangle
inequality a record within r of a home record lies within R + r of the pivot, and
it is copied to that cell; to no other. Distances to pivots come from the pivots' inverted
index, so far pivots are never looked at. Inside a cell the pairs are compared
exactly. A pair of which one record has its home with a chosen pivot is found in
that cell; the pairs of two others lie in each other's cells of radius 0, where
the distance to the pivot is that of the pair.

A value that more than ``cell_rows`` sets hold is split: one side is salted, the
other copied to the salts, so no task holds all its sets.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.runtime import cut, split_join


def token_counts(sets: DataFrame) -> DataFrame:
    """``(token, df)`` over all sets, partially aggregated."""
    return sets.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def ordered(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """``(key, toks)``: the values of each set, rarest first; values that ``counts`` doesn't know count as rarest."""
    each = sets.select("key", F.explode("items").alias("token"))
    ranked = each.join(counts, "token", "left").groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("t")
    )
    return ranked.select("key", F.col("t.token").alias("toks"))


def _prefix(toks: Column, at_least: Fraction) -> Column:
    n = F.size(toks)
    needed = F.ceil(n * at_least.numerator / F.lit(at_least.denominator) - F.lit(1e-9)).cast("int")
    return F.slice(toks, F.lit(1), F.greatest(n - needed + 1, F.lit(0)))


def _cells(records: DataFrame, at_least: Fraction, side: str) -> DataFrame:
    marked = records.select(F.col("key").alias(f"key_{side}"), F.col("toks").alias(f"toks_{side}"), _prefix(F.col("toks"), at_least).alias(f"pre_{side}"))
    return marked.select("*", F.posexplode(f"pre_{side}").alias(f"pos_{side}", "token"))


def _joined(left: DataFrame, right: DataFrame, counts: DataFrame, at_least: Fraction, cell_rows: int, own: bool) -> DataFrame:
    """``(key_a, key_b, shared, total)`` of all pairs of at least that similarity, each once."""
    p, q = at_least.numerator, at_least.denominator
    hot = counts.where(F.col("df") > cell_rows).select("token", F.ceil(F.col("df") / cell_rows).cast("int").alias("salts"))
    a = _cells(left, at_least, "a").join(hot, "token", "left")
    b = _cells(right, at_least, "b").join(hot, "token", "left")
    a = a.withColumn("salt", F.pmod(F.xxhash64("key_a"), F.coalesce("salts", F.lit(1)))).drop("salts")
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)).cast("bigint") - 1))).drop("salts")
    na, nb = F.size("toks_a"), F.size("toks_b")
    met = a.join(b, ["token", "salt"]).where((na * q >= nb * p) & (nb * q >= na * p))
    if own:
        met = met.where("key_a < key_b")
    most = 1 + F.least(na - F.col("pos_a"), nb - F.col("pos_b")) - 1
    met = met.where(most * (p + q) >= (na + nb) * p)  # positional filter; holds at the first shared value
    shared = F.size(F.array_intersect("toks_a", "toks_b"))
    met = met.where(shared * (p + q) >= (na + nb) * p)
    met = met.where(F.element_at(F.array_intersect("pre_a", "pre_b"), 1) == F.col("token"))  # each pair once
    return met.select("key_a", "key_b", shared.alias("shared"), (na + nb - shared).alias("total"))


#: One record in so many is chosen as a pivot.
PIVOT_EVERY = 16


def pivot_cells(records: DataFrame, counts: DataFrame, at_least: Fraction, cell_rows: int = 20_000, every: int = PIVOT_EVERY) -> tuple[DataFrame, DataFrame]:
    """``(pivot, key, toks, home)``: the members of the cells of chosen pivots, and ``(key, toks)``: the records far from all of these.

    With r = 1 - ``at_least``, a record has its home with the nearest chosen pivot
    within the cover distance, the lesser of r and (1 - r) / 2, ties to the
    smaller pivot, and is copied to every cell of radius R whose pivot is within
    R + r of it.
    """
    r = 1 - at_least
    cover = min(r, (1 - r) / 2)
    chosen = F.pmod(F.xxhash64("key"), F.lit(every)) == 0
    pivots = records.where(chosen)
    near = _joined(records, pivots, counts, 1 - r - cover, cell_rows, own=False).select(
        F.col("key_a").alias("key"), F.col("key_b").alias("pivot"), (F.col("total") - F.col("shared")).alias("apart"), "total"
    )
    near = cut(near)  # a pivot meets itself at distance 0
    within = F.col("apart") * cover.denominator <= F.col("total") * cover.numerator
    distance = F.col("apart") / F.col("total")
    homes = cut(near.where(within).groupBy("key").agg(F.min(F.struct(distance.alias("d"), "pivot")).alias("h")).select("key", F.col("h.pivot").alias("pivot"), F.col("h.d").alias("d")))
    radius = homes.groupBy("pivot").agg(F.max("d").alias("radius"))
    copied = near.join(radius, "pivot").where(distance <= F.col("radius") + float(r) + 1e-9).select("pivot", "key")
    members = copied.join(homes.select("key", F.col("pivot").alias("home_pivot")), "key", "left").select("pivot", "key", F.coalesce(F.col("home_pivot") == F.col("pivot"), F.lit(False)).alias("home"))
    placed = members.join(records.select("key", "toks"), "key")
    far = records.join(homes.select("key"), "key", "left_anti")
    return placed, far


def self_join(sets: DataFrame, at_least: Fraction, cell_rows: int = 20_000) -> DataFrame:
    """Pairs within ``sets(key, items)`` with Jaccard similarity of ``at_least`` (1/2 or more), each once: ``(key_a, key_b, shared, total)``, ``key_a < key_b``.

    ``items`` must be distinct within a set; keys must be unique. Empty and null sets pair with nothing.
    """
    counts = cut(token_counts(sets))
    records = cut(ordered(sets, counts))
    placed, far = pivot_cells(records, counts, at_least, cell_rows)
    placed = cut(placed)
    crowd = placed.groupBy("pivot").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select("pivot", F.ceil(F.col("n") / cell_rows).cast("int").alias("salts"))
    side = lambda df, s: df.select("pivot", F.col("key").alias(f"key_{s}"), F.col("toks").alias(f"toks_{s}"), F.col("home").alias(f"home_{s}"))
    salts = F.coalesce("salts", F.lit(1))
    a = side(placed.where("home"), "a").join(crowd, "pivot", "left").withColumn("salt", F.pmod(F.xxhash64("key_a"), salts).cast("int")).drop("salts")
    b = side(placed, "b").join(crowd, "pivot", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    # Of two home records the pair is taken once, from the smaller; of a home record and a copy once as well, unless the copy's own cell gives it.
    met = a.join(b, ["pivot", "salt"]).where("key_a <> key_b and (not home_b or key_a < key_b)")
    na, nb = F.size("toks_a"), F.size("toks_b")
    p, q = at_least.numerator, at_least.denominator
    shared = F.size(F.array_intersect("toks_a", "toks_b"))
    exact = met.where((na * q >= nb * p) & (nb * q >= na * p) & (shared * (p + q) >= (na + nb) * p)).select(
        F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), shared.alias("shared"), (na + nb - shared).alias("total")
    )
    lone = cut(far)
    return exact.unionByName(_joined(lone, lone, counts, at_least, cell_rows, own=True)).dropDuplicates(["key_a", "key_b"])


def cross_join_above(left: DataFrame, right: DataFrame, at_least: Fraction, cell_rows: int = 20_000) -> DataFrame:
    """Pairs between two collections of sets, as ``self_join``; rarity is counted over both."""
    counts = cut(token_counts(left.select("items").unionAll(right.select("items"))))
    return _joined(cut(ordered(left, counts)), cut(ordered(right, counts)), counts, at_least, cell_rows, own=False)


def value_sets(candidates: DataFrame) -> DataFrame:
    """``(key, items)``: the distinct values of instances and subclasses of each id together, repeated fetches merged."""
    none = F.array().cast("array<bigint>")
    both = F.concat(F.coalesce("instances", none), F.coalesce("subclasses", none))
    known = F.filter(F.array_distinct(both), lambda x: x.isNotNull())
    return (
        candidates.where("id is not null")
        .groupBy(F.col("id").alias("key"))
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(known)))).alias("items"))
    )


def set_classes(sets: DataFrame, least_size: int) -> DataFrame:
    """``(key, items, class)``: sets of ``least_size`` or more values; equal sets share a class, named by its smallest key."""
    large = sets.where(F.size("items") >= least_size)
    named = large.groupBy("items").agg(F.min("key").alias("class"))
    return large.join(named, "items").select("key", "items", "class")


def similar_sets(candidates: DataFrame, at_least: Fraction = Fraction(4, 5), least_size: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(key, class)`` of all records, and ``(key_a, key_b, shared, total)`` between classes of different sets."""
    placed = cut(set_classes(value_sets(candidates), least_size))
    heads = placed.where(F.col("key") == F.col("class")).select("key", "items")
    return placed.select("key", "class"), self_join(heads, at_least)


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(id_a, id_b)``: pairs of records from pairs of classes and from equal sets."""
    a = members.select(F.col("key").alias("x"), F.col("class").alias("class_a"))
    b = members.select(F.col("key").alias("y"), F.col("class").alias("class_b"))
    sides = links.select(F.col("key_a").alias("class_a"), F.col("key_b").alias("class_b"))
    # Classes of linked sets are rarely large; those of equal sets may hold a third of all records.
    across = split_join(b, split_join(a, sides, "class_a"), "class_b").select("x", "y")
    within = split_join(a, b.withColumnRenamed("class_b", "class_a"), "class_a").where("x < y").select("x", "y")
    ends = across.unionAll(within)
    return ends.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
