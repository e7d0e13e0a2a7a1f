"""Typed values to the entries of a reference list.

Values and names are cut into padded trigrams of their particular words (the
words that many names share, and slips and abbreviations of them, carry no
signal and are left out; a code of letters and digits is one word). A
prefix-filter join ordered by global rarity finds the entries whose trigrams
overlap by their exact Jaccard similarity. In short words two slips can leave
almost no trigram, so short texts also meet in what is left of their particular
words without up to two letters. Each hit is verified by the slips between the
typed text and every arrangement of the entry's words. The entry with the fewest slips is kept, of several the one
of greatest similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm import setjoin
from cellweave.llm.names import remnants, shortens, slips, words
from cellweave.runtime import cut, keyed

#: Similarity of trigram sets from which an entry is verified. A slip costs at most four trigrams, so two leave (n - 8) / (n + 8) of n: enough from 24 on.
AT_LEAST = Fraction(1, 2)
#: A word of this share of all names or more is common.
COMMON_SHARE = 0.02
MOST_SLIPS = 2
#: Letters up to which particular words also meet by deletions; longer ones have more than 24 trigrams.
SHORT = 24

_STRINGS = T.ArrayType(T.StringType())

_NOTE = re.compile(r"[\[({][^\])}]*[\])}]")
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])")
_LINKING = {"the", "of"}


def has_id(text: str) -> bool:
    """Whether the text holds an entity id: Q in either case, followed by digits."""
    return re.search(r"[Qq][0-9]", text) is not None


def typed_words(text: str) -> list[str]:
    """Words of a typed value: notes in brackets and linking words go, words run together by capitals are parted."""
    bare = _NOTE.sub(" ", text)
    if not words(bare):
        bare = text
    if re.search(r"[a-z]", bare):
        bare = _CAMEL.sub(" ", bare)
    found = [w for part in bare.replace("_", " ").split() for w in words(part)]
    return [w for w in found if w not in _LINKING] or found


def parted(found: list[str], common: set[str]) -> list[str]:
    """Cut a common word off the end or the beginning of a longer word it was typed together with."""
    out = []
    for w in found:
        rest, before, after = w, [], []
        again = True
        while again:
            again = False
            for c in common:
                if len(c) >= 4 and len(rest) >= len(c) + 4:
                    if rest.endswith(c):
                        rest, after, again = rest[: -len(c)], [c, *after], True
                    elif rest.startswith(c):
                        rest, before, again = rest[len(c) :], [*before, c], True
        out += [*before, rest, *after]
    return out


def stands_for_common(word: str, common: set[str]) -> bool:
    """Whether a word is an abbreviation or a slip of a common one; long words may have two slips."""
    return any(len(word) <= 4 and shortens(word, c) or len(word) > 4 and slips(word, c, 2 if len(c) >= 8 else 1) <= (2 if len(c) >= 8 else 1) for c in common)


def particular(found: list[str], common: set[str], known: dict[str, bool] | None = None) -> list[str]:
    """The words that are no common word, no abbreviation or slip of one; ``known`` keeps what was worked out for a word."""
    known = {} if known is None else known
    if len(known) > 200_000:
        known.clear()
    for w in found:
        if w not in known:
            known[w] = w not in common and not stands_for_common(w, common)
    left = [w for w in found if known[w]]
    return left or [w for w in found if w not in common] or found


def grams(found: list[str]) -> list[str]:
    """Distinct padded trigrams, word by word; words with a digit among them are one code."""
    if any(c.isdigit() for w in found for c in w):
        found = ["".join(found)]
    return sorted({f"  {w} "[i : i + 3] for w in found for i in range(len(w) + 1)})


def arrangements(name: str) -> list[list[str]]:
    """The orders in which the words of a name are typed: as they are, and rotated."""
    found = [w for w in words(name) if w not in _LINKING]
    return [found[i:] + found[:i] for i in range(len(found))] if len(found) < 7 else [found]


def distance(typed: list[str], name: str, common: set[str], most: int = MOST_SLIPS) -> int:
    """Slips between the typed words, with abbreviated common words written out, and the closest arrangement of ``name``."""
    best = most + 1
    if any(c.isdigit() for c in name):
        code = "".join(words(name))
        return 0 if "".join(typed) == code else best
    for order in arrangements(name):
        general = [w for w in order if w in common]
        full = "".join(order)
        options = ["".join(typed)]
        if general:
            written, used = [], []
            for w in typed:
                fit = next((g for g in general if g not in used and w != g and (shortens(w, g))), None) if w not in general else None
                if fit and len(w) <= max(5, len(fit) // 2):
                    used.append(fit)
                    written.append(fit)
                else:
                    written.append(w)
            if used:
                options.append("".join(written))
        for option in options:
            best = min(best, slips(option, full, best - 1 if best else 0))
        if best == 0:
            break
    return best


def common_words(names: DataFrame) -> list[str]:
    """Words of at least ``COMMON_SHARE`` of all names: at most 1 / COMMON_SHARE times the words of a name, so few."""
    each = names.select(F.explode(F.array_distinct(_words("name"))).alias("word"))
    total = names.count()
    rows = each.groupBy("word").count().where(F.col("count") >= max(4, COMMON_SHARE * total)).select("word").collect()
    return sorted(r[0] for r in rows)


@F.pandas_udf(_STRINGS)
def _words(names: pd.Series) -> pd.Series:
    return names.map(lambda n: [w for w in words(n or "") if w not in _LINKING])


def reference_names(items: DataFrame) -> DataFrame:
    """``(item_id, name)``: labels and aliases of the entries of kind ``item``, distinct, without blanks."""
    one = items.where("kind = 'item' and item_id is not null")
    names = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    return one.select("item_id", F.explode(names).alias("name")).where("name is not null and trim(name) <> ''").distinct()


def typed_values(gold: DataFrame) -> DataFrame:
    """``(gt_id, typed)``: one row for each id whose entity is neither null nor blank and holds no entity id; the latest delivery counts."""
    rows = gold.where("gt_id is not null and entity is not null").groupBy("gt_id").agg(F.max(F.struct("loaded_at", "entity")).alias("v"))
    text = rows.select("gt_id", F.col("v.entity").alias("typed"))
    return text.where(~F.col("typed").rlike(r"(?U)\A[\s\p{Cf}]*\z") & ~F.col("typed").rlike("[Qq][0-9]"))


_SHAPE = T.StructType([T.StructField("items", _STRINGS), T.StructField("rests", _STRINGS)])


def _shapes(df: DataFrame, column: str, common: list[str], typed: bool) -> DataFrame:
    """``(key, items, rests)``: trigrams of the particular words, and what is left of them, run together in some arrangement, without up to ``MOST_SLIPS`` letters, if they are short. Both as hashes."""
    shared = set(common)

    def orders(text: str) -> list[list[str]]:
        return [parted(typed_words(text), shared)] if typed else arrangements(text)

    @F.pandas_udf(_SHAPE)
    def shape(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, bool] = {}
        for texts in batches:
            items, rests = [], []
            for text in texts:
                left = [particular(found, shared, known) for found in orders(text)]
                items.append(grams(left[0]))
                short = ("".join(found) for found in left)
                rests.append(sorted({r for t in short if len(t) <= SHORT + MOST_SLIPS for r in remnants(t, MOST_SLIPS)}))
            yield pd.DataFrame({"items": items, "rests": rests}, dtype=object)

    made = df.select(F.col(column).alias("key"), shape(column).alias("s"))
    hashed = lambda c: F.transform(f"s.{c}", lambda x: F.xxhash64(x)).alias(c)
    return made.select("key", hashed("items"), hashed("rests"))


def _short_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of short ``left`` and ``right(key, items, rests)`` that have a rest in common."""
    a = left.select(F.col("key").alias("key_a"), F.explode("rests").alias("rest"))
    b = right.select(F.col("key").alias("key_b"), F.explode("rests").alias("rest"))
    pairs = a.join(b, "rest").select("key_a", "key_b").distinct()
    held = pairs.join(left.select(F.col("key").alias("key_a"), F.col("items").alias("items_a")), "key_a").join(right.select(F.col("key").alias("key_b"), F.col("items").alias("items_b")), "key_b")
    return held.select("key_a", "key_b", F.size(F.array_intersect("items_a", "items_b")).alias("shared"), F.size(F.array_union("items_a", "items_b")).alias("total"))


def mapped(gold: DataFrame, items: DataFrame) -> DataFrame:
    """``(gt_id, item_id)``: the entry each typed value means, ``''`` where it means none.

    Equal texts are mapped once. Of entries with the same number of slips the one
    of greater trigram similarity is kept; when that ties too, the smaller id.
    Empty tables give an empty result or ``''`` throughout.
    """
    values = cut(typed_values(gold))
    names = cut(reference_names(items))
    common = common_words(names)
    left = cut(_shapes(keyed(values.select("typed"), "typed").distinct(), "typed", common, True))
    right = cut(_shapes(keyed(names.select("name"), "name").distinct(), "name", common, False))
    similar = setjoin.cross_join_above(left, right, AT_LEAST).select("key_a", "key_b", "shared", "total")
    near = similar.unionByName(_short_pairs(left, right)).dropDuplicates(["key_a", "key_b"])
    known = set(common)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["slips"] = [distance(parted(typed_words(a), known), b, known) for a, b in zip(pdf["key_a"], pdf["key_b"], strict=True)]
            yield pdf[pdf["slips"] <= MOST_SLIPS][["key_a", "key_b", "shared", "total", "slips"]]

    close = near.mapInPandas(verify, "key_a string, key_b string, shared int, total int, slips int")
    best = (
        close.join(names, F.col("key_b") == F.col("name"))
        .groupBy("key_a")
        .agg(F.min(F.struct("slips", (-F.col("shared") / F.col("total")).alias("far"), "item_id")).alias("best"))
        .select(F.col("key_a").alias("typed"), F.col("best.item_id").alias("item_id"))
    )
    return values.join(best, "typed", "left").select("gt_id", F.coalesce("item_id", F.lit("")).alias("item_id"))


def unmatched(gold: DataFrame, found: DataFrame) -> DataFrame:
    """``(typed, cells)``: the values that mean no entry, and in how many cells they stand."""
    missing = typed_values(gold).join(found.where("item_id = ''"), "gt_id", "left_semi")
    return missing.groupBy("typed").agg(F.count("*").alias("cells"))
