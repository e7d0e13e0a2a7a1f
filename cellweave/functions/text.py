"""Text functions as Column expressions; Arrow UDFs only where no built-in exists."""

from __future__ import annotations

import difflib
import html
import re
import string
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Punctuation that is deleted before stop words are looked up (the 32 ASCII marks).
PUNCTUATION = string.punctuation
# English function words; a parameter of every function that uses them.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing don down "
    "during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself "
    "no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then "
    "there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves"
).split()
#: The suffix that search-result titles carry.
SITE_SUFFIX = " - Wikidata"
#: Titles of more words are not listed as subsets; ``best_match`` finds their best one without a list.
MOST_TITLE_WORDS = 20
#: Up to this many words ``best_match`` tries every subset.
FEW_TITLE_WORDS = 5
#: Up to this many words the subsets are built by array expressions, beyond by an Arrow UDF.
NATIVE_TITLE_WORDS = 10


def last_segment(url: Column) -> Column:
    """What follows the last slash; the whole text without one; null stays null."""
    return F.element_at(F.split(url, "/"), -1)


def numeric_id(entity: Column) -> Column:
    """The number after the first character of an id such as Q12; null where it is none."""
    return F.substring(entity, 2, 2_000).try_cast("bigint")


def with_prefix(value: Column, prefix: str) -> Column:
    """Add a URL prefix unless the text has it already (case-sensitive test)."""
    return F.when(value.startswith(prefix), value).otherwise(F.concat(F.lit(prefix), value))


def content_words(text: Column, stop_words: list[str] | None = None) -> Column:
    """Words without punctuation and stop words, in order, case kept; null gives an empty array."""
    stop = F.array(*map(F.lit, STOP_WORDS if stop_words is None else stop_words))
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), PUNCTUATION, ""), r"\s+")
    return F.filter(parts, lambda w: (w != "") & ~F.array_contains(stop, F.lower(w)))


def remove_stopwords(text: Column, stop_words: list[str] | None = None) -> Column:
    """The content words joined by one space."""
    return F.array_join(content_words(text, stop_words), " ")


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def strip_end(text: Column) -> Column:
    """Delete the run of , : ; - . space ? ! at the end."""
    return F.regexp_replace(text, r"[,:;\-. ?!]+\z", "")


def is_complete(text: Column) -> Column:
    """Whether a title is not cut off by three dots."""
    return ~text.endswith("...")


def title_words(title: Column) -> Column:
    """The words of a title without the site suffix."""
    return F.filter(F.split(F.replace(title, F.lit(SITE_SUFFIX), F.lit("")), r"\s+"), lambda w: w != "")


def title_subsets(title: Column) -> Column:
    """All ordered word subsets of a title in mask order, then the title itself.

    An empty title gives ``['']``; a title of more than 20 words gives itself.
    """
    short = F.size(title_words(title)) <= NATIVE_TITLE_WORDS
    return F.when(short, _subsets_native(title)).otherwise(_subsets_udf(title))


def _subsets_native(title: Column) -> Column:
    whole = F.replace(title, F.lit(SITE_SUFFIX), F.lit(""))
    words = title_words(title)
    count = F.pow(F.lit(2), F.least(F.size(words), F.lit(NATIVE_TITLE_WORDS))).cast("int") - 1
    masks = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    picked = F.transform(masks, lambda m: F.array_join(F.filter(words, lambda w, j: F.pow(F.lit(2), j).cast("int").bitwiseAND(m) > 0), " "))
    return F.concat(F.filter(picked, lambda p: p != whole), F.array(whole))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _subsets_udf(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: None if t is None else subsets(t))


def subsets(title: str) -> list[str]:
    """Plain form of ``title_subsets``."""
    whole = title.replace(SITE_SUFFIX, "")
    words = whole.split()
    if len(words) > MOST_TITLE_WORDS:
        return [whole]
    picked = (" ".join(w for j, w in enumerate(words) if mask >> j & 1) for mask in range(1, 1 << len(words)))
    return [p for p in picked if p != whole] + [whole]


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word per letter of ``b`` (bit-parallel)."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    """Indel similarity: twice the common subsequence over both lengths; two empty texts are equal."""
    total = len(a) + len(b)
    return 2.0 * common_length(a, b) / total if total else 1.0


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel similarity of two columns; null where either is null."""
    return pd.Series([None if x is None or y is None else ratio_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def difflib_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; not symmetric."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return texts.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def closest_subset(low: str, title: str) -> tuple[float, str]:
    """Distance and text of the title's word subset closest to a lower-case query: the first in the order of ``subsets``, for titles of any length.

    Of the subsets of a joined length only the best common subsequence with each
    start of the query matters, so the work is polynomial in the title. A value
    is the common length times 2 to the number of words, less the mask: the
    greatest value is the longest one with the smallest mask.
    """
    whole = title.replace(SITE_SUFFIX, "")
    words = whole.split()
    if len(words) <= FEW_TITLE_WORDS:
        return min(((1 - ratio_of(low, part.lower()), part) for part in subsets(title)), key=lambda x: x[0])
    one = 1 << len(words)
    kind = np.int64 if (len(low) + 2) * one < 1 << 60 else object  # Python's integers where 64 bits are too few
    none = -2 * one  # below every value, even after the masks are taken off
    table = np.full((1 + sum(len(w.lower()) + 1 for w in words), len(low) + 1), none, dtype=kind)
    at = {c: np.array([False] + [c == x for x in low]) for c in {" ", *whole.lower()}}

    def read(rows: np.ndarray, letters: str) -> np.ndarray:
        for c in letters:
            if at[c].any():
                hit = np.roll(rows, 1, axis=1) + one
                rows = np.maximum.accumulate(np.where(at[c], np.maximum(rows, hit), rows), axis=1)
        return rows

    used = 0
    for j, word in enumerate(w.lower() for w in words):
        first = read(np.zeros((1, len(low) + 1), dtype=kind), word) - (1 << j)
        size = len(word) + 1
        if used:
            more = read(table[1 : used + 1], " " + word) - (1 << j)
            more = np.where(table[1 : used + 1] == none, none, more)
            table[1 + size : used + size + 1] = np.maximum(table[1 + size : used + size + 1], more)
        table[size - 1] = np.maximum(table[size - 1], first[0])
        used += size
    ends = [(length, int(table[length, -1])) for length in range(1, used + 1) if table[length, -1] != none]
    scored = [(1 - 2.0 * -(-v // one) / (len(low) + length), -v % one) for length, v in ends]
    far, mask = min(scored)
    if (last := 1 - ratio_of(low, whole.lower())) < far:
        return last, whole
    return far, " ".join(w for j, w in enumerate(words) if mask >> j & 1)


def best_match(query: str, titles: list[str]) -> str:
    """The title subset closest to the query, without trailing marks; the query where there is none. First wins ties."""
    best, least = None, float("inf")
    low = query.lower()
    for title in titles:
        far, part = closest_subset(low, title)
        if far < least:
            best, least = part, far
    if best is None:
        return query
    best = re.sub(r"[,:;\-. ?!]+\Z", "", best)
    return query if best.endswith("...") else best.replace("’", "'")


@F.pandas_udf(T.StringType())
def best_title_match(queries: pd.Series, titles: pd.Series) -> pd.Series:
    """``best_match`` of a column of queries and one of title arrays; null titles are skipped."""
    return pd.Series([None if q is None else best_match(q, [t for t in (ts if ts is not None else []) if t is not None]) for q, ts in zip(queries, titles, strict=True)])


# Entity types of the recogniser and their numbers.
ENTITY_TYPES = {
    "PERSON": 1,
    "NORP": 2,
    "FAC": 3,
    "ORG": 4,
    "GPE": 5,
    "LOC": 6,
    "PRODUCT": 7,
    "EVENT": 8,
    "WORK_OF_ART": 9,
    "LAW": 10,
    "LANGUAGE": 11,
    "DATE": 12,
    "TIME": 13,
    "PERCENT": 14,
    "MONEY": 15,
    "QUANTITY": 16,
    "ORDINAL": 17,
    "CARDINAL": 18,
}

_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
#: What the rule-based recogniser looks for, in lower case: shapes of numbers and dates, and nouns that say what a thing is.
ENTITY_RULES = {
    "PERSON": r"\b(politician|actor|actress|writer|author|painter|singer|footballer|player|scientist|engineer|architect|bishop|king|queen|person)s?\b|\bborn (in )?\d{4}\b|\b(mr|mrs|dr|prof)\.? ",
    "NORP": r"\b(party|tribe|ethnic group|christian|muslim|jewish|buddhist|european|american|german|french|russian|greek|spanish|british)s?\b",
    "FAC": r"\b(bridge|airport|station|stadium|observatory|lighthouse|theatre|museum|castle|church|cathedral|monastery|highway|dam|tower)s?\b",
    "ORG": r"\b(university|company|department|ministry|institute|foundation|brewery|society|agency|club|band|inc|ltd|gmbh|corporation|organi[sz]ation)\b",
    "GPE": r"\b(city|town|village|county|country|district|parish|municipality|province|republic|kingdom|state|commune|capital)\b",
    "LOC": r"\b(river|lake|mountain|mount|valley|island|ocean|sea|bay|cape|ridge|springs|crater|park|continent)\b",
    "PRODUCT": r"\b(software|car|aircraft|ship|phone|engine|rifle|camera|computer)s?\b",
    "EVENT": r"\b(war|battle|festival|olympics|championship|tournament|election|earthquake|hurricane)s?\b",
    "WORK_OF_ART": r"\b(film|novel|song|painting|album|book|opera|symphony|poem|play|sculpture)s?\b",
    "LAW": r"\b(act|treaty|constitution|directive|statute|convention)\b",
    "LANGUAGE": r"\b(language|dialect)s?\b",
    "DATE": r"\b(1[0-9]|20)\d{2}\b|\b(" + _MONTHS + r")\b",
    "TIME": r"\b\d{1,2}:\d{2}\b",
    "PERCENT": r"\d\s?%|\bpercent\b",
    "MONEY": r"[$€£¥]\s?\d|\b\d+ (dollars|euros|pounds)\b",
    "QUANTITY": r"\b\d+([.,]\d+)?\s?(km|m|cm|mm|kg|g|t|ha|miles|feet|metres|meters|tons|litres)\b",
    "ORDINAL": r"\b\d+(st|nd|rd|th)\b|\b(first|second|third)\b",
    "CARDINAL": r"\b\d+\b|\b(one|two|three|four|five|six|seven|eight|nine|ten)\b",
}


def by_rules(text: Column) -> Column:
    """Names of the entity types whose rule matches somewhere in a text."""
    return F.array_compact(F.array(*(F.when(F.lower(text).rlike(rule), F.lit(name)) for name, rule in ENTITY_RULES.items())))


def entity_labels(title: Column, description: Column, recogniser: Callable[[Column], Column] = by_rules) -> Column:
    """Numbers of the entity types in "title - description", distinct, ascending.

    ``recogniser`` maps a text column to an array of type names; a trained model
    takes its place as an Arrow UDF. Names without a number are left out.
    """
    numbers = F.create_map(*(F.lit(x) for pair in ENTITY_TYPES.items() for x in pair))
    found = recogniser(F.concat_ws(" - ", title, description))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, lambda name: F.try_element_at(numbers, name)))))
