"""One form for text that looks the same, by quick-check segments.

Almost all of a text is already in its final form. A character class of the
unstable characters (not inert under normalisation, invisible, a kind of space,
a compatibility width or ligature, a look-alike letter) is derived once from
the Unicode database. Only the runs it finds are normalised, each with the
starter before it as context, and spliced into the unchanged rest.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.runtime import cut, split_join, spread

# Letters of other scripts that print like a Latin letter, and that letter.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԚԜаеѕіјорсухһԁԛԝѵӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρϲіϳ",
        "ABESIJKMHOPCTYXYQWaesijopcyxhdqwvlABEZHIKMNOPTYXoavpcij",
        strict=True,
    )
)

#: Compatibility forms that differ from their plain form in width, spacing or joining only.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")


@lru_cache(1)
def _tables() -> tuple[dict[int, str], re.Pattern]:
    """Single-character replacements, and the pattern of a run of characters that may change."""
    replace: dict[int, str] = {}
    unstable = []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co", "Cs"):
            continue
        tag = unicodedata.decomposition(ch).split(" ")[0]
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or ch in "͏ᅟᅠ឴឵ㅤﾠ":
            replace[code] = ""
        elif kind == "Zs":
            replace[code] = " "
        elif kind in ("Zl", "Zp"):
            replace[code] = "\n"
        elif tag in SAME_LOOK or tag == "<compat>" and "LIGATURE" in unicodedata.name(ch, ""):
            replace[code] = unicodedata.normalize("NFKC", ch)
        elif kind == "Cc":
            replace[code] = ""
        if ch in LOOK_ALIKES:
            replace[code] = LOOK_ALIKES[ch]
        if code in replace or unicodedata.combining(ch) or not unicodedata.is_normalized("NFC", ch) or not unicodedata.is_normalized("NFC", "e" + ch):
            unstable.append(code)
        elif any(part in LOOK_ALIKES for part in unicodedata.normalize("NFD", ch)):
            unstable.append(code)  # a look-alike with an accent
        elif any(unicodedata.normalize("NFC", base + ch) != base + ch for base in "가각"):
            unstable.append(code)  # Hangul vowels and tails join the syllable before them
    for code in [*range(0x09), *range(0x0B, 0x20), 0x7F]:
        replace[code] = "\n" if code == 0x0D else ""
        unstable.append(code)
    replace[0x09] = " "
    unstable.append(0x09)
    ranges = []
    for code in sorted(set(unstable)):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    inside = "".join(f"\\U{a:08x}-\\U{b:08x}" if a < b else f"\\U{a:08x}" for a, b in ranges)
    return replace, re.compile(f"[{inside}]+")


def _spliced(text: str) -> str:
    """Normalise each unstable run together with the starter before it; copy the rest."""
    replace, runs = _tables()
    out, done = [], 0
    for found in runs.finditer(text):
        start, end = found.span()
        start = max(done, start - 1)
        plain = text[start:end].translate(replace)
        if not plain.isascii():
            plain = unicodedata.normalize("NFC", unicodedata.normalize("NFD", plain).translate(replace))
        out.append(text[done:start])
        out.append(plain)
        done = end
    out.append(text[done:])
    return "".join(out)


def canonical(text: str) -> str:
    """The common form of all texts that look like ``text``.

    Case, accents, digits and punctuation stay; letter widths, ligatures, kinds
    of space, composition, invisible characters and look-alike letters do not.
    CR LF and CR become LF; white space at the end of the text goes.
    """
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    if not (text.isascii() and text.isprintable()):
        text = _spliced(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)  # a removed character had kept two segments apart
    return text.rstrip()


def canonical_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text)`` in the common form; null stays null, empty stays empty; one narrow pass."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else canonical(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, text string")


def _prints(form: str) -> bool:
    """Whether any character of a canonical text leaves a mark."""
    return not form.isspace() and form != ""


def look_keys(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, look, raw)``: 128-bit digests of the common form and of the text as stored; texts without a visible character are left out."""
    kind = df.schema[key].dataType.simpleString()

    def digest(x: str) -> bytes:
        return hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, looks, raws = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                form = canonical(t) if t else ""
                if _prints(form):
                    keys.append(k)
                    looks.append(digest(form))
                    raws.append(digest(t))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(looks, pa.binary()), pa.array(raws, pa.binary())], names=[key, "look", "raw"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, look binary, raw binary")


def same_look(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_a, doc_b)``: pairs whose texts look the same and differ in characters, smaller key first, each once.

    Only digests are shuffled. Looks that have a single stored form are dropped
    before the pairing, with partial aggregation, so a group of exact copies,
    however large, is never joined with itself. Keys may repeat.
    """
    keyed = cut(look_keys(df, key, text))
    several = keyed.groupBy("look").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select("look")
    kept = cut(keyed.join(several, "look", "left_semi").distinct())
    a = kept.select("look", F.col("raw").alias("raw_a"), F.col(key).alias("doc_a"))
    b = kept.select("look", F.col("raw").alias("raw_b"), F.col(key).alias("doc_b"))
    return split_join(a, b, "look").where("raw_a <> raw_b and doc_a < doc_b").select("doc_a", "doc_b").distinct()


def look_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, class, links)``: one row for each document with a visible character: its look, named by the smallest key, and how many documents look the same but differ in characters."""
    keyed = cut(look_keys(df, key, text).where(F.col(key).isNotNull()).distinct())
    forms = keyed.groupBy("look", "raw").agg(F.count("*").alias("same"), F.min(key).alias("low"))
    looks = forms.groupBy("look").agg(F.sum("same").alias("all"), F.min("low").alias("class"))
    counted = forms.join(looks, "look").select("look", "raw", "class", (F.col("all") - F.col("same")).alias("links"))
    return keyed.join(counted, ["look", "raw"]).select(key, "class", "links")
