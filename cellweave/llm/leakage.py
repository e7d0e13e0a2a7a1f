"""Evaluation passages inside training text: Wu-Manber search over folded character streams.

A passage is a run of ``words`` words of an evaluation text. Both sides are
folded to the letters and digits alone, so case, punctuation, spacing, markup
and look-alike letters cannot hide a run. All runs are searched together: a
block shift table skips positions where no run can end, suffix buckets select
the runs that may end there, and direct comparison confirms.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.textform import LOOK_ALIKES
from cellweave.runtime import cut, spread

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_REST = re.compile(r"[\W_]+")
#: Look-alikes after case folding; letters of any script fold to the same sign on both sides.
_FOLD = str.maketrans({k.casefold(): v.casefold() for k, v in LOOK_ALIKES.items() if len(k.casefold()) == 1} | {"ı": "i", "ø": "o", "ł": "l"})


def folded(text: str) -> str:
    """The letters and digits of a text without case, accents, widths, markup or script of look-alikes."""
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    if "&" in text:
        text = html.unescape(text)
        if "<" in text:
            text = _TAG.sub("", text)
    text = text.casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_FOLD)
    return _REST.sub("", text)


def passages(text: str, words: int) -> list[str]:
    """Folded runs of ``words`` words of a text; words without letter or digit don't count."""
    parts = [x for x in map(folded, _TAG.sub(" ", text).split()) if x]
    return ["".join(parts[i : i + words]) for i in range(len(parts) - words + 1)]


class WuManber:
    """Search of many strings at once; ``patterns`` maps each string to what is reported for it."""

    def __init__(self, patterns: dict[str, set], block: int = 5, suffix: int = 16):
        self.length = min(map(len, patterns), default=0)
        self.block = min(block, self.length)
        self.suffix = min(suffix, self.length)
        self.far = self.length - self.block + 1
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, list[tuple[str, set]]] = defaultdict(list)
        for text, what in patterns.items():
            for end in range(self.block, self.length + 1):
                key = text[end - self.block : end]
                step = self.length - end
                if self.shift.get(key, self.far) > step:
                    self.shift[key] = step
            self.bucket[text[self.length - self.suffix : self.length]].append((text, what))

    def search(self, text: str) -> set:
        """What is reported for all strings that occur in ``text``."""
        found: set = set()
        if not self.length:
            return found
        shift, bucket, far, block, suffix, length = self.shift.get, self.bucket.get, self.far, self.block, self.suffix, self.length
        end, size = length, len(text)
        while end <= size:
            step = shift(text[end - block : end], far)
            if step:
                end += step
                continue
            for pattern, what in bucket(text[end - suffix : end], ()):
                if text.startswith(pattern, end - length):
                    found |= what
            end += 1
        return found


#: Runs up to which all patterns go to every worker; at about 100 bytes each that is 20 MB.
BROADCAST_RUNS = 200_000
#: Slots of the bitmap of suffix hashes, and parts of what has met in one hash.
SLOTS, SALTS = 1 << 26, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def runs_of(items: DataFrame, words: int) -> DataFrame:
    """``(item_id, run)``: the distinct folded runs of ``words`` words of each item; ``items(item_id, text)`` without nulls."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, run) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for run in dict.fromkeys(passages(text, words))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["item_id", "run"])

    return items.select("item_id", "text").mapInArrow(cut_up, "item_id bigint, run string").distinct()


def leaked(documents: DataFrame, items: DataFrame, words: int = 12, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """``(doc_id, item_id)``: documents that hold ``words`` or more words in a row of an item's text.

    One pass over the documents, each folded once, whatever the number of items.
    Up to ``broadcast_runs`` runs every worker has the shift table and the suffix
    buckets of all. Beyond, workers have a bitmap of suffix hashes of fixed size;
    the positions it lets through are sent to the bucket of their hash, and the
    direct comparison is made there. Null or empty texts and items of fewer words
    give no row; repeated rows count once; items with equal passages are all reported.
    """
    runs = cut(runs_of(items.where("text is not null and item_id is not null"), words))
    texts = spread(documents.select("doc_id", "text"))
    if runs.count() <= broadcast_runs:
        query = documents.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in runs.collect()])
        found = texts.mapInArrow(_scan(query, uuid.uuid4().hex), "doc_id bigint, item_id bigint")
    else:
        found = _sharded(texts, runs)
    return found.distinct()


_matchers: dict[str, WuManber] = {}


def _scan(query, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _matchers:  # once for each worker
            patterns: dict[str, set] = defaultdict(set)
            for item, text in query.value:
                patterns[text].add(item)
            _matchers.clear()
            _matchers[name] = WuManber(patterns)
        matcher = _matchers[name]
        for batch in batches:
            docs, items = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and doc is not None:
                    hits = matcher.search(folded(text))
                    docs += [doc] * len(hits)
                    items += hits
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    return run


def window_hashes(text: str, width: int) -> np.ndarray:
    """A hash of each window of ``width`` signs of a text, by its start."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _BASE + codes[k : k + n]
    out ^= out >> np.uint64(29)
    return out * _BASE


def _sharded(texts: DataFrame, runs: DataFrame, suffix: int = 16) -> DataFrame:
    """The search with patterns in buckets of a table, for more patterns than a worker should hold."""
    spark = texts.sparkSession
    shape = runs.agg(F.min(F.length("run")), F.max(F.length("run"))).first()
    length, longest = int(shape[0]), int(shape[1])
    suffix = min(suffix, length)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [int(window_hashes(r[length - suffix : length], suffix)[0].astype(np.int64)) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["item_id", "run", "hash"])

    patterns = cut(runs.mapInArrow(hashed, "item_id bigint, run string, hash bigint"))
    slot = F.col("hash").bitwiseAND(F.lit(SLOTS - 1))
    words = patterns.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit"))
    bits = np.zeros(SLOTS // 64, np.int64)
    for part in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().to_batches():  # at most SLOTS / 64 rows
        bits[part.column(0).to_numpy()] = part.column(1).to_numpy()
    known = spark.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value.view(np.uint64)
        for batch in batches:
            docs, keys, slices = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and doc is not None:
                    body = folded(text)
                    every = window_hashes(body[length - suffix :], suffix)
                    at = every & np.uint64(SLOTS - 1)
                    hit = np.flatnonzero(table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
                    docs += [doc] * len(hit)
                    keys += every[hit].astype(np.int64).tolist()
                    slices += [body[i : i + longest] for i in hit.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(slices, pa.string())], names=["doc_id", "hash", "part"])

    met = texts.mapInArrow(scan, "doc_id bigint, hash bigint, part string").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    buckets = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return met.join(buckets, ["hash", "salt"]).where(F.startswith("part", "run")).select("doc_id", "item_id")


def leak_report(found: DataFrame) -> DataFrame:
    """``(item_id, documents)``: the test items that leaked and into how many documents."""
    return found.groupBy("item_id").agg(F.count("*").alias("documents"))
