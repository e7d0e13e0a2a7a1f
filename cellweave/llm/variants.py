"""Spellings of names typed by people, linked when they name the same person or organisation.

A label is read as an organisation (core and kind) or a person (surname and
given names). Cores and surnames of one block are partitioned in metric space:
each goes to its nearest pivot and, when its distance to another pivot is
within twice the radius of that, to that cell as well, by the triangle
inequality. Each cell is joined exactly under the Damerau-Levenshtein metric.
A spelling then leans on the best supported spelling within the radius, and
rows that lean on the same one, with given names or kinds that agree, are one
entity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.names import plain, remnants, shortens, slips, words
from cellweave.runtime import cut, keyed, split_join

# Legal forms, titles and linking words as people type them.
LEGAL = {"ltd", "limited", "inc", "incorporated", "gmbh", "sa", "ag", "llc", "plc", "corp"}
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir"}
LINKING = {"the", "of", "and"}
_DOTTED = re.compile(r"\bg\.\s?m\.\s?b\.\s?h\b\.?|\bs\.\s?a\.")

RADIUS = 1
#: A word in fewer of the labels is not shared: at most the words of a label over this part are, whatever the number of labels.
SHARED_PART = 0.0005
#: Spellings in one cell, and pivots of one block at most: what is broadcast is bounded by blocks x pivots.
CELL_SPELLINGS = 1_000
MOST_PIVOTS = 256
#: Longer spellings meet by their ends: a slip harms only one of them.
LONG, END, LONG_PARTS = 50, 24, 64
#: Short forms that may be listed: a table of a language, which goes to every worker.
MOST_FORMS = 100_000


class Lexicon(NamedTuple):
    """Words that many names share: given names (also short ones, with their full forms) and organisation kinds."""

    given: frozenset
    kinds: frozenset
    short_given: dict
    short_kind: dict


class Name(NamedTuple):
    """A label as read: ``block`` ('o' or 'p' and initial), ``core``, and what must agree."""

    block: str
    core: str
    first: str
    rest: str


def true_distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance (unrestricted, hence a metric)."""
    if a == b:
        return 0
    most = len(a) + len(b)
    last: dict[str, int] = {}
    table = [[most] * (len(b) + 2)] + [[most, *([0] * (len(b) + 1))] for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            cost = 1
            if x == y:
                cost, match = 0, j
            table[i + 1][j + 1] = min(table[i][j] + cost, table[i + 1][j] + 1, table[i][j + 1] + 1, table[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return table[-1][-1]


def _near(words_: frozenset, most: int) -> dict[str, list[str]]:
    """The words by what is left of them without up to ``most`` letters: two words within ``most`` slips have one such rest in common."""
    rests: dict[str, list[str]] = {}
    for w in sorted(words_):
        for rest in remnants(w, most):
            rests.setdefault(rest, []).append(w)
    return rests


class Reader:
    """Reads labels; what a word can stand for is worked out once and kept for the last words met."""

    KEPT = 200_000

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.long_kinds = frozenset(k for k in lexicon.kinds if len(k) >= 5)
        self.near_kinds = _near(self.long_kinds, 2)
        self.near_given = _near(frozenset(g for g in lexicon.given if len(g) >= 4), 1)
        self.longest_kind = max(map(len, self.long_kinds), default=0) + 2
        self.longest_given = max(map(len, lexicon.given), default=0) + 1
        self.kinds: dict[str, frozenset] = {}
        self.givens: dict[str, str | None] = {}

    def kind_of(self, word: str) -> frozenset:
        """The organisation kinds a word can stand for."""
        found = self.kinds.get(word)
        if found is None:
            if len(self.kinds) > self.KEPT:
                self.kinds = {}
            found = self.kinds[word] = frozenset(self._kind_of(word))
        return found

    def _kind_of(self, word: str):
        lexicon = self.lexicon
        if word in lexicon.kinds:
            return (word,)
        if word in lexicon.short_kind:
            return lexicon.short_kind[word]
        if word in lexicon.given or word in lexicon.short_given or word in TITLES:
            return ()
        if 3 <= len(word) <= 7:
            short = {k for k in self.long_kinds if shortens(word, k)}
            short = {k for k in short if word[:2] == k[:2]} or (short if len(word) >= 5 else ())
            if short:
                return short
        if 5 <= len(word) <= self.longest_kind:
            near = {k for rest in remnants(word, 2) for k in self.near_kinds.get(rest, ())}
            return {k for k in near if slips(word, k, 1 if len(k) < 7 else 2) <= (1 if len(k) < 7 else 2)}
        return ()

    def given_of(self, word: str) -> str | None:
        """The full given name a word stands for, if it is one."""
        if word not in self.givens:
            if len(self.givens) > self.KEPT:
                self.givens = {}
            self.givens[word] = self._given_of(word)
        return self.givens[word]

    def _given_of(self, word: str) -> str | None:
        lexicon = self.lexicon
        if word in lexicon.short_given:
            return lexicon.short_given[word]
        if word in lexicon.given:
            return word
        if 4 <= len(word) <= self.longest_given:
            near = {g for rest in remnants(word, 1) for g in self.near_given.get(rest, ())}
            near = sorted(g for g in near if slips(word, g, 1) <= 1)
            if near:
                return lexicon.short_given.get(near[0], near[0])
        return None


def read(label: str, reader: Reader) -> Name | None:
    """A label as a name; None if it has no letter or digit."""
    text = plain(label)
    found = words(text)
    if not found:
        return None
    bare = [w for w in words(_DOTTED.sub(" ", text)) if w not in LINKING and w not in LEGAL]
    kinds = [(w, reader.kind_of(w)) for w in bare]
    core = [w for w, k in kinds if not k]
    if core and len(core) < len(bare) and (max(map(len, core)) > 2):
        options = sorted({k for _, ks in kinds for k in ks})
        return Name("o", "".join(core), " ".join(options), "")
    named = [w for w in found if w not in TITLES] or found
    before, comma, _ = text.partition(",")
    head = [w for w in words(before) if w not in TITLES] if comma else []
    full = [w for w in named if len(w) > 1]
    strange = [w for w in full if reader.given_of(w) is None]
    in_head = [w for w in head if len(w) > 1]
    if in_head and len(in_head) < len(named):
        surname = next((w for w in reversed(in_head) if w in strange), in_head[-1])
    elif strange:
        surname = strange[-1]
    else:
        surname = full[-1] if full else named[-1]
    left = list(named)
    left.reverse()
    left.remove(surname)
    left.reverse()
    given = [reader.given_of(w) or w for w in left]
    first = given[0] if given else ""
    return Name("p" + first[:1], surname, first, " ".join(given[1:]))


def lexicon_of(labels: DataFrame, forms: DataFrame) -> Lexicon:
    """The shared words, from ``labels(text)`` and the table of short forms.

    A word is shared when it stands beside three or more words that repeat and
    have fewer partners than it has, and these are half of its partners. Such words are few (given names, kinds):
    their number does not grow with the number of names.
    """
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def of_label(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(words(_DOTTED.sub(" gmbh ", plain(t))))))

    rows = cut(labels.where("text is not null").select(of_label("text").alias("w")))
    marked = rows.select("w", F.arrays_overlap("w", F.array(*map(F.lit, sorted(LEGAL | {"of", "the"})))).cast("int").alias("firm"))
    counts = cut(marked.select(F.explode("w").alias("word"), "firm").where("length(word) >= 3").groupBy("word").agg(F.count("*").alias("n"), F.avg("firm").alias("firm")))
    pairs = rows.select(F.explode("w").alias("word"), "w").select("word", F.explode("w").alias("other")).where("word <> other and length(word) >= 3 and length(other) >= 4")
    repeated = counts.where("n >= 2").select(F.col("word").alias("other"))
    beside = cut(pairs.distinct().join(repeated, "other"))
    partners = cut(beside.groupBy("word").agg(F.count("*").alias("deg")))
    fewer = partners.select(F.col("word").alias("other"), F.col("deg").alias("less"))
    shared = (
        beside.join(partners, "word").join(fewer, "other", "left").where("coalesce(less, 0) < deg").groupBy("word").agg(F.count("*").alias("k"), F.max("deg").alias("deg")).where("k >= 3 and 2 * k >= deg").join(counts, "word")
    )
    given, kinds = set(), set()
    often = shared.where(F.col("n") >= SHARED_PART * rows.count())
    accepted: list[tuple[str, int]] = []
    for r in often.select("word", "n", "firm").orderBy(F.desc("n"), "word").collect():
        if any(n >= 5 * r["n"] and slips(r["word"], w, 1) <= 1 for w, n in accepted):
            continue  # a frequent slip
        accepted.append((r["word"], r["n"]))
        (kinds if r["firm"] >= 0.1 else given).add(r["word"])
    short_given, short_kind = {}, {}
    listed = forms.where("form is not null and full_form is not null").select("form", "full_form", "kind").distinct()
    if listed.count() > MOST_FORMS:
        raise ValueError(f"more than {MOST_FORMS} short forms")
    for r in listed.orderBy("form", "full_form", "kind").collect():
        short, full = words(r["form"]), words(r["full_form"])
        if r["kind"] == "given" and short and full:
            short_given.setdefault(short[0], full[0])
            given.add(full[0])
            kinds -= {short[0], full[0]}
        elif short and full:
            kinds |= {w for w in full if w not in LINKING}
            whole = tuple(w for w in full if w not in LINKING)
            for w in short:
                if w not in LINKING and w not in whole:
                    short_kind[w] = tuple(sorted({*short_kind.get(w, ()), *(k for k in whole if shortens(w, k) or len(whole) == 1)}))
    shorts = {w for w in kinds if len(w) < 5 or any(shortens(w, k) and len(k) > len(w) + 1 and w[:2] == k[:2] for k in kinds)}
    kinds -= (shorts | LEGAL | LINKING | TITLES | set(short_kind)) - {w for v in short_kind.values() for w in v}
    given -= LEGAL | LINKING | TITLES | kinds | set(short_given) | set(short_kind)
    return Lexicon(frozenset(given), frozenset(kinds), short_given, short_kind)


_NAME = T.StructType([T.StructField(x, T.StringType()) for x in Name._fields])


def read_labels(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``rows`` with ``name`` and ``other``: the label and the second label as read."""
    known = rows.sparkSession.sparkContext.broadcast(lexicon)  # bounded: see lexicon_of

    @F.pandas_udf(_NAME)
    def reader(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        state = Reader(known.value)
        for texts in batches:
            out = [(read(t, state) if t else None) or (None,) * 4 for t in texts]
            yield pd.DataFrame(out, columns=list(Name._fields))

    return rows.select("*", reader("label").alias("name"), reader("actual_label").alias("other"))


def distances(spellings: list[str], pivot: str) -> np.ndarray:
    """``true_distance`` of each spelling to one pivot, over whole arrays."""
    size = np.array([len(w) for w in spellings], np.int64)
    top, m, n = int(size.max(initial=0)), len(pivot), len(spellings)
    sign = {c: i for i, c in enumerate(sorted(set(pivot)))}
    other = len(sign)
    codes = np.full((top, n), other, np.int16)
    for r, w in enumerate(spellings):
        codes[: len(w), r] = [sign.get(c, other) for c in w]
    table = np.zeros((m + 1, top + 1, n), np.int16)
    table[:, 0] = np.arange(m + 1)[:, None]
    table[0] = np.arange(top + 1)[:, None]
    last = np.zeros(other + 1, np.int16)  # row in which a sign of the pivot was met last
    for i, c in enumerate(pivot, 1):
        before = np.zeros(n, np.int16)  # place in the spelling where this sign was met last
        for j in range(1, top + 1):
            same = codes[j - 1] == sign[c]
            best = np.minimum(table[i - 1, j - 1] + ~same, np.minimum(table[i - 1, j], table[i, j - 1]) + 1)
            row = last[codes[j - 1]]
            some = np.flatnonzero((row > 0) & (before > 0))
            if len(some):
                r, b = row[some], before[some]
                best[some] = np.minimum(best[some], table[r - 1, b - 1, some] + (i - r) + (j - b) - 1)
            table[i, j] = best
            before[same] = j
        last[sign[c]] = i
    return table[m, size, np.arange(n)]


def _pivots(spellings: DataFrame) -> dict[str, tuple[list[str], int]]:
    """Pivots of each block, chosen by hash among its spellings: one for every CELL_SPELLINGS, at most about MOST_PIVOTS; and the number of parts each cell is split into beyond that."""
    spellings = spellings.where(F.length("core") <= LONG)
    sizes = spellings.groupBy("block").agg(F.count("*").alias("n"), F.min("core").alias("least"))
    every = F.greatest(F.lit(1), F.ceil(F.col("n") / F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("n") / CELL_SPELLINGS))))
    chosen = spellings.select("block", "core").join(sizes, "block").where((F.col("core") == F.col("least")) | (F.pmod(F.xxhash64("core"), every) == 0) & (F.col("n") > CELL_SPELLINGS))
    out: dict[str, tuple[list[str], int]] = {}
    for r in chosen.select("block", "core", F.ceil(F.col("n") / (MOST_PIVOTS * CELL_SPELLINGS)).cast("int").alias("parts")).orderBy("block", "core").collect():
        out.setdefault(r[0], ([], r[2]))[0].append(r[1])
    return out


def within_radius(spellings: DataFrame) -> DataFrame:
    """``(block, core, near)``: spellings of one block within the radius, both ways; input ``(block, core)``, distinct.

    A spelling's home is the cell of its nearest pivot. It is also put into every
    cell whose pivot is at most twice the radius further than that, for no
    spelling within the radius can have its home in another one. The cells of a
    block with more spellings than all its pivots can take are split further, by
    what is left of a spelling without one letter. Spellings of more than LONG
    letters, and those of just that many, meet by their first and last letters.
    """
    pivots = spellings.sparkSession.sparkContext.broadcast(_pivots(spellings))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, some in pdf.groupby("block")["core"]:
                marks, parts = pivots.value.get(block, ([], 1))
                cores = some.to_numpy()
                size = np.array([len(c) for c in cores])
                long = [(block, -1, zlib.crc32(end.encode()) % LONG_PARTS, c, len(c) > LONG) for c in cores[size >= LONG] for end in {c[:END], c[-END:]}]
                if long:
                    yield pd.DataFrame(long, columns=["block", "cell", "part", "core", "home"])
                cores = cores[size <= LONG]
                if not len(cores):
                    continue
                if len(marks) == 1:
                    at, who, home = np.zeros(len(cores), int), np.arange(len(cores)), np.ones(len(cores), bool)
                else:
                    far = np.array([distances(cores.tolist(), p) for p in marks])
                    nearest = far.argmin(0)
                    at, who = np.nonzero(far <= far.min(0) + 2 * RADIUS)
                    home = at == nearest[who]
                out = pd.DataFrame({"block": block, "cell": at, "part": 0, "core": cores[who], "home": home})
                if parts > 1:
                    split = [sorted({zlib.crc32(r.encode()) % parts for r in remnants(c, 1)}) for c in out["core"]]
                    out = out.assign(part=split).explode("part").astype({"part": "int64"})
                yield out

    cells = spellings.select("block", "core").mapInPandas(assign, "block string, cell int, part int, core string, home boolean")
    return cells.groupBy("block", "cell", "part").applyInPandas(_cell_join, "block string, core string, near string").distinct()


def _cell_join(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact join of one cell at the radius: spellings that share what is left without one letter are compared under the metric."""
    block = pdf["block"].iloc[0]
    meet: dict[str, list[int]] = {}
    cores, homes = pdf["core"].tolist(), pdf["home"].tolist()
    by_ends = pdf["cell"].iloc[0] < 0
    for i, core in enumerate(cores):
        for form in (("^" + core[:END], "$" + core[-END:]) if by_ends else remnants(core, RADIUS)):
            meet.setdefault(form, []).append(i)
    seen, both = set(), set()
    for members in meet.values():
        if len(members) > 1:
            for x in members:
                if homes[x]:
                    for y in members:
                        if x != y and (x, y) not in seen:
                            seen.add((x, y))
                            seen.add((y, x))
                            if (slips(cores[x], cores[y], RADIUS) if by_ends else true_distance(cores[x], cores[y])) <= RADIUS:
                                both.add((cores[x], cores[y]))
                                both.add((cores[y], cores[x]))
    return pd.DataFrame([(block, a, b) for a, b in both], columns=["block", "core", "near"])


def leaning(spellings: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(block, core, center)`` of ``spellings(block, core, n)``: each leans on its best supported neighbour, if that is better supported than itself.

    Leaning is followed, doubling each time, until no center changes: support grows along it, so it ends.
    """
    near = within_radius(spellings)
    rated = near.join(spellings.select("block", F.col("core").alias("near"), F.col("n").alias("near_n")), ["block", "near"])
    best = rated.groupBy("block", "core").agg(F.max(F.struct("near_n", "near")).alias("best"))
    own = F.struct(F.col("n").alias("near_n"), F.col("core").alias("near"))
    lean = F.when(F.col("best") > own, F.col("best.near")).otherwise(F.col("core"))
    current = cut(spellings.join(best, ["block", "core"], "left").select("block", "core", lean.alias("center")))
    for _ in range(max_rounds):
        target = current.select("block", F.col("core").alias("center"), F.col("center").alias("next"))
        moved = cut(current.join(target, ["block", "center"]).select("block", "core", F.col("next").alias("center"), (F.col("center") != F.col("next")).alias("moved")))
        current = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return current
    raise RuntimeError("leaning did not end")


def entities(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """``(val_id, entity)``: the entity each row's label names; rows without a readable label are left out.

    ``actual_label`` helps: a second spelling of the same row supplies the full
    given name where the label has an initial, and supports the right spelling.
    Repeated ids count once. An initial that fits several given names of one
    surname goes to the most frequent of them, ties to the alphabetically first.
    """
    once = keyed(rows.where("val_id is not null"), "val_id").groupBy("val_id").agg(F.min(F.struct("label", "actual_label")).alias("r")).select("val_id", "r.label", "r.actual_label")
    once = cut(once)
    texts = once.select(F.explode(F.array("label", "actual_label")).alias("text"))
    lexicon = lexicon_of(texts, forms)
    named = cut(read_labels(once, lexicon).where("name.core is not null"))
    same = F.col("other.core").isNotNull() & (F.substring("other.block", 1, 1) == F.substring("name.block", 1, 1))

    @F.pandas_udf(T.BooleanType())
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bool(x and y and slips(x, y, 2) <= 2) for x, y in zip(a, b, strict=True)])

    alike = same & close("name.core", "other.core")
    longer = (F.length("name.first") <= 1) & (F.length("other.first") > 1) & ((F.length("name.first") == 0) | F.startswith("other.first", "name.first"))
    rows2 = named.select(
        "val_id",
        F.col("name.core").alias("core"),
        F.when(alike, F.col("other.core")).alias("core2"),
        F.when(alike & longer & F.col("name.block").startswith("p"), F.col("other.first")).otherwise(F.col("name.first")).alias("first"),
        F.substring("name.block", 1, 1).alias("type"),
    )
    kind = F.when(F.col("type") == "o", F.lit("o")).otherwise(F.concat(F.lit("p"), F.substring("first", 1, 1)))
    rows3 = cut(rows2.withColumn("block", kind))
    spelled = rows3.select("block", F.explode(F.array_compact(F.array("core", "core2"))).alias("core"))
    spellings = cut(spelled.groupBy("block", "core").agg(F.count("*").alias("n")))
    centers = leaning(spellings)
    at = lambda c: centers.select("block", F.col("core").alias(c), F.col("center").alias(f"{c}_center"))
    support = spellings.select("block", F.col("core").alias("c"), F.col("n"))
    placed = rows3.join(at("core"), ["block", "core"]).join(at("core2"), ["block", "core2"], "left")
    n1 = support.select("block", F.col("c").alias("core_center"), F.col("n").alias("n1"))
    n2 = support.select("block", F.col("c").alias("core2_center"), F.col("n").alias("n2"))
    weighed = placed.join(n1, ["block", "core_center"]).join(n2, ["block", "core2_center"], "left")
    better = F.coalesce(F.col("n2") > F.col("n1"), F.lit(False))
    centred = cut(weighed.select("val_id", "block", "type", "first", F.when(better, F.col("core2_center")).otherwise(F.col("core_center")).alias("center")))
    return _agree(centred)


def _agree(centred: DataFrame) -> DataFrame:
    """Part the rows of one spelling by given name or kind; an initial, or a short form of several kinds, joins the most frequent that fits."""
    counted = centred.groupBy("block", "type", "center", "first").agg(F.count("*").alias("n"))
    options = counted.select("block", "type", "center", F.explode(F.split("first", " ")).alias("option"), "n", F.size(F.split("first", " ")).alias("of"))
    certain = options.where((F.col("of") == 1) & ((F.col("type") == "o") | (F.length("option") > 1))).select("block", "center", "option", "n")
    wanted = counted.select("block", "type", "center", "first", F.explode(F.split("first", " ")).alias("sought"))
    fits = (F.col("option") == F.col("sought")) | (F.col("type") == "p") & (F.length("sought") <= 1) & F.startswith("option", "sought")
    best = wanted.join(certain, ["block", "center"]).where(fits).groupBy("block", "center", "first").agg(F.min(F.struct((-F.col("n")).alias("n"), "option")).alias("b"))
    resolved = centred.join(best, ["block", "center", "first"], "left")
    return resolved.select("val_id", F.concat_ws("|", F.col("block"), F.col("center"), F.coalesce("b.option", "first")).alias("entity"))


def same_entity(found: DataFrame) -> DataFrame:
    """``(val_a, val_b)``: all pairs of rows of one entity."""
    found = cut(found)
    a, b = found.select("entity", F.col("val_id").alias("val_a")), found.select("entity", F.col("val_id").alias("val_b"))
    return split_join(a, b, "entity").where("val_a < val_b").select("val_a", "val_b")
