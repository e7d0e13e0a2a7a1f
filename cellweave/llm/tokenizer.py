"""Byte-level BPE as a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of its bytes exactly when each adjacent
pair is the encoding of its own concatenation. The nondeterministic transducer
guesses where tokens end and keeps that pair condition; the deterministic one
is its subset construction with delayed output. States are built when first
reached and kept in a table which is dropped when it exceeds ``max_states``; the
memo of short pieces is dropped at twice that (results depend on neither). The pair
condition is decided from the merges on both sides of the boundary, with one
table entry for each token of the vocabulary at most.

Vocabulary files are never part of the repository: their folder is a parameter.
"""

from __future__ import annotations

import base64
import gc
import os
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cellweave.runtime import spread

TOKENIZER_DIR = os.environ.get("CELLWEAVE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the public pre-tokenisation pattern, white space as in Unicode's White_Space property.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to id, from the content of a rank file."""
    ranks = {}
    for line in raw.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class _State(dict):
    """One subset of hypotheses; maps a byte to (next state, ids that became certain)."""

    __slots__ = ("machine", "last", "hypotheses", "final")

    def __init__(self, machine: Transducer, last: int, hypotheses: tuple):
        self.machine = machine
        self.last = last
        self.hypotheses = hypotheses
        self.final = hypotheses[-1][0]  # the hypothesis that ends a token comes last

    def __missing__(self, byte: int):
        step = self.machine.step(self, byte)
        if len(self.machine.states) <= self.machine.max_states:
            self[byte] = step
        return step


class Transducer:
    """Encoder of one byte-level BPE vocabulary.

    A hypothesis is the ids guessed since the last certain one, and the place in
    the prefix tree of the vocabulary that the bytes after them lead to.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000):
        self.ranks = ranks
        self.max_states = max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.tree: dict[int, int] = {}  # node * 256 + byte -> node
        self.token_at = [-1]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.tree.get(key)
                if node is None:
                    node = self.tree[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = i
        self.halves: dict[int, tuple[int, int]] = {}  # at most one entry for each token
        self.known: dict[str, list[int]] = {}  # the transducer's output for short pieces
        self.states: dict[tuple, _State] = {}
        self.pattern = regex.compile(PIECES)
        self._clear()

    def _clear(self) -> None:
        for state in self.states.values():
            state.clear()  # states point at each other: this frees them at once
        self.states = {}
        self.start = self._state(-1, (((), 0),))

    def _state(self, last: int, hypotheses: tuple) -> _State:
        key = (last, hypotheses)
        found = self.states.get(key)
        if found is None:
            found = _State(self, last, hypotheses)
            self.states[key] = found
        return found

    def merged(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """The plain definition: merge the adjacent pair of least rank until none under ``below`` is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [self.ranks.get(a + b, below) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least >= below:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = self.ranks.get(parts[at] + parts[at + 1], below)
            if at:
                ranks[at - 1] = self.ranks.get(parts[at - 1] + parts[at], below)
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; (-1, -1) for a byte, (-2, -2) for a token that merging never makes."""
        found = self.halves.get(token)
        if found is None:
            data = self.bytes_of[token]
            parts = self.merged(data, token) if len(data) > 1 else ()
            found = tuple(parts) if len(parts) == 2 else (-1, -1) if not parts else (-2, -2)
            self.halves[token] = found
        return found

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps the boundary between two tokens.

        The boundary is followed back through the merges of both sides: the
        pieces beside it exist until the later merge of either is undone, and the
        boundary is lost when they merge with each other before that. Of equal
        merges the one further left comes first.
        """
        halves = self.halves
        if (halves.get(right) or self._halves(right))[0] == -2:
            return False
        ranks, bytes_of = self.ranks, self.bytes_of
        until_left = until_right = 1 << 60
        while left >= 0 and right >= 0:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and across < until_left and across <= until_right:
                return False
            if left > right:
                until_left = left
                left = (halves.get(left) or self._halves(left))[1]
            else:
                until_right = right
                right = (halves.get(right) or self._halves(right))[0]
        return True

    def step(self, state: _State, byte: int) -> tuple[_State, tuple]:
        """The successor of ``state`` under ``byte`` and the ids that all remaining hypotheses share."""
        after = []
        tree, token_at = self.tree, self.token_at
        ended = None  # the bytes so far have one encoding, so one hypothesis ends a token here
        for ids, node in state.hypotheses:
            longer = tree.get(node << 8 | byte)
            if longer is not None:
                after.append((ids, longer))
                if ended is None and token_at[longer] >= 0:
                    token = token_at[longer]
                    if self._compatible(ids[-1] if ids else state.last, token):
                        ended = (*ids, token)
        after.append((ended, 0))
        head = after[0][0]
        if not head:
            return self._state(state.last, tuple(after)), ()
        shared = 0
        for those in zip(*[ids for ids, _ in after], strict=False):
            if those.count(those[0]) < len(those):
                break
            shared += 1
        if not shared:
            return self._state(state.last, tuple(after)), ()
        return self._state(head[shared - 1], tuple([(ids[shared:], node) for ids, node in after])), head[:shared]

    def encode(self, text: str) -> list[int]:
        """Ids of one text, without special tokens; ``''`` gives ``[]``."""
        if len(self.states) > self.max_states:
            self._clear()
        if len(self.known) > 2 * self.max_states:
            self.known = {}
        known = self.known
        ids: list[int] = []
        extend = ids.extend
        start = self.start
        for piece in self.pattern.findall(text):
            found = known.get(piece)
            if found is not None:
                extend(found)
                continue
            at = len(ids)
            state = start
            for byte in piece.encode("utf-8"):
                state, out = state[byte]
                if out:
                    extend(out)
            extend(state.final)
            if len(piece) <= 32:
                known[piece] = ids[at:]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, token by token through the UTF-8 state machine; broken bytes become U+FFFD."""
        decoder = Utf8Machine()
        text = [decoder.feed(self.bytes_of[i]) for i in ids]
        text.append(decoder.end())
        return "".join(text)


class Utf8Machine:
    """Incremental UTF-8: complete code points leave at once, an open sequence waits for its bytes."""

    def __init__(self) -> None:
        self.need = self.code = 0
        self.low, self.high = 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.code = self.code << 6 | b & 0x3F
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.need = 0
                self.low, self.high = 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.low = 0xA0 if b == 0xE0 else 0x80
                self.high = 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low = 0x90 if b == 0xF0 else 0x80
                self.high = 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """What is left when the input ends: a cut sequence counts as one broken character."""
        left, self.need = self.need, 0
        self.low, self.high = 0x80, 0xBF
        return "�" if left else ""


_machines: dict[int, Transducer] = {}


def _machine(raw) -> Transducer:
    """One transducer for each vocabulary and Python worker."""
    key = hash(raw.value)
    if key not in _machines:
        _machines[key] = Transducer(read_ranks(raw.value))
    return _machines[key]


@contextmanager
def _no_collection() -> Iterator[None]:
    """Without runs of the cycle collector: it would walk all states again and again, and these are freed by ``_clear``."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _vocabulary(df: DataFrame, path: str | None):
    """The rank file as a broadcast: its size is that of one published vocabulary (under 1 MB), not of the data."""
    with open(path or os.path.join(TOKENIZER_DIR, VOCABULARY), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``(key, ids)`` of every row: whole texts, one narrow pass.

    Null and empty texts give an empty list; strings that look like special
    tokens are ordinary text; repeated rows stay repeated.
    """
    raw = _vocabulary(df, path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(raw)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            with _no_collection():
                for t in batch.column(1).to_pylist():
                    if t:
                        flat.extend(machine.encode(t))
                    ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.asarray(ends)), pa.array(np.asarray(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``(key, text)`` of encoded rows; a null or empty list gives ``''``, null elements are skipped."""
    raw = _vocabulary(df, path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(raw)
        for batch in batches:
            texts = [machine.decode(i for i in x if i is not None) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return spread(df.select(key, ids)).mapInArrow(run, f"`{key}` {kind}, text string")
