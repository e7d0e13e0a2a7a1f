"""Tokenizer, text form and leakage search."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cellweave.llm import leakage, textform, tokenizer

public = pytest.importorskip("tokenizers")
VOCABULARY = os.path.join(tokenizer.TOKENIZER_DIR, tokenizer.VOCABULARY)
needs_files = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")


def machine(**kw):
    with open(VOCABULARY, "rb") as f:
        return tokenizer.Transducer(tokenizer.read_ranks(f.read()), **kw)


def texts(n):
    rnd = random.Random(4)
    signs = "abcdefgh ij  \n\t'0123é日本🙂 　\x1c_-.<|>ЖΩ"
    return ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(n)] + ["", "a" * 4000, " " * 500, "<|endoftext|>", "don't we'll  x\n\n y "]


@needs_files
def test_transducer_equals_the_public_encoder():
    t = public.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    m, small = machine(), machine(max_states=50)
    for x in texts(1500):
        want = t.encode(x, add_special_tokens=False).ids
        assert m.encode(x) == want
        assert small.encode(x) == want
        assert m.decode(want) == x


@needs_files
def test_transducer_equals_plain_merging():
    m = machine()
    for x in texts(200):
        assert m.encode(x) == [i for p in m.pattern.findall(x) for i in m.merged(p.encode())]


def test_incremental_utf8():
    rnd = random.Random(5)
    for _ in range(300):
        data = bytes(rnd.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x99, 0x82, 0xED, 0xA0, 0x80, 0xFF]) for _ in range(rnd.randrange(12)))
        decoder, out, at = tokenizer.Utf8Machine(), "", 0
        while at < len(data):
            step = rnd.randrange(1, 4)
            out += decoder.feed(data[at : at + step])
            at += step
        assert out + decoder.end() == data.decode("utf-8", "replace")


@needs_files
def test_corpus_encoding_null_empty_repeats_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello", "y"), (3, "hello", "z"), (None, "a", "b")], "doc_id bigint, text string, ids string")
    got = sorted(((r["doc_id"], r["ids"]) for r in tokenizer.encode_corpus(df).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, [31373]), (3, [31373]), (None, [64])], key=str)
    back = tokenizer.decode_corpus(tokenizer.encode_corpus(df)).where("doc_id = 3").first()
    assert back["text"] == "hello"
    assert tokenizer.encode_corpus(df.limit(0)).count() == 0


SAME = [
    ("Ｐｏｒｔ ５", "Port 5"), ("é", "é"), ("e​́", "é"), ("ﬁne", "fine"), ("a b", "a b"), ("a　b", "a b"), ("a­b﻿", "ab"), ("ѕоmе", "some"), ("ё", "ë"),
    ("K", "K"), ("x\r\ny", "x\ny"), ("x \n", "x"), ("한", "한"),
]
OTHER = [("a", "A"), ("e", "é"), ("m²", "m2"), ("1", "l"), ("a b", "ab"), ("a  b", "a b"), ("ж", "x")]


def test_canonical_form():
    for a, b in SAME:
        assert textform.canonical(a) == textform.canonical(b), (a, b)
    for a, b in OTHER:
        assert textform.canonical(a) != textform.canonical(b), (a, b)
    rnd = random.Random(6)
    signs = "aẹ́​ﬁＡ  éё각xͅ"
    for _ in range(2000):
        x = "".join(rnd.choice(signs) for _ in range(rnd.randrange(12)))
        once = textform.canonical(x)
        assert textform.canonical(once) == once


def test_same_look_pairs(spark):
    rows = [(1, "Port 5"), (2, "Ｐｏｒｔ 5"), (3, "Port 5"), (4, "port 5"), (5, None), (6, ""), (7, "​"), (8, " \n"), (9, "K" * 50_000), (10, "K" * 50_000), (1, "Port 5"), (None, "Port 5")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id bigint, text string, look string")
    assert sorted(tuple(r) for r in textform.same_look(df).collect()) == [(1, 2), (2, 3), (9, 10)]
    assert textform.same_look(df.limit(0)).count() == 0
    assert {tuple(r) for r in textform.look_classes(df).collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 4, 0), (9, 9, 1), (10, 9, 1)}
    assert {r["doc_id"]: r["text"] for r in textform.canonical_text(df).where("doc_id in (5, 6)").collect()} == {5: None, 6: ""}


def test_wu_manber_equals_plain_search():
    rnd = random.Random(8)
    for _ in range(150):
        patterns = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(3, 8))): {i} for i in range(6)}
        body = "".join(rnd.choice("ab") for _ in range(60))
        want = set().union(*(w for p, w in patterns.items() if p in body), set())
        assert leakage.WuManber(patterns, block=2, suffix=3).search(body) == want
    assert leakage.WuManber({}).search("abc") == set()


WORDS = "Nobody knows why the old table carries a code instead of Kranvo today really".split()


def test_leaks(spark):
    passage = " ".join(WORDS)
    twelve, eleven = " ".join(WORDS[1:13]), " ".join(WORDS[1:12])
    docs = [
        (1, f"x {twelve} y"), (2, f"x {eleven} y"), (3, passage.upper().replace(" ", "  ")), (4, passage.replace("code", "<b>coԁe</b>").replace("o", "о")), (5, None), (6, ""),
        (7, "z" * 100_000 + twelve), (8, passage.replace(" ", " &amp; ")), (1, f"x {twelve} y"),
    ]
    items = [(10, passage), (11, None), (12, ""), (13, "too short"), (14, passage), (None, passage)]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, item_id int")
    q = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((d, i) for d in (1, 3, 4, 7, 8) for i in (10, 14))
    assert sorted(tuple(r) for r in leakage.leaked(d, q).collect()) == want
    assert sorted(tuple(r) for r in leakage.leaked(d, q, broadcast_runs=0).collect()) == want
    assert leakage.leaked(d.limit(0), q, broadcast_runs=0).count() == 0
    assert leakage.leaked(d, q.limit(0)).count() == 0 and leakage.leaked(d.limit(0), q).count() == 0
    assert {r["item_id"]: r["documents"] for r in leakage.leak_report(leakage.leaked(d, q)).collect()} == {10: 5, 14: 5}


def test_both_forms_of_the_leakage_search_agree(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "eval_item"))
    one, other = (sorted(tuple(r) for r in leakage.leaked(docs, items, broadcast_runs=n).collect()) for n in (10**9, 0))
    assert one == other and one
    long = "é🙂ab" * 9
    assert leakage.window_hashes(long, 5).tolist() == [leakage.window_hashes(long[i : i + 5], 5)[0] for i in range(len(long) - 4)]
