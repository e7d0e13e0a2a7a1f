"""Candidate retrieval against brute force: frequent keys, shares of a key, long and odd texts."""

import random

import numpy as np
import pytest

from cellweave import annotation
from cellweave.functions.text import ratio_of
from cellweave.operators import candidates


def keys(text):
    return {w[:4] for w in text.lower().split() if len(w) >= 5}


def brute(mentions, known, limit):
    rows = []
    for m in sorted({m for m in mentions if m}):
        near = sorted((-ratio_of(m, t), i) for i, t in known if keys(m) & keys(t))
        rows += [(m, i, pos) for pos, (_, i) in enumerate(near[:limit])]
    return sorted(rows)


def test_ratios_are_those_of_the_plain_form():
    rnd = random.Random(5)
    texts = lambda n, most: ["".join(rnd.choice("abcd é😀\0") for _ in range(rnd.randint(1, most))) for _ in range(n)]
    mentions, titles = [*texts(40, 64), "a" * 64, "b" * 70, *texts(3, 100)], [*texts(60, 40), "a" * 300, "ab" * 128]
    got = candidates.ratios(mentions, titles)
    assert all(got[i, j] == ratio_of(m, t) for i, m in enumerate(mentions) for j, t in enumerate(titles))


def test_pair_ratios_are_those_of_the_plain_form():
    rnd = random.Random(6)
    word = lambda most: "".join(rnd.choice("abcd é😀\0") for _ in range(rnd.randint(0, most)))
    left, right = [*(word(64) for _ in range(50)), "", "b" * 70], [*(word(40) for _ in range(50)), "", "a" * 300]
    i, j = np.array([rnd.randrange(len(left)) for _ in range(900)]), np.array([rnd.randrange(len(right)) for _ in range(900)])
    assert candidates.pair_ratios(left, right, i, j).tolist() == [ratio_of(left[a], right[b]) for a, b in zip(i, j)]
    assert len(candidates.pair_ratios([], [], i[:0], j[:0])) == 0


def test_mentions_like_their_entity_are_retrieved(spark, sf):
    """Recall of the cells whose text resembles the title of their entity: the others name it by nothing a text search can find."""
    folder = sf.replace("sf0.001", "sf0.01")
    truth = annotation.spell_pairs(spark, folder).distinct().collect()
    alike = {(r["label"], r["entity_id"]) for r in truth if ratio_of(r["label"].lower(), r["actual_label"].lower()) >= 0.7}
    top = {(r["mention"], r["entity_id"]) for r in annotation.candidate_topk(spark, folder).collect()}
    assert len(alike) > 100 and len(alike & top) >= 0.99 * len(alike)


@pytest.mark.parametrize("chunk", [4096, 7])
def test_frequent_keys_keep_their_entities(spark, monkeypatch, chunk):
    """Sixty entities share each key; the exactly spelled one comes first, and the list is that of all pairs."""
    monkeypatch.setattr(candidates, "CHUNK", chunk)
    rnd = random.Random(1)
    known = [(i, f"Krantrostina {''.join(rnd.choices('abcdefg', k=5))} Observatory") for i in range(60)] + [(100, "Krantrostina Observatory"), (101, "")]
    mentions = ["Krantrostina Observatory", "krantrostina obzervatory", known[3][1], "Observatory", "", None, "no key", "Krantrostina Observatory"]
    frames = spark.createDataFrame([(m,) for m in mentions], "mention string"), spark.createDataFrame(known, "id bigint, title string")
    for limit in (30, 2):
        got = sorted(tuple(r) for r in candidates.top_candidates(*frames, limit).collect())
        assert got == brute(mentions, known, limit)
    assert ("Krantrostina Observatory", 100, 0) in got


def test_registered_queries_use_all_thirty(spark, sf):
    top = annotation.candidate_topk(spark, sf)
    each = annotation.open_dataset(spark, sf).join(top, "mention")
    found = annotation.label_vectors(spark, sf)
    assert found.agg({"pos": "max"}).first()[0] > 4
    assert found.count() == each.count()
    assert annotation.candidate_recall(spark, sf).first()["hit"] == each.where("entity_id = correct_id").count()


def test_requests_for_the_cells_of_every_column(spark, sf):
    asked = annotation.search_request(spark, sf).select("mention")
    every = annotation.distinct_mentions(spark, sf).select("mention")
    assert asked.count() == every.count() and every.subtract(asked).isEmpty()
