"""The search inside the executors, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave import annotation
from cellweave.functions.text import ratio_of
from cellweave.operators import candidates, titlesearch


def texts(seed, n, most, letters="abcdeé ÀŻ😀"):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, most))) for _ in range(n)})


@pytest.fixture
def frames(spark):
    titles = [*texts(1, 300, 12), *texts(2, 40, 90, "ab 1"), "a" * 64, "ab" * 200, "a" * 130, "Lima", *["Rio"] * 40, ""]
    known = [(7 * i % 1009, t) for i, t in enumerate(titles)]
    mentions = [*texts(3, 60, 9), *texts(4, 20, 80), *texts(5, 9, 3, "xyz"), "b" * 63, "ab" * 32, "b" * 65, "aaaa" * 50, "QX 1", "YX 1", "Lima", "Rio", "\0", "", None]
    wanted = {}
    for limit in (1, 30, 500):
        wanted[limit] = sorted((m, i, pos) for m in {m for m in mentions if m} for pos, (_, i) in enumerate(sorted((-ratio_of(m, t), i) for i, t in known if t)[:limit]))
    return spark.createDataFrame([(m,) for m in mentions], "mention string"), spark.createDataFrame(known, "id bigint, title string"), wanted


@pytest.mark.parametrize("limit", [1, 30, 500])
@pytest.mark.parametrize("shard", [2_000_000, 100])
def test_the_best_are_those_of_all_pairs(monkeypatch, frames, limit, shard):
    """Texts of any length, letters that no title has, titles of many entities, more wanted than there are."""
    monkeypatch.setattr(candidates, "SHARD", shard)
    assert sorted(tuple(r) for r in candidates.nearest_entities(*frames[:2], limit).collect()) == frames[2][limit]


def test_titles_of_very_many_letters_are_searched_by_arrays(spark, monkeypatch, frames):
    letters = [chr(c) for c in range(0x20000, 0x20000 + 66_000)]
    known = frames[1].unionAll(spark.createDataFrame([(2000 + i, "".join(letters[1000 * i : 1000 * i + 1000])) for i in range(66)], "id bigint, title string"))
    with pytest.warns(UserWarning, match="too many different letters"):
        got = candidates.nearest_entities(frames[0].where("mention in ('Lima', 'Rio')"), known, 1)
    assert sorted(tuple(r) for r in got.collect()) == [r for r in frames[2][1] if r[0] in ("Lima", "Rio")]


def test_candidate_topk_compares_inside_the_executors(spark, sf):
    """With arrays in Python workers the pairs of check_l took 204 s."""
    plan = annotation.candidate_topk(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_scores_are_the_similarities(spark):
    titles = spark.createDataFrame([("Lima", [4]), ("Limo", [2, 9])], "title string, ids array<bigint>")
    asked = spark.createDataFrame([("Lima x",)], "mention string")
    found = asked.select(F.explode(titlesearch.scored(titlesearch.nearest(titles, 2, 3, scores=True))).alias("f")).select("f.*")
    assert [tuple(r) for r in found.collect()] == [(4, ratio_of("Lima x", "Lima")), (2, ratio_of("Lima x", "Limo")), (9, ratio_of("Lima x", "Limo"))]
