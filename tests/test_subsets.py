"""The closest word subset of a title, for titles of any length."""

import random

import pytest

from cellweave.functions import text


@pytest.mark.parametrize("few", [0, 5])
def test_closest_subset_is_the_first_best_of_all(monkeypatch, few):
    monkeypatch.setattr(text, "FEW_TITLE_WORDS", few)
    rnd = random.Random(3)
    word = lambda most: "".join(rnd.choice("abAé") for _ in range(rnd.randint(1, most)))
    for _ in range(300):
        title = rnd.choice([" ", " ", "  "]).join(word(4) for _ in range(rnd.randint(1, 8))) + rnd.choice(["", "", " ", " - Wikidata"])
        query = " ".join(word(5) for _ in range(rnd.randint(0, 4))).lower()
        every = [(1 - text.ratio_of(query, p.lower()), p) for p in text.subsets(title)]
        assert text.closest_subset(query, title) == min(every, key=lambda x: x[0])
        assert text.best_match(query, [title, title]) == text.best_match(query, [min(every, key=lambda x: x[0])[1]])


def test_titles_of_more_than_twenty_words_are_searched():
    words = [f"w{i}" for i in range(30)]
    assert text.best_match("w3 w7 w29", [" ".join(words)]) == "w3 w7 w29"
    many = [f"v{i}" for i in range(75)]  # beyond 64 bits
    assert text.best_match("V1 V70", [" ".join(many)]) == "v1 v70"
    assert text.best_match("lake erie", ["Lake " + "of the very big and very old " * 3 + "Erie - Wikidata"]) == "Lake Erie"
