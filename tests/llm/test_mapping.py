"""Two slips in a short particular word."""

from cellweave.llm import mapping
from cellweave.llm.names import remnants, slips


def test_two_slips_leave_a_remnant():
    for a, b in (("rodrokeke", "rodorkee"), ("rirojijan", "rroijjan"), ("abcdefgh", "badcefgh"), ("abc", "abc")):
        if slips(a, b, 2) <= 2:
            assert remnants(a, 2) & remnants(b, 2)


def test_two_exchanges_in_a_short_word_are_mapped(spark):
    names = [f"Church of {w}" for w in ("Rodrokeke", "Rirojijan", "Balentum", "Kosivara", "Tumeldok", "Pradinel")]
    items = spark.createDataFrame([(f"Q{i}", "item", n, None) for i, n in enumerate(names)], "item_id string, kind string, label string, aliases array<string>")
    typed = ["church of rodorkee", "church of rroijjan", "church of ablentmu", "church of zzzzzzzz"]
    gold = spark.createDataFrame([(i, None, t) for i, t in enumerate(typed)], "gt_id bigint, loaded_at timestamp, entity string")
    assert sorted(tuple(r) for r in mapping.mapped(gold, items).collect()) == [(0, "Q0"), (1, "Q1"), (2, "Q2"), (3, "")]


def test_codes_and_slips_in_common_words(spark):
    names = [f"{w} Observatory" for w in ("Rodrokeke", "Rirojijan", "Balentum", "Kosivara", "Tumeldok", "Pradin")] + ["STE 2174"]
    items = spark.createDataFrame([(f"Q{i}", "item", n, None) for i, n in enumerate(names)], "item_id string, kind string, label string, aliases array<string>")
    typed = ["STE2174", "ste-2174", "STE 2175", "Pradin Obsrevatoyr", "pradin observatory of the rodrokeke"]
    gold = spark.createDataFrame([(i, None, t) for i, t in enumerate(typed)], "gt_id bigint, loaded_at timestamp, entity string")
    assert sorted(tuple(r) for r in mapping.mapped(gold, items).collect()) == [(0, "Q6"), (1, "Q6"), (2, ""), (3, "Q5"), (4, "")]
