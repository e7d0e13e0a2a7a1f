"""Annotation operators: definitions against brute force, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions import text
from cellweave.operators import candidates, cells, entities, evaluation, features, linking, models
from cellweave.plans import pipeline
from cellweave.sources import sinks, tables, web
from cellweave.streaming import increments


def col(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


def test_indel_ratio():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc é") for _ in range(rnd.randrange(12))) for _ in range(2))
        assert text.common_length(a, b) == lcs(a, b)
    assert round(text.ratio_of("lewenstein", "levenshtein"), 3) == 0.857
    assert text.ratio_of("", "") == 1.0 and text.ratio_of("", "a") == 0.0


def test_text_functions(spark):
    assert col(spark, text.remove_stopwords, ["The quick brown fox jumps over the lazy dog.", "", None, "don't"]) == ["quick brown fox jumps lazy dog", "", "", "dont"]
    assert col(spark, text.strip_end, ["abc.-; ?!", "...", "", None]) == ["abc", "", "", None]
    assert col(spark, text.last_segment, ["http://x/Q12", "Q12", "", None]) == ["Q12", "Q12", "", None]
    assert col(spark, text.numeric_id, ["Q12", "Q", "", None, "Qx"]) == [12, None, None, None, None]
    assert col(spark, text.is_complete, ["a...", "a"]) == [False, True]


@pytest.mark.parametrize("title", ["", "one", "a b", "a  b - Wikidata", " ".join("abcdefghijkl"), " ".join(["w"] * 21)])
def test_title_subsets(spark, title):
    assert col(spark, text.title_subsets, [title])[0] == text.subsets(title)
    assert len(text.subsets("a b c")) == 7


def test_best_match_rules():
    assert text.best_match("q", []) == "q"
    assert text.best_match("lake erie", ["Lake Erie - Wikidata", "Erie"]) == "Lake Erie"
    assert text.best_match("o'neil", ["O’neil."]) == "O'neil"


def test_gold_and_cells(spark):
    rows = spark.createDataFrame([("T1", 1, "a", "", None, None, None), ("T1", 1, "a", "", None, None, None), ("T1", None, "x", None, None, None, None)], "tab_id string, row_id int, col0 string, col1 string, col2 string, col3 string, col4 string")
    assert sorted(tuple(r) for r in cells.cells(rows).collect()) == [("T1", 1, 0, "a"), ("T1", 1, 1, "")]
    gold = spark.createDataFrame(
        [(1, "abcd1234.csv", "003", "0", "http://x/Q1 http://x/q2"), (2, "ABCD1234", "3", "0", "Q9"), (3, "ABCD1234", "4", "0", None), (4, None, "1", "1", "Q1"), (5, "ABCD1234", "x", "1", "Q1")],
        "gt_id bigint, tab_id string, row_id string, col_id string, entity string",
    )
    assert [tuple(r) for r in cells.gold_cells(gold).collect()] == [("ABCD1234", 3, 0, [9], 9)]


def test_deny_list(spark):
    gold = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "url string")
    deny = spark.createDataFrame([("a",), (None,)], "url string")
    assert sorted((r[0] for r in cells.without(gold, deny, "url").collect()), key=str) == [None, "b"]


def known_rows(spark, n, rnd):
    words = "red blue green lake hill".split()
    pick = lambda k: [rnd.randrange(6) for _ in range(rnd.randrange(k))]
    rows = [(i, f"name {i % 4}", " ".join(rnd.choices(words, k=rnd.randrange(4))), pick(4), pick(5)) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, title string, description string, instances array<bigint>, subclasses array<bigint>"), rows


def cosine(a, b):
    from collections import Counter

    x, y = Counter(a.split()), Counter(b.split())
    dot = sum(x[w] * y[w] for w in x)
    return dot / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5 if dot else 0.0


def test_linear_features_equal_the_pairwise_definition(spark):
    rnd = random.Random(7)
    known, rows = known_rows(spark, 12, rnd)
    by = {r[0]: r for r in rows}
    found = [("t", row, 0, rnd.choice([1, 2, 3]) if row % 3 else 2, e, pos) for row in range(6) for pos, e in enumerate(rnd.sample(range(12), 4))]
    truth = {}
    found = [(t, row, c, truth.setdefault(row, k), e, p) for t, row, c, k, e, p in found]
    df = spark.createDataFrame(found, "tab_id string, row int, col int, correct_id bigint, entity_id bigint, pos int")
    got = {(r["row"], r["pos"]): (r["inst"], r["subc"], r["descr"], r["lex"]) for r in features.column_features(df, known).collect()}
    assert len(got) == len(found)
    joined = {(r["row"], r["pos"]): (r["inst"], r["subc"], r["descr"], r["lex"]) for r in features.column_features(df, known, column_rows=3).collect()}
    assert set(joined) == set(got) and all(joined[k] == pytest.approx(got[k], abs=1e-9) for k in got)
    for _, row, _, k, e, pos in found:
        others = [x[4] for x in found if x[3] != k]
        ti, ts = sum(len(by[o][3]) for o in others), sum(len(by[o][4]) for o in others)
        rest = [o for o in others if o != e]
        inst = sum(len(set(by[e][3]) & set(by[o][3])) for o in rest) / ti if ti else 0
        subc = sum(len(set(by[e][4]) & set(by[o][4])) for o in rest) / ts if ts else 0
        desc = sum(cosine(by[e][2], by[o][2]) for o in rest) / len(rest) if rest else 0
        lex = text.ratio_of(by[e][1], by[k][1])
        assert got[row, pos] == pytest.approx((inst, subc, desc, lex), abs=1e-9)


def test_features_without_truth_entity_or_rows(spark):
    known = spark.createDataFrame([(1, "a", None, [5, 5, None], None), (2, "", "lake", None, [7])], "id bigint, title string, description string, instances array<bigint>, subclasses array<bigint>")
    schema = "tab_id string, row int, col int, correct_id bigint, entity_id bigint, pos int"
    rows = [("t", 1, 0, None, 1, 0), ("t", 1, 0, None, 9, 1), ("t", 2, 0, 2, 2, 0), (None, 1, 0, 8, 1, 0)]
    got = {(r["tab_id"], r["row"], r["pos"]): r for r in features.column_features(spark.createDataFrame(rows, schema), known).collect()}
    assert set(got) == {("t", 1, 0), ("t", 2, 0), (None, 1, 0)}  # entity 9 is unknown
    assert got["t", 1, 0]["lex"] is None and got["t", 2, 0]["lex"] == 1.0 and got[None, 1, 0]["lex"] is None
    assert features.column_features(spark.createDataFrame([], schema), known).count() == 0


def test_latest_delivery_counts_as_a_whole(spark):
    import datetime

    t = [datetime.datetime(2024, 1, d) for d in (1, 2)]
    rows = spark.createDataFrame([("T1", 1, "z", None, None, None, None, t[0]), ("T1", 1, "a", "b", None, None, None, t[1])], "tab_id string, row_id int, col0 string, col1 string, col2 string, col3 string, col4 string, loaded_at timestamp")
    assert sorted(tuple(r) for r in cells.cells(rows).collect()) == [("T1", 1, 0, "a"), ("T1", 1, 1, "b")]
    gold = spark.createDataFrame([(1, "ABCD1234", "9", "0", "Q9", t[0]), (1, "ABCD1234", "3", "0", "Q1", t[1])], "gt_id bigint, tab_id string, row_id string, col_id string, entity string, loaded_at timestamp")
    assert [tuple(r) for r in cells.gold_cells(gold).collect()] == [("ABCD1234", 3, 0, [1], 1)]
    known = spark.createDataFrame([(1, "z", "old", [9], None, t[0]), (1, "a", None, [1], None, t[1])], "id bigint, title string, description string, instances array<bigint>, subclasses array<bigint>, fetched_at timestamp")
    assert [tuple(r) for r in entities.catalogue(known).collect()] == [(1, "a", "", [1], [])]


def test_best_candidate_ties_and_nan(spark):
    rows = [("t", 1, 0, 5, 7, 0, 1.0), ("t", 1, 0, 5, 8, 1, 1.0), ("t", 2, 0, 5, 9, 0, float("nan")), ("t", 2, 0, 5, 3, 1, 0.0), ("t", 3, 0, 5, 3, 1, None)]
    df = spark.createDataFrame(rows, "tab_id string, row int, col int, correct_id bigint, entity_id bigint, pos int, score double")
    assert {(r["row"], r["entity_id"]) for r in linking.best_candidate(df).collect()} == {(1, 7), (2, 3)}
    data = spark.createDataFrame([("t", 1, 0, 7), ("t", 2, 0, 1), ("t", 9, 0, 1)], "tab_id string, row int, col int, correct_id bigint")
    r = linking.accuracy(data, linking.best_candidate(df)).first()
    assert (r["cells"], r["right"], r["right_strict"]) == (3, 2, 1)


def test_claims(spark):
    body = """{"labels":{"en":{"value":"L"}},"descriptions":{},"claims":{"P31":[
      {"mainsnak":{"snaktype":"value","datatype":"wikibase-item","property":"P31","datavalue":{"value":{"id":"Q5"}}}},
      {"mainsnak":{"snaktype":"novalue","datatype":"wikibase-item","property":"P31"}},
      {"mainsnak":{"snaktype":"value","datatype":"string","property":"P31","datavalue":{"value":"x"}}},
      {"mainsnak":{"snaktype":"value","datatype":"wikibase-item","property":"P31","datavalue":{"value":{"id":"Q5"}}}}]}}"""
    df = spark.createDataFrame([(1, body), (2, "{}"), (3, None), (4, '{"labels":[]')], "id bigint, body string")
    got = {r["id"]: r for r in entities.parse(df).collect()}
    assert got[1]["title"] == "L" and got[1]["description"] is None
    assert [tuple(c) for c in got[1]["claims"]] == [("P31", "Q5")] * 2
    assert got[2]["claims"] == [] and got[3]["claims"] == []


def test_retrieval(spark):
    known = spark.createDataFrame([(1, "Lake Varomi"), (2, "Varomi River"), (3, "")], "id bigint, title string")
    top = candidates.top_candidates(spark.createDataFrame([("Lake Varomi",), ("Lake Varomi",), ("",), (None,)], "mention string"), known)
    assert sorted(tuple(r) for r in top.collect()) == [("Lake Varomi", 1, 0), ("Lake Varomi", 2, 1)]


def test_merge_right(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted((tuple(r) for r in candidates.merge_right(a, b, "k", "v").collect()), key=str) == [(1, "a"), (2, None), (3, "c")]


P = "http://www.wikidata.org/entity/"


def test_cell_scores(spark):
    gold = spark.createDataFrame([("t", "1", "0", f"{P}Q1 {P}Q2"), ("t", "2", "0", f"{P}Q3")], "tab_id string, row_id string, col_id string, gold string")
    keys = ["tab_id", "row_id", "col_id"]
    said = spark.createDataFrame([("t", "1", "0", "q2"), ("t", "2", "0", "Q9"), ("x", "1", "0", "Q1"), ("x", "1", "0", "Q1")], "tab_id string, row_id string, col_id string, annotation string")
    r = evaluation.cell_scores(said, gold, keys, P, several=True).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5)
    with pytest.raises(Exception, match="duplicate"):
        evaluation.cell_scores(said.union(said), gold, keys, P, several=True).collect()
    r = evaluation.cell_scores(said.limit(0), gold, keys, P, several=True).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)
    assert evaluation.cell_scores(said, gold.limit(0), keys, P, several=True).first()["recall"] == 0.0


@pytest.mark.parametrize(("kind", "depth", "score"), [("ancestor", 5, 0.8**5), ("ancestor", 6, 0.0), ("descendant", 3, 0.7**3), ("descendant", 4, 0.0)])
def test_type_scores(spark, kind, depth, score):
    gold = spark.createDataFrame([("t", "0", f"{P}Q1 {P}Q7")], "tab_id string, col_id string, gold string")
    near = spark.createDataFrame([(f"{P}Q1", f"{P}Q2", kind, depth)], "gt_type string, rel string, kind string, depth int")
    said = spark.createDataFrame([("t", "0", "q2"), ("z", "0", "Q2")], "tab_id string, col_id string, annotation string")
    r = evaluation.type_scores(said, gold, near, P).first()
    assert r["precision"] == pytest.approx(score / 2) and r["recall"] == pytest.approx(score)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "A1.csv").write_text('col0,col1\r\n"Moni, C",\r\n"x\ny",z,extra\r\n', encoding="utf-8")
    got = sorted(tuple(r) for r in tables.csv_cells(spark, str(tmp_path / "t")).collect())
    assert got == [("A1", 0, 0, "col0"), ("A1", 0, 1, "col1"), ("A1", 1, 0, "Moni, C"), ("A1", 1, 1, ""), ("A1", 2, 0, "x\ny"), ("A1", 2, 1, "z"), ("A1", 2, 2, "extra")]
    (tmp_path / "gt.csv").write_text("A1,1,0,http://x/Q1\nA1,NA,0,\n")
    assert [tuple(r) for r in tables.ground_truth(spark, str(tmp_path / "gt.csv")).collect()] == [("A1", 1, 0, "http://x/Q1"), ("A1", None, 0, "")]
    (tmp_path / "up.json").write_text('{"a":{"b":"1"}}')
    (tmp_path / "down.json").write_text('{"a":{"c":"2"}}')
    hier = tables.type_hierarchy(spark, str(tmp_path / "up.json"), str(tmp_path / "down.json"))
    assert sorted(tuple(r) for r in hier.collect()) == [("a", "b", "ancestor", 1), ("a", "c", "descendant", 2)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "k.json").write_text('{"_type":"SearchResponse","queryContext":{"originalQuery":"Foo"}}')
    assert [r["asked"] for r in tables.search_folder(spark, str(tmp_path / "s")).collect()] == ["foo"]
    df = spark.createDataFrame([("A1_1_0", 'say "hi"')], "key string, body string")
    sinks.save(df, str(tmp_path / "o"))
    sinks.save(df, str(tmp_path / "o"))
    assert tables.dump(spark, str(tmp_path / "o")).count() == 1
    sinks.save_run(df, str(tmp_path / "r"), "a")
    sinks.save_run(df, str(tmp_path / "r"), "b")
    assert tables.dump(spark, str(tmp_path / "r")).count() == 2
    for n in range(12):
        sinks.save_slot(df.withColumn("step", F.lit(n)), str(tmp_path / "k"), n)
    number, newest = sinks.resume(spark, str(tmp_path / "k"))
    assert number == 11 and [r["step"] for r in newest.collect()] == [11] and len(list((tmp_path / "k").iterdir())) == 9
    sinks.append_csv(df, str(tmp_path / "c"))
    assert [r["body"] for r in tables.annotations(spark, str(tmp_path / "c"), ["key", "body"]).collect()] == ['say "hi"']
    sinks.save_cell_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["tab_id"] == "A1"


def test_requests_keep_failures(spark):
    def get(url):
        if "bad" in url:
            raise OSError("down")
        return (429, "") if "busy" in url else (200, '{"search":[{"id":"Q4"},{"id":"Q2"}]}')

    df = spark.createDataFrame([("a", "ok"), ("b", "ok"), ("c", "busy"), ("d", "bad")], "mention string, url string")
    got = web.fetch(df, get, partitions=2, wait=0.01)
    assert {r["mention"]: r["error"] for r in got.collect()} == {"a": None, "b": None, "c": "rate limit", "d": "down"}
    assert sorted(tuple(r) for r in web.found_ids(got.where("error is null")).where("mention = 'a'").collect()) == [("a", 2, 1), ("a", 4, 0)]
    assert col(spark, lambda x: web.entity_search_url("http://h/api", x), ["a b"])[0].endswith("limit=30&search=a+b")


def test_pipeline_both_variants(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    for variant in ("raw", "spell"):
        run = pipeline.annotate(t("table_rows"), t("cea_gt"), t("candidate"), t("kg_item"), t("raw_response"), variant, limit=3)
        r = run.accuracy.first()
        assert r["cells"] == run.dataset.count() and r["right"] >= r["right_strict"] > 0


def test_tuning(spark, sf, tmp_path):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    run = pipeline.annotate(t("table_rows"), t("cea_gt"), t("candidate"), t("kg_item"), limit=3)
    rows = models.labelled(run.featured).limit(200).cache()
    best = models.tuned(rows, {"maxDepth": [2], "maxIter": [2, 3]}, folds=2)
    scores = models.grid_scores(best)
    assert [s for s, _ in scores] == ['{"maxDepth": 2, "maxIter": 2}', '{"maxDepth": 2, "maxIter": 3}'] and all(0 <= v <= 1 for _, v in scores)
    models.save(best.bestModel, str(tmp_path / "m"))
    again = models.load(spark, str(tmp_path / "m"))
    assert again.transform(rows).select("prediction").collect() == best.bestModel.transform(rows).select("prediction").collect()
    for loss, far in (("huber", lambda a, b: (a - b) ** 2), ("quantile", lambda a, b: 0.9 * (a - b) if a > b else 0.1 * (b - a))):
        total = [sum(far(r["label"], r["prediction"]) for r in models.fit_loss(rows, loss, rounds=n, step=0.5, depth=3, least=1).transform(rows).collect()) for n in (0, 3)]
        assert total[1] < total[0]


def test_stream_skips_what_is_done(spark, tmp_path):
    src = str(tmp_path / "in")
    args = dict(folder=src, schema="tab_id string, row_id int, col0 string", state=str(tmp_path / "state"), output=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"), work=lambda df: df.select("tab_id", "row_id"))
    for rows in ([("a", 1, "x"), ("a", 1, "x")], [("a", 1, "y"), ("b", 1, "z")]):
        spark.createDataFrame(rows, args["schema"]).coalesce(1).write.mode("append").parquet(src)
        increments.process_new_rows(spark, **args).awaitTermination()
    assert sorted((r["tab_id"], r["row_id"]) for r in spark.read.parquet(args["output"]).collect()) == [("a", 1), ("b", 1)]


def test_recogniser_can_be_replaced(spark):
    df = spark.createDataFrame([("Krelvo", "river in Tolva county, known since 1898"), (None, None)], "t string, d string")
    own = lambda text: F.array(F.lit("PERSON"), F.lit("PERSON"), F.lit("nothing"))
    labels = lambda *a: [r[0] for r in df.select(text.entity_labels(F.col("t"), F.col("d"), *a)).collect()]
    assert labels() == [[5, 6, 12, 18], []] and labels(own) == [[1], [1]]


HIT = '{"id":"Q1","title":"t","pageid":1,"display":{"label":{"value":"v","language":"en"}},"repository":"wikidata","url":"u","concepturi":"c","label":"l","match":{"type":"label","language":"en","text":"x"}%s}'
ANSWER = '{"searchinfo":{"search":"s"},"search":[%s],"success":1%s}'


def test_strict_validation(spark):
    from cellweave.operators import validation

    hit = HIT % ""
    cases = [
        (ANSWER % (hit, ""), None),
        (ANSWER % ("", ',"search_continue":7'), None),
        (ANSWER % (HIT % ',"description":"d","aliases":["a"]', ""), None),
        (ANSWER % (HIT % ',"aliases":[]', ""), None),
        (ANSWER % (hit, ',"more":1'), "unknown field"),
        (ANSWER.replace('{"search":"s"}', '{"search":"s","x":1}') % (hit, ""), "searchinfo"),
        (ANSWER % (hit, ',"search_continue":"7"'), "search_continue"),
        (ANSWER.replace(":1%s", ":2%s") % (hit, ""), "success"),
        (ANSWER % ("5", ""), "hit: not an object"),
        (ANSWER % (HIT % ',"x":1', ""), "hit: unknown field"),
        (ANSWER % (hit.replace('"url":"u"', '"url":null'), ""), "hit: text field"),
        (ANSWER % (hit.replace('"pageid":1', '"pageid":"1"'), ""), "hit: pageid"),
        (ANSWER % (hit.replace("wikidata", "other"), ""), "hit: repository"),
        (ANSWER % (hit.replace('"language":"en"}}', '"language":"en","x":1}}'), ""), "hit: display"),
        (ANSWER % (hit.replace('"language":"en"}}', '"language":"en"},"x":1}'), ""), "hit: display"),
        (ANSWER % (hit.replace('"language":"en"}}', '"language":"en"},"description":"d"}'), ""), "hit: display"),
        (ANSWER % (hit.replace('"language":"en"}}', '"language":"en"},"description":{"value":"d","language":null}}'), ""), "hit: display"),
        (ANSWER % (hit.replace('"text":"x"', '"text":1'), ""), "hit: match"),
        (ANSWER % (hit.replace('"text":"x"', '"text":"x","y":1'), ""), "hit: match"),
        (ANSWER % (hit.replace('"type":"label"', '"type":"title"'), ""), "hit: match"),
        (ANSWER % (HIT % ',"description":null', ""), "hit: description"),
        (ANSWER % (HIT % ',"aliases":["a",null]', ""), "hit: aliases"),
        (ANSWER % (HIT % ',"aliases":"a"', ""), "hit: aliases"),
        ("[]", "not an object"),
    ]
    docs = spark.createDataFrame([(i, body) for i, (body, _) in enumerate(cases)], "response_id int, body string").select("response_id", F.expr("parse_json(body)").alias("doc"))
    got = {r["response_id"]: r["reason"] for r in validation.validated(docs).collect()}
    assert got == {i: why for i, (_, why) in enumerate(cases)}
