"""Edge cases of the general data-processing operators."""

import datetime
import random

from cellweave import runtime
from cellweave.operators import components, hierarchy, nested, rejects

CANDIDATE = "id bigint, title string, description string, instances array<bigint>, subclasses array<bigint>, fetched_at timestamp, node string, parent string, component string"


def candidates(spark, rows):
    return spark.createDataFrame([(i, None, None, inst, sub, None, "x", "y", "z") for i, inst, sub in rows], CANDIDATE)


def brute(parent):
    """Root and depth of each node by following links one by one."""
    out = {}
    for node in parent:
        seen, at = [node], node
        while True:
            up = parent.get(at)
            if up is None:
                out[node] = (at, len(seen) - 1)
                break
            if up in seen:
                out[node] = (min(seen[seen.index(up) :]), -1)
                break
            seen.append(up)
            at = up
            if at not in parent:
                out[node] = (at, len(seen) - 1)
                break
    return out


def forest(seed, n):
    rnd = random.Random(seed)
    return {i: rnd.choice([None, *range(n + 3)] + [max(0, i - 1)] * n) for i in range(n)}


def test_hierarchy_equals_brute_force(spark):
    for seed in (1, 2):
        parent = forest(seed, 60)
        links = spark.createDataFrame(list(parent.items()), "node bigint, parent bigint")
        want = brute(parent)
        got = {r["node_id"]: (r["root_id"], r["depth"]) for r in hierarchy.hierarchy(links).collect()}
        assert got == want
        full = hierarchy.hierarchy(links)
        doubled = hierarchy.hierarchy(links, in_task=5)
        rows = lambda df: sorted((tuple(r) for r in df.drop("component").collect()), key=str)
        assert rows(doubled) == rows(full) and any(r["back_edge"] for r in full.collect())
        assert rows(hierarchy.descendants(doubled)) == rows(hierarchy.descendants(full))
        assert {r["node_id"]: (r["root_id"], r["depth"]) for r in hierarchy.hierarchy(links, paths=False, in_task=5).collect()} == want


def test_walk_paths_and_back_edge():
    rows = {r[0]: r for r in hierarchy.walk([1, 2, 3, 4, 7, 8, 9, 10], [None, 1, 2, 1, 9, 7, 8, 7], True)}
    assert rows[3][1:4] == (1, 2, [1, 2, 3]) and rows[4][3] == [1, 4]
    assert rows[10][1:3] == (7, -1) and rows[10][4] is False and rows[10][3] is None
    assert [n for n, r in rows.items() if r[4]] == [8]


def test_deep_chain_needs_no_recursion():
    n = 20_000
    rows = list(hierarchy.walk(list(range(n)), [None, *range(n - 1)], False))
    assert rows[-1][2] == n - 1


def test_class_links_nulls_repeats_and_clashing_columns(spark):
    df = candidates(spark, [(1, None, None), (2, [], [1]), (2, [], [1, 1]), (3, [5], [1]), (4, None, [None]), (None, None, [1]), (6, None, [99]), (7, None, [7])])
    got = {r["node"]: r["parent"] for r in hierarchy.class_links(df).collect()}
    assert got == {1: None, 2: 1, 4: None, 6: 99, 7: 7}
    found = {r["node_id"]: (r["root_id"], r["depth"]) for r in hierarchy.hierarchy(hierarchy.class_links(df)).collect()}
    assert found == {1: (1, 0), 2: (1, 1), 4: (4, 0), 6: (99, 1), 7: (7, -1)}


def test_hierarchy_of_nothing(spark):
    assert hierarchy.hierarchy(spark.createDataFrame([], "node bigint, parent bigint")).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 10), (5, 5), (None, 4), (3, 1), (1, 2)]
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 5: 5}


T0 = datetime.datetime(2024, 1, 1)


def flat(spark, bodies):
    rows = [(i, b, T0, "x") for i, b in bodies]
    df = spark.createDataFrame(rows, "response_id bigint, body string, received_at timestamp, child string")
    return sorted(tuple(r) for r in nested.flat_tables(df).collect())


def test_nested_shapes(spark):
    web = '{"_type":"S","queryContext":{"originalQuery":"q"},"webPages":{"value":[{"name":"a","deepLinks":[{"name":"l0"},{"name":null}]},{"url":"u"}]}}'
    one = '{"webPages":{"value":{"name":"solo","deepLinks":{"name":"d"}}}}'
    kg = '{"searchinfo":{"search":"k"},"search":[{"id":"Q1","display":{"label":{"value":"L"}},"aliases":["x",5]},{"id":null,"display":{},"aliases":"y"},{"display":null,"aliases":null}]}'
    assert flat(spark, [(1, web)]) == [(1, "link", 0, 0, "l0"), (1, "link", 0, 1, ""), (1, "page", 0, -1, "a"), (1, "page", 1, -1, ""), (1, "query", -1, -1, "q")]
    assert flat(spark, [(2, one)]) == [(2, "link", 0, 0, "d"), (2, "page", 0, -1, "solo"), (2, "query", -1, -1, "")]
    assert flat(spark, [(3, kg)]) == [
        (3, "alias", 0, 0, "x"), (3, "alias", 0, 1, "5"), (3, "alias", 1, 0, "y"), (3, "display", 0, -1, "L"),
        (3, "hit", 0, -1, "Q1"), (3, "hit", 1, -1, ""), (3, "hit", 2, -1, ""), (3, "query", -1, -1, "k"),
    ]


def test_nested_broken_bodies_and_repeats(spark):
    bad = ['{"a":1', '{"a":1} x', "", None, "   ", '{"a":1}]', '{"a":1},{"b":2}', "{'a':1}", "1}"]
    assert flat(spark, [(i, b) for i, b in enumerate(bad)]) == []
    assert flat(spark, [(1, '{"a":1'), (1, "{}"), (1, "{}"), (None, "{}")]) == [(1, "query", -1, -1, "")]
    assert flat(spark, [(1, "[]"), (2, "null"), (3, '"t"')]) == [(i, "query", -1, -1, "") for i in (1, 2, 3)]
    assert flat(spark, []) == []


LINES = [
    ("cea_gt", "ABCD1234,1,0,http://x/Q1", None),
    ("cea_gt", '"ABCD1234","1","0","a ""b"", c"\r', None),
    ("tables", "ABCD1234,1,,", None),
    ("tables", 'ABCD1234,1,"x\ny",-1.5e+3', None),
    ("tables", "ABCD1234,1,x,+7", None),
    ("tables", "ABCD1234,1,x,5.", "invalid_value"),
    ("tables", "ABCD1234,1,x,abc", "invalid_value"),
    ("tables", "ABCD1234,1,x", "column_count"),
    ("tables", "ABCD1234,1,x,1,2", "column_count"),
    ("tables", "", "column_count"),
    ("tables", None, "column_count"),
    ("cea_gt", 'ABCD1234,1,0,"open', "quoting"),
    ("cea_gt", 'ABCD1234,1,0,"a"b', "quoting"),
    ("cea_gt", 'ABCD1234,1,0,a"b"', "quoting"),
    ("cea_gt", 'ABCD1234,1"", 0,x', "quoting"),
    ("cea_gt", "abcd1234,1,0,x", "invalid_value"),
    ("cea_gt", "ABCD1234,١,0,x", "invalid_value"),
    ("cea_gt", "ABCD1234,1,-1,x", "invalid_value"),
    ("cea_gt", "ABCD1234,1,0, \t", "invalid_value"),
    ("cea_gt", 'ABCD1234,1,0,""', "invalid_value"),
    ("cea_gt", "ABCD1234\n,1,0,x", "invalid_value"),
    ("cea_gt", 'ABCD1234,1,0,"' + 'y""' * 20_000 + '"', None),
]


def test_reject_reasons(spark):
    rows = [(i, f, "file", line, T0, "q") for i, (f, line, _) in enumerate(LINES)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "line_id bigint, feed string, file_name string, line string, received_at timestamp, reason string")
    recs = rejects.records(df)
    failed = rejects.errors(recs)
    assert {r["line_id"]: r["reason"] for r in failed.collect()} == {i: why for i, (_, _, why) in enumerate(LINES) if why}
    good = {r["line_id"]: r for r in rejects.valid_rows(recs, failed).collect()}
    assert set(good) == {i for i, (_, _, why) in enumerate(LINES) if not why}
    assert good[1]["entity"] == 'a "b", c' and good[3]["col0"] == "x\ny" and good[2]["col1"] == ""


def test_rejects_of_nothing(spark):
    df = spark.createDataFrame([], "line_id bigint, feed string, line string, received_at timestamp")
    assert rejects.errors(rejects.records(df)).count() == 0


def test_rejects_long_digits_control_signs_and_unknown_feeds(spark):
    lines = [("cea_gt", f"ABCD1234,{'7' * 40},0,x"), ("tables", 'ABCD1234,1,"a\x01b,c",2'), ("tables", "ABCD1234,1,a\x01cb,2"), ("other", "bad,1,2,3"), (None, "ABCD1234,1,2,3"), ("other", "a,b")]
    df = spark.createDataFrame([(i, f, line, T0) for i, (f, line) in enumerate(lines)], "line_id bigint, feed string, line string, received_at timestamp")
    recs = rejects.records(df)
    failed = rejects.errors(recs)
    assert {r["line_id"]: r["reason"] for r in failed.collect()} == {3: "unknown_feed", 4: "unknown_feed", 5: "column_count"}
    good = {r["line_id"]: r for r in rejects.valid_rows(recs, failed).collect()}
    assert good[0]["row_id"] == "7" * 40 and good[1]["col0"] == "a\x01b,c" and good[2]["col0"] == "a\x01cb" and set(good) == {0, 1, 2}


def test_nested_repeated_keys_last_value_counts(spark):
    assert flat(spark, [(1, '{"search":[{"id":"Q1","id":"Q2"}],"searchinfo":{"search":"a"},"searchinfo":{"search":"b"}}')]) == [(1, "hit", 0, -1, "Q2"), (1, "query", -1, -1, "b")]


def test_split_join_equals_the_plain_join(spark):
    rnd = random.Random(3)
    left = spark.createDataFrame([("hot" if i % 3 else rnd.choice("abc"), i) for i in range(300)] + [(None, 1)], "k string, x int")
    right = spark.createDataFrame([(k, y) for y, k in enumerate(["hot", "hot", "a", "b", "z", None])], "k string, y int")
    assert [r["k"] for r in runtime.hot_keys(left, "k", rows=60).collect()] == ["hot"]
    got = sorted(tuple(r) for r in runtime.split_join(left, right, "k", rows=60).select("k", "x", "y").collect())
    assert got == sorted(tuple(r) for r in left.join(right, "k").select("k", "x", "y").collect())
    assert runtime.split_join(left.limit(0), right, "k").count() == 0
