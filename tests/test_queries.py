"""Every registered query against its SQL twin on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cellweave import oracle, registry

SLOW = {"train_score", "feature_importance", "grid_search"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    return c


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query_matches_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in oracle.SQL:
        assert cols
        return
    rel = con.sql(oracle.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(x[i]) for i in at) for x in rel.fetchall()), key=repr)


def test_models_score_and_rank(spark, sf):
    rows = registry.QUERIES["train_score"](spark, sf).collect()
    assert len(rows) == 1 and rows[0]["cells"] > 0
    weights = registry.QUERIES["feature_importance"](spark, sf)
    assert weights.count() == 5
    assert abs(weights.agg(F.sum("importance")).first()[0] - 1.0) < 1e-6


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["tab_id", "row", "col", "correct_id", "entity_id"]
    assert set(oracle.SQL) <= set(registry.QUERIES)
