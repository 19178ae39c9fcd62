"""Every query with a SQL statement gives the same rows in both engines, on whole tables."""
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from phrasemill.plans import oracle, queries as plain

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = plain.QUERIES, oracle.ORACLE
WITHOUT_SQL = {"pca_project", "project_texts_3d", "project_words_3d", "pca_sweep", "pca_sweep_models", "decision_grid", "decision_trees"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = [tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in frame.itertuples(index=False)]
    return sorted(map(repr, plain))


def test_every_query_is_listed():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL and set(ORACLE) <= set(QUERIES)
    assert QUERIES.items() <= entry.queries().items() and ORACLE.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got, want = df.toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_words_limit_runs_ahead_of_the_shuffle(spark):
    plan = QUERIES["top_words_per_category"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
