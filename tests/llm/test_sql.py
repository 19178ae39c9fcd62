"""Queries that SQL can express, against their SQL over whole tables."""

import os

import duckdb
import pytest

from phrasemill.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(ORACLE) - {"op12_lexical_search"}))
def test_same_rows(spark, name):
    base = duckdb.connect()
    for file in os.listdir(FOLDER):
        base.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    got, want = QUERIES[name](spark, FOLDER), base.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    told = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert told(got.select(*columns).collect()) == told(want.select(*columns).fetchall())
