"""Every core query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from gridimpact.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.8g}")
    return value


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in relation.fetchall()), key=repr)


def test_queries_without_sql(spark):
    assert QUERIES["two_stage_predict"](spark, DATA).count() > 0
    for row in QUERIES["shap_attributions"](spark, DATA).collect():
        assert abs(row.total - row.prediction) < 1e-5


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
