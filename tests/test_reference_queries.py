"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import importlib

import duckdb
import pytest

import __spark_entry__ as entry_points
from oreshaft import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=repr)
    assert got


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark, sf_dir):
    assert entry_points.entry(spark).columns == ["d1", "d2", "jsd"]
    assert set(catalog.QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_the_rest_stands_without_the_training_data_package(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("oreshaft.llm", "corpus_pipeline")) else find(name, *a))
    assert set(entry_points.queries()) == set(catalog.QUERIES)
    assert set(entry_points.oracle_sql()) == set(catalog.ORACLES)
