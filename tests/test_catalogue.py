"""Queries of the engine against their SQL twins in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from strataframe.plans import catalogue, scenarios

SF = "/root/testdata/sf0.001"
#: Those that build a repository of their own take seconds each; these stand for their kinds.
SOME = ["repo_flat_tensors", "repo_nested_texts", "repo_column_specs", "repo_multi_get", "repo_dataset_keys", "repo_diff_diverged", "repo_conflicts", "repo_merge_three_way", "repo_log", "repo_verify_damage", "repo_nested_writes", "repo_bulk_import", "repo_export_files", "repo_fetch_samples", "repo_push"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


def values(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", [*catalogue.QUERIES, *SOME])
def test_query_is_its_sql(spark, tables, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = tables.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert values(map(tuple, got.select(*names).collect())) == values(want.fetchall())


def test_every_engine_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL) and set(scenarios.QUERIES) == set(scenarios.SQL)
    assert not set(catalogue.QUERIES) & set(scenarios.QUERIES)


def test_a_streamed_column_is_kept_in_bounds(spark, tables, monkeypatch):
    """The loop holds a few digests at a time, whatever the column's values."""
    monkeypatch.setattr(scenarios, "_SEEN", 7)
    scenarios._library(spark, SF)
    make, given = type(spark).createDataFrame, []
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: given.append(list(data)) or make(self, given[-1], *a, **b))
    got = scenarios.repo_streamed_values(spark, SF)
    want = tables.execute(scenarios.SQL["repo_streamed_values"])
    assert values(map(tuple, got.select(*[d[0] for d in want.description]).collect())) == values(want.fetchall())
    assert max(map(len, given)) == 7 and not any(isinstance(v, (bytes, bytearray)) for rows in given for r in rows for v in r)
