"""Every query that has SQL against it on the smallest tables."""

import glob
import os

import duckdb
import pytest

from termforge.plans import registry

SF = "/root/testdata/sf0.001"


def rows(names, data):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in data)


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        out.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return out


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    said = db.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in said.description]
    assert names == sorted(columns)
    place, found = [columns.index(n) for n in names], got.collect()
    assert found
    assert rows(names, [tuple(r[n] for n in names) for r in found]) == rows(names, [tuple(r[k] for k in place) for r in said.fetchall()])


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).head() is not None


def test_gated_selection_keeps_some_and_drops_some(spark):
    """The gate is on, some candidates pass it in all contexts, some don't, and each outer fold has a winner that passed."""
    statuses = {r.candidate_index: r.status for r in registry.QUERIES["o189_candidate_status"](spark, SF).collect()}
    assert set(statuses.values()) == {"valid", "dropped"}
    best = registry.QUERIES["o182_gated_nested_cv"](spark, SF).collect()
    assert sorted(r.outer_fold for r in best) == [0, 1, 2, 3, 4] and {statuses[r.candidate_index] for r in best} == {"valid"}
    assert {r.candidate_index for r in registry.QUERIES["o180_gated_records"](spark, SF).collect()} == {k for k, s in statuses.items() if s == "valid"}
    grid = registry.QUERIES["o177_boosting_grid"](spark, SF).collect()
    assert {r.status for r in grid} == {"valid", "dropped"} and all((r.accuracy is None) == (r.status == "dropped") for r in grid)
