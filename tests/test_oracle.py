"""Every registered job equals its independent DuckDB SQL (sf0.001)."""

import pytest

import __spark_entry__ as entry
from checks.compare import digest, duck
from tests.conftest import SF_SMALL, own_jobs

QUERIES = own_jobs(entry.queries())
ORACLE = own_jobs(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = digest(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLE[name])
    want = digest([c[0] for c in res.description], res.fetchall())
    assert got[1] == want[1], "column names differ"
    assert got[0] == want[0], "row counts differ"
    assert got[2] == want[2], "values differ"


def test_entry_runs_with_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["eventYear", "eventMonth", "LocationName", "ownershipType",
                          "eventType", "eventCount"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_output_column_names_are_unique(spark, name):
    cols = QUERIES[name](spark, SF_SMALL).columns
    assert len(cols) == len({c.lower() for c in cols})
