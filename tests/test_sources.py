"""The test-data adapters: every logical table follows its driver table."""

import duckdb
import pytest

from tests.conftest import SF_SMALL


def _count(table):
    return duckdb.sql(f"SELECT count(*) FROM '{SF_SMALL}/{table}.parquet'").fetchall()[0][0]


def _where(table, cond):
    return duckdb.sql(f"SELECT count(*) FROM '{SF_SMALL}/{table}.parquet' WHERE {cond}").fetchall()[0][0]


@pytest.mark.parametrize("logical,expected", [
    ("events", lambda: _count("events")),
    ("devices", lambda: _count("customer")),
    ("clients", lambda: _count("nation") + _count("customer")),
    ("associates", lambda: _count("supplier")),
    ("repair_tickets", lambda: _where("events", "event_type = 'error'")),
    ("po_receipts", lambda: _count("orders")),
    ("import_history", lambda: _where("orders", "o_orderkey % 13 <> 0 AND o_custkey % 9 <> 0")),
    ("fact_sales", lambda: _count("lineitem")),
    ("items", lambda: _count("part")),
    ("biomed_sales", lambda: _count("orders")),
    ("customers_blend", lambda: _count("customer")),
    ("account_managers", lambda: _count("supplier")),
])
def test_logical_tables_follow_driver_tables(driver_t, logical, expected):
    assert driver_t[logical].count() == expected()


def test_every_event_has_a_known_code(driver_t):
    from pyspark.sql import functions as F
    ev, codes = driver_t["events"], driver_t["event_codes"]
    assert ev.where(F.col("EventCode").isNull()).count() == 0
    assert ev.join(codes, ev.EventCode == codes.Code, "left_anti").count() == 0


def test_depots_and_own_sites(driver_t):
    from pyspark.sql import functions as F
    from devicelens.functions import rules as R
    c = driver_t["clients"]
    assert c.where(F.col("ID").isin(list(R.DEPOTS))).count() == len(R.DEPOTS)
    assert c.where(F.col("FK_ParentCompanyId") == R.OWN_PARENT).count() == 5
    assert c.select("ID").distinct().count() == c.count()
