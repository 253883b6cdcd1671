"""Stored tables with text codes, blanks and Julian dates give every job's result."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from checks.compare import digest, duck
from devicelens.sources import LOGICAL_TABLES, SCHEMAS, catalog_tables, parquet_tables, typed, unreadable_values
from devicelens.sources.schema import julian_date
from tests.conftest import SF_SMALL, own_jobs

ORACLE = own_jobs(entry.oracle_sql())


def as_text(df, table):
    """The table as a source may store it: text, padded codes, Julian dates."""
    out = []
    for c, kind in SCHEMAS[table].items():
        v = F.col(c)
        if kind == "julian":
            v = ((F.year(v) - 1900) * 1000 + F.dayofyear(v)).cast("decimal(6,0)")
        elif kind == "code":
            v = F.concat(F.lit(" "), v, F.lit("   "))
        elif kind != "text":
            v = F.concat(v.cast("string"), F.lit("  "))
        out.append(v.alias(c.upper()))
    more = [] if table in ("clients", "associates") else [F.lit("more").alias("LoadedBy")]  # the lookups return all columns
    return df.select(*out, *more)


@pytest.fixture(scope="module")
def stored(spark, driver_t, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    for table, name in LOGICAL_TABLES.items():
        as_text(driver_t[table], table).coalesce(1).write.parquet(f"{root}/{name}")
    return root


def test_every_logical_table_is_declared(driver_t):
    assert set(SCHEMAS) == set(LOGICAL_TABLES)
    for table in SCHEMAS:
        assert typed(driver_t[table], table).schema.simpleString() == driver_t[table].schema.simpleString()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_jobs_on_stored_tables(spark, stored, monkeypatch, name):
    monkeypatch.setitem(entry._TABLES, (spark.sparkContext.applicationId, SF_SMALL), parquet_tables(spark, stored))
    df = own_jobs(entry.queries())[name](spark, SF_SMALL)
    res = duck(SF_SMALL).execute(ORACLE[name])
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest([c[0] for c in res.description], res.fetchall())


def test_unreadable_codes_are_kept_apart(spark):
    raw = spark.createDataFrame([(" 924 ", "1"), ("A4", "2"), ("A4", "x"), ("", "3"), (None, None), ("4.0", "4")], "Code string, Description string")
    assert [r.Code for r in typed(raw, "event_codes").collect()][:5] == [924, None, None, None, None]
    bad = {(r.table_name, r.column_name, r.value): r.row_count for r in unreadable_values({"event_codes": raw}).collect()}
    assert bad[("event_codes", "Code", "A4")] == 2 and ("event_codes", "Code", "") not in bad
    reps = spark.createDataFrame([(1, " 7 ", "124366"), (2, "8", "0"), (3, "9", "2024-02-30"), (4, "", "125001"), (5, "x", "2024-02-29")],
                                 "CMAN8 long, CMSLSM string, CMSTMEDT string").withColumn("CMAN8", F.col("CMAN8").cast("decimal(8,0)"))
    got = typed(reps, "multi_rep").collect()
    assert [r.CMAN8 for r in got] == ["1", "2", "3", "4", "5"] and [r.CMSLSM for r in got] == ["7", "8", "9", None, "x"]
    assert [r.CMSTMEDT for r in got] == [dt.date(2024, 12, 31), None, None, dt.date(2025, 1, 1), dt.date(2024, 2, 29)]
    assert [(r.column_name, r.value) for r in unreadable_values({"multi_rep": reps}).collect()] == [("CMSTMEDT", "2024-02-30")]


def test_julian_days(spark):
    numbers = [(99365,), (100001,), (100366,), (101366,), (0,), (None,), (124000,)]
    got = [r[0] for r in spark.createDataFrame(numbers, "n int").select(julian_date(F.col("n"))).collect()]
    assert got == [dt.date(1999, 12, 31), dt.date(2000, 1, 1), dt.date(2000, 12, 31), None, None, None, None]


def test_declared_columns_pass_bare_and_missing_ones_are_named(spark, driver_t, tmp_path):
    driver_t["events"].write.saveAsTable("stored_events")
    try:
        events = catalog_tables(spark, {"events": "stored_events"})["events"].where(F.col("EventCode") == 924)
        assert "EqualTo(EventCode,924)" in events._jdf.queryExecution().executedPlan().toString()
        codes = catalog_tables(spark, {"events": "stored_events"}, trim=False)["events"].where(F.col("SrcID") == "00373")
        assert "EqualTo(SrcID,00373)" in codes._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("DROP TABLE stored_events")
    with pytest.raises(ValueError, match="event_codes lacks the columns Description"):
        typed(spark.createDataFrame([(1,)], T.StructType([T.StructField("code", T.IntegerType())])), "event_codes")
