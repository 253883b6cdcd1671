"""Ranges for parallel reads: whole, without overlap, balanced on gaps and clusters."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from devicelens.sources.ranges import bounds_sql, counts_sql, cut_points, fill_ranges, plan_reads, range_predicates


def counter(keys):
    def count(low, width, high):
        found = {}
        for k in keys:
            if k is not None and low <= k <= high:
                found[(k - low) // width] = found.get((k - low) // width, 0) + 1
        return list(found.items())
    return count


def sizes(con, predicates):
    return [con.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone()[0] for p in predicates]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(10**12), 10**12) | st.integers(-50, 50), min_size=1, max_size=200), st.integers(2, 9))
def test_ranges_hold_every_key_once_and_none_is_crowded(keys, tasks):
    filled = fill_ranges(min(keys), max(keys), tasks, counter(keys), rounds=50)
    assert sum(n for *_, n in filled) == len(keys)
    assert all(a[1] < b[0] for a, b in zip(filled, filled[1:]))
    cuts = cut_points(filled, tasks)
    assert cuts == sorted(set(cuts)) and len(cuts) < 2 * tasks
    share, edges = -(-len(keys) // tasks), [min(keys), *cuts, max(keys) + 1]
    for a, b in zip(edges, edges[1:]):
        held = [k for k in keys if a <= k < b]
        assert len(held) <= share or len(set(held)) == 1


@pytest.mark.parametrize("rows", [
    "SELECT range AS k FROM range(10000)",
    "SELECT CASE WHEN range < 9000 THEN range ELSE range * 1000000007 END AS k FROM range(10000)",  # a cluster and far keys
    "SELECT -range * range AS k FROM range(10000)"])
def test_counted_by_a_database_in_sql(rows):
    con = duckdb.connect()  # in this process
    con.execute(f"CREATE TABLE t AS {rows} UNION ALL SELECT NULL FROM range(7)")
    predicates = plan_reads("k", 16, lambda: con.execute(bounds_sql("t", "k")).fetchone(),
                            lambda *a: con.execute(counts_sql("t", "k", *a)).fetchall())
    held = sizes(con, predicates)
    assert sum(held) == 10007 and 16 <= len(held) <= 32 and max(held) <= 625 + 7
    con.execute("INSERT INTO t VALUES (-999999999999999), (999999999999999999)")  # after the counts
    assert sum(sizes(con, predicates)) == 10009


def test_one_hot_key_stands_alone_and_empty_tables_are_one_read():
    keys = [5] * 500 + list(range(100, 600))
    filled = fill_ranges(5, 599, 4, counter(keys))
    assert (5, 5, 500) in filled
    assert range_predicates("k", cut_points(filled, 4))[0] == f"k < {cut_points(filled, 4)[0]} OR k IS NULL"
    assert plan_reads("k", 8, lambda: (None, None), counter([])) == ["1 = 1"]


def test_counts_on_spark_equal_the_reads(spark, driver_t):
    events = driver_t["events"].select("EventId")
    events.createOrReplaceTempView("ranged_events")
    predicates = plan_reads("EventId", 8, lambda: tuple(spark.sql(bounds_sql("ranged_events", "EventId")).first()),
                            lambda *a: [tuple(r) for r in spark.sql(counts_sql("ranged_events", "EventId", *a)).collect()])
    held = [events.where(p).count() for p in predicates]
    assert sum(held) == events.count() and len(held) >= 8 and max(held) <= -(-sum(held) // 8)
    spark.catalog.dropTempView("ranged_events")
