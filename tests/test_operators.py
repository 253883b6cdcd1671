"""Reusable operators: latest-per-key, after-latest, key audit, lookup, sources."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from devicelens.operators.audit import key_multiplicity
from devicelens.operators.joins import after_latest, latest_per_key
from devicelens.plans import depot as D
from devicelens.session import ensure_checkpoint_dir
from devicelens.sources import LOGICAL_TABLES, catalog_tables, jdbc_tables


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_after_latest_keeps_rows_after_the_overall_latest_marker(spark):
    marks = spark.createDataFrame([("a", ts("2024-11-01")), ("a", ts("2024-11-10")),
                                   ("b", ts("2024-11-03"))], "k string, t timestamp_ntz")
    rows = spark.createDataFrame([("a", 1, ts("2024-11-05")), ("a", 2, ts("2024-11-12")),
                                  ("b", 3, ts("2024-11-03")), ("c", 4, ts("2024-11-30"))],
                                 "k string, id int, done timestamp_ntz")
    latest = latest_per_key(marks, "k", "t", "last_mark")
    got = sorted(r.id for r in after_latest(rows, latest, "k", "done", "last_mark").collect())
    assert got == [2]   # 1 is before a's latest mark, 3 is not strictly after, c has none


def test_many_audits_equal_single_ones(spark):
    from devicelens.operators.audit import key_multiplicities

    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, None), (None, "<null>"), (None, "<null>")], "k int, v string")
    b = spark.createDataFrame([(1,), (1,), (1,)], "k int")
    got = key_multiplicities([(a, {"k": "A k", "v": "A v"}), (b, {"k": "B"}), (b.limit(0), {"k": "C"})])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = key_multiplicity(a, "k", "A k").union(key_multiplicity(a, "v", "A v")).union(key_multiplicity(b, "k", "B"))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 6


def test_key_multiplicity_reports_repeated_keys_only(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "p"), (None, "q")],
                               "k long, v string")
    got = sorted((r.table_name, r.key_value, r.row_count)
                 for r in key_multiplicity(df, "k", "T").collect())
    assert got == [("T", "1", 2), ("T", "<null>", 2)]


def test_lookup_is_ordered_top_n(driver_t):
    df = D.lookup(driver_t, "clients", F.col("PK_ClientId") >= 0, "PK_ClientId", n=3)
    assert [r.PK_ClientId for r in df.collect()] == [0, 1, 2]


def test_readers_are_lazy(spark):
    t = catalog_tables(spark, prefix="no_such_db.")
    assert set(t) == set(LOGICAL_TABLES)
    j = jdbc_tables(spark, "jdbc:sqlserver://host;databaseName=ops", {"user": "u"},
                    partitions={"events": ("EventId", 0, 100, 4)}, base=t)
    assert set(j) == set(LOGICAL_TABLES)   # nothing is read until a table is used


def test_session_keeps_what_the_operator_set():
    """In a process of its own: settings of spark-submit survive, others get our defaults."""
    import subprocess
    import sys

    code = ("from devicelens.session import get_session; s = get_session('local[1]'); "
            "print(s.conf.get('spark.sql.autoBroadcastJoinThreshold'), s.conf.get('spark.sql.files.maxPartitionBytes'))")
    env = dict(os.environ, PYSPARK_SUBMIT_ARGS="--conf spark.sql.autoBroadcastJoinThreshold=77 pyspark-shell")
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120,
                         cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).stdout.split()
    assert out[-2:] == ["77", str(128 * 1024 * 1024)]


def test_unset_checkpoint_folder_is_an_error_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
