"""Physical-plan shape: the optimisations the jobs rely on are really planned."""

import pytest

import __spark_entry__ as entry
from devicelens.plans import devices as V
from devicelens.plans import sales as S
from tests.conftest import SF_SMALL, own_jobs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_placement_uses_window_group_limit(driver_t):
    assert "WindowGroupLimit" in plan(V.first_events(driver_t))


def test_pool_audit_is_a_semi_join(driver_t):
    from devicelens.plans import depot as D
    assert "LeftSemi" in plan(D.pool_shipments(driver_t))


@pytest.mark.parametrize("name", sorted(own_jobs(entry.queries())))
def test_no_python_evaluation(spark, name):
    p = plan(entry.queries()[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas"):
        assert node not in p


def test_event_window_reaches_the_scan(spark):
    p = plan(entry.queries()["depot_activity"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def test_report_is_dealt_once_for_group_by_and_distinct(driver_t, no_broadcast):
    p = plan(S.biomed_sales(driver_t, min_fiscal_month="199500"))
    dealt = "Exchange hashpartitioning(ORDR_NUM"
    assert p.count(dealt) == 1
    # Above the deal there is only the exchange of the specialists' join, no aggregation's.
    above = p.split(dealt)[0]
    assert above.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(BILL_TO_CUST_NUM" in above
    assert above.count("HashAggregate") + above.count("SortAggregate") == 4


def test_lines_are_summed_while_narrow(driver_t, no_broadcast):
    """The only exchange of single fact lines carries their keys and partial sums; the joins see groups."""
    p = plan(S.sales_groups(driver_t, min_fiscal_month="199500"))
    lines = p.split("Exchange hashpartitioning(SLS_ID")
    # The order join's exchange stands above the sum, which has its own below.
    assert "HashAggregate(keys=[SLS_ID" in lines[1] and "partial_sum(LINES" in lines[2]


def test_stored_sales_are_pruned_and_joined_without_exchange(spark, driver_t):
    # Few days, on both sides of the first selected month.
    some = driver_t["fact_sales"].where("DIM_GL_DT_ID BETWEEN 19970301 AND 19970420")
    driver_t = driver_t.override(fact_sales=some)
    t = S.store_sales(driver_t, "laid_out_", buckets=4)
    try:
        first = driver_t["period"].where("DIM_PERIOD_ID = 19970401").first().FISC_YR_MTH_NUM
        kw = dict(min_fiscal_month=first, stored=True)
        p = plan(S.sales_groups(t, **kw))
        assert "dynamicpruning" in p and "SelectedBucketsCount: 4 out of 4" in p
        same = lambda df: sorted(map(str, df.collect()))
        assert same(S.transactions(t, **kw)) == same(S.transactions(driver_t, min_fiscal_month=first))
        assert 0 < t["fact_sales"].where("DIM_GL_DT_ID >= 19970401").count() < some.count()
        assert "hashpartitioning(SLS_ID" not in p and "hashpartitioning(DIM_BIOMED" not in p
    finally:
        for name in ("fact_sales", "biomed_sales"):
            spark.sql(f"DROP TABLE laid_out_{name}")


def test_hot_bill_to_is_spread(spark, driver_t, no_broadcast):
    from pyspark.sql import functions as F

    one = driver_t["customers_blend"].withColumn("BILL_TO_CUST_E1_NUM", F.lit("1"))
    rows = S.transactions(driver_t.override(customers_blend=one), min_fiscal_month="199500")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)


def test_date_range_reaches_a_stored_fact(spark, driver_t, tmp_path):
    from devicelens.sources import LOGICAL_TABLES, catalog_tables, parquet_tables

    for name, stored in LOGICAL_TABLES.items():
        driver_t[name].write.parquet(str(tmp_path / stored))
    t = parquet_tables(spark, str(tmp_path))
    p = plan(S.sales_lines(t, min_fiscal_month="199500"))
    assert "IsNotNull(DIM_GL_DT_ID), GreaterThan" in p  # the plan's text cuts long filter lists
    rows = lambda x: sorted(map(str, S.gl_measures(x, min_fiscal_month="199500").collect()))
    assert rows(t) == rows(driver_t)
    for stored in LOGICAL_TABLES.values():
        spark.read.parquet(str(tmp_path / stored)).createOrReplaceTempView(stored)
    assert rows(catalog_tables(spark)) == rows(driver_t)
    assert rows(t) == sorted(map(str, S.gl_measures(t, lines=S.sales_lines(t, min_fiscal_month="199500", derive_date_range=False)).collect()))


def test_deal_stands_below_the_calendar_and_the_sum_above_the_accounts(driver_t, no_broadcast):
    p = plan(S.biomed_sales(driver_t, min_fiscal_month="199500", as_of="2025-03-03"))
    join = lambda key: p.index(f"[{key}#")
    dealt, summed = p.index("REPARTITION_BY_COL"), p.index("functions=[sum(LINES")
    assert join("cal_id") < dealt < join("cus_id") < join("i_id") < summed < join("gls_id")
    # The exchange for the names carries no column that follows from others.
    named = p[p.index("Exchange hashpartitioning(BILL_TO_CUST_NUM"):]
    named = named[named.index("HashAggregate("):].split("output=[")[1].split("]")[0]
    assert "REF_NUM" in named and not [c for c in ("OTORDERNUM", "MSTR_GRP_NAME_TRIM", "PPPM_OR", "SLS_OEM_FEES") if c in named]
