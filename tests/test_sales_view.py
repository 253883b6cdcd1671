"""The persistent view of the sales report: equal rows, fresh rows, other sessions."""

import pytest

from devicelens.operators.sql_steps import SqlSteps, create_view
from devicelens.plans import sales as S
from devicelens.plans import sales_view as W
from devicelens.sources.catalog import LOGICAL_TABLES
from pyspark.sql import functions as F
from tests.test_schema import as_text

OPTIONS = dict(min_fiscal_month="199900", as_of="2025-03-03")


@pytest.fixture(scope="module")
def names(driver_t, tmp_path_factory):
    root = tmp_path_factory.mktemp("viewed")
    for table in W.VIEW_TABLES:
        as_text(driver_t[table], table).coalesce(2).write.parquet(f"{root}/{LOGICAL_TABLES[table]}")
    return {table: f"parquet.`{root}/{LOGICAL_TABLES[table]}`" for table in W.VIEW_TABLES}


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("with_uom_cost", [False, True])
def test_view_equals_the_report(spark, driver_t, names, with_uom_cost):
    view = W.publish_report_view(spark, "REPORT_VIEW", names=names, with_uom_cost=with_uom_cost, **OPTIONS)
    want = S.biomed_sales(driver_t, with_uom_cost=with_uom_cost, **OPTIONS)
    assert view.columns == want.columns
    assert [f.dataType for f in view.schema] == [f.dataType for f in want.schema]
    got = rows(spark.newSession().table("REPORT_VIEW"))
    assert got and got == rows(want)
    spark.sql("DROP VIEW REPORT_VIEW")


def test_another_session_reads_fresh_rows(spark, names, driver_t):
    spark.sql("DROP TABLE IF EXISTS VIEWED_FACT")
    stored = spark.table(names["fact_sales"])
    stored.limit(0).write.saveAsTable("VIEWED_FACT")
    try:
        W.publish_report_view(spark, "REPORT_VIEW", names={**names, "fact_sales": "VIEWED_FACT"}, **OPTIONS)
        other = spark.newSession()
        assert other.table("REPORT_VIEW").count() == 0
        stored.write.insertInto("VIEWED_FACT")
        want = S.biomed_sales(driver_t, with_uom_cost=False, **OPTIONS)
        fresh = spark.newSession().table("REPORT_VIEW")
        assert rows(fresh) == rows(want)
        # A session that has read the table before keeps its file list until told.
        other.sql("REFRESH TABLE VIEWED_FACT")
        assert other.table("REPORT_VIEW").count() == len(rows(want))
        # Replaced in place, by the same name.
        W.publish_report_view(spark, "REPORT_VIEW", names={**names, "fact_sales": "VIEWED_FACT"}, with_uom_cost=True, **OPTIONS)
        assert "PRIMARY_UOM_COST" in other.table("REPORT_VIEW").columns
    finally:
        spark.sql("DROP VIEW IF EXISTS REPORT_VIEW")
        spark.sql("DROP TABLE VIEWED_FACT")


def test_steps_quote_texts_and_repeat_rows(spark, tmp_path):
    spark.createDataFrame([("it's \\ x", 1), ("y", 2), (None, None)], "name string, k int").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "id int").write.parquet(str(tmp_path / "b"))
    v = SqlSteps(spark)
    for n in "ab":
        v._add(n, f"SELECT * FROM parquet.`{tmp_path}/{n}`", spark.read.parquet(str(tmp_path / n)))
    v.repeat("both", "a", "k", "b", "id")
    v.select("out", "both", ["k", (F.col("name") == "it's \\ x").alias("hit")])
    got = create_view(spark, "STEPS_VIEW", v.text("out")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, True), (1, True), (2, False), (None, None)], key=repr)
    spark.sql("DROP VIEW STEPS_VIEW")
    with pytest.raises(ValueError, match="already"):
        v.select("out", "both", ["k"])


def test_view_filters_lines_before_the_sum(spark, names):
    """Lines of neither a biomed order nor a flagged account end before the first sum; names are spread last."""
    text = W.biomed_sales_sql(spark, names, **OPTIONS)
    order = [text.index(f"step_{s} AS (") for s in ("reportable", "booked", "summed", "itemised", "sold_to", "dealt", "dated", "report")]
    assert order == sorted(order)
    plan = spark.sql(text)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("HashAggregate(")[0]
    assert "explode(SPECIALISTS" in top and "Join" not in top


def test_a_specialist_without_a_name_keeps_its_row(spark, driver_t, names, tmp_path):
    managers = driver_t["account_managers"]
    unnamed = F.when(F.col("DIM_ACCT_MGR_CURR_ID") % 2 == 0, F.col("ACCT_MGR_NAME"))
    t = driver_t.override(account_managers=managers.withColumn("ACCT_MGR_NAME", unnamed))
    as_text(t["account_managers"], "account_managers").write.parquet(str(tmp_path / "managers"))
    text = W.biomed_sales_sql(spark, {**names, "account_managers": f"parquet.`{tmp_path}/managers`"}, **OPTIONS)
    assert S.biomed_rep(t, as_of=OPTIONS["as_of"]).where("ACCT_MGR_NAME IS NULL").count() > 0
    assert rows(spark.sql(text)) == rows(S.biomed_sales(t, with_uom_cost=False, **OPTIONS))
