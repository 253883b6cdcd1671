"""The sales report as a persistent catalog view.

The view keeps SQL over stored tables, not rows: a session that reads it later
gets the report of the tables as they are then, and ``CREATE OR REPLACE``
changes it in one step of the catalog. (A session that has read a base table
before keeps that table's file list until ``REFRESH TABLE``, as with any
table.) Its SQL follows the report's own shape
(lines summed by their keys, dimensions joined to the sums, summed again,
a row for each specialist last), and rules, labels and measures are the report's Columns
written as SQL (``operators.sql_steps``).

Selected days reach the fact as a semi-join, which a fact partitioned by day
turns into pruning at run time. ``as_of=None`` leaves the current date to the
reading session.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelens.functions import rules as R
from devicelens.functions.dates import rent_start
from devicelens.operators.sql_steps import SqlSteps, create_view
from devicelens.plans import sales as S
from devicelens.sources.catalog import LOGICAL_TABLES

VIEW_TABLES = ("fact_sales", "period", "items", "biomed_sales", "gl_accounts", "trans_types", "account_managers",
               "customers_curr", "customers_blend", "multi_rep", "price_list", "device_index")

# The names of a bill-to customer's specialists, before each gets its row.
SPECIALISTS = "SPECIALISTS"


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def biomed_sales_sql(spark: SparkSession, names: Mapping[str, str] | None = None, *, prefix: str = "",
                     min_fiscal_month: str = "202400", as_of=None, with_uom_cost: bool = False, trim: bool = True) -> str:
    """SQL of the report over the stored tables.

    ``names`` maps a logical table to any relation SQL can name, such as a
    catalog table or ``parquet.`<folder>` ``; by default its reference name
    under ``prefix``. Tables are read by their declared types.
    """
    v = SqlSteps(spark)
    for logical in VIEW_TABLES:
        v.stored(logical, (names or {}).get(logical, prefix + LOGICAL_TABLES[logical]), logical, trim)

    v.select("days", "period", [F.col("DIM_PERIOD_ID").alias("cal_id"), *S.CAL_COLUMNS],
             F.col("FISC_YR_MTH_NUM") >= F.lit(min_fiscal_month))
    _orders(v)
    _specialists(v, as_of)
    _customers(v)
    v.select("day_ids", "days", ["cal_id"])
    v.attach("selected", "fact_sales", "DIM_GL_DT_ID", "day_ids", "cal_id", {}, "LEFT SEMI")
    _reportable(v)
    v.select("fact_lines", "reportable", S.line_inputs())
    v.attach("accounted", "fact_lines", "DIM_SLS_GL_ACCT_ID", "gl_accounts", "DIM_GL_ACCT_ID", {"OBJ_ACCT_CD": "GLS_OBJ_ACCT_CD"})
    v.repeat("costed", "accounted", "DIM_COGS_GL_ACCT_ID", "gl_accounts", "DIM_GL_ACCT_ID")
    v.select("booked", "costed", S.booked_inputs())
    v.aggregate("summed", "booked", S.FACT_KEYS, S.line_sums())
    v.attach("ordered", "summed", "SLS_ID", "orders", "DIM_BIOMED_SLS_ID",
             _same("REF_NUM", "DEVICE_CD", "HAS_ASSET", "REPAIR_TKT_NUM", "TYPE", "RAW_GROUP_LVL_1", "RAW_GROUP_LVL_2",
                   "RENT_FISC_YR_MTH_NUM"))
    v.attach("itemised", "ordered", "DIM_ITEM_E1_CURR_ID", "items", "DIM_ITEM_E1_CURR_ID",
             _same("ITEM_E1_NUM", "ITEM_DSC", "PARNT_SUPLR_NAME", "PRMRY_UOM", "PROD_SUB_CTGRY_LVL4_DSC",
                   S.DIVISOR_KEY, "STNDRD_COST_AMT"), "INNER")
    v.attach("sold_to", "itemised", "DIM_CUST_CURR_ID", "customers", "cus_id",
             _same(*[c for c in v.columns("customers")]))
    v.select("biomed", "sold_to", ["*"], (F.col("BIOMED_FLG") == "Y") | (F.col("BIOMED_ACCT_FLG") == "Y"))
    v.repeat("managed", "biomed", "DIM_ACCT_MGR_CURR_ID", "account_managers", "DIM_ACCT_MGR_CURR_ID")
    v.deal("dealt", "managed", S.DEALT_BY)
    v.attach("dated", "dealt", "DIM_GL_DT_ID", "days", "cal_id", _same(*S.CAL_COLUMNS), "INNER")
    v.repeat("periods", "dated", "DIM_GL_DT_ID", "period", "DIM_PERIOD_ID")
    v.attach("typed_lines", "periods", "DIM_TRANS_TYPE_ID", "trans_types", "DIM_TRANS_TYPE_ID",
             _same("LINE_TYPE_CD", "LINE_TYPE_DSC", "ORDR_TYPE_CD", "ORDR_TYPE_DSC"))
    v.select("labelled", "typed_lines", [*S.attributes(), SPECIALISTS])
    keys = [*S.KEYS, *([S.DIVISOR_KEY] if with_uom_cost else [])]
    v.aggregate("grouped", "labelled", [*keys, "RAW_GROUP_LVL_1", "RAW_GROUP_LVL_2", SPECIALISTS], S.measures(with_uom_cost))
    measures = [c for c in v.columns("grouped") if not c.startswith("RAW_GROUP_LVL_")]
    v.select("transactions", "grouped", S.report_columns(keys, measures), distinct=True)
    v.spread("report", "transactions", SPECIALISTS, "BIOMED_SPECIALIST_NAME")
    return v.text("report")


def _reportable(v: SqlSteps) -> None:
    """Selected lines of biomed orders or of customers with a biomed account row (see ``sales.biomed_facts``)."""
    biomed = F.col("BIOMED_FLG") == "Y"
    v.select("flagged", "customers_blend", ["DIM_CUST_CURR_ID"], F.col("BIOMED_ACCT_FLG") == "Y")
    v.select("biomed_orders", "selected", ["*"], biomed)
    v.select("other_orders", "selected", ["*"], F.col("BIOMED_FLG").isNull() | ~biomed)
    v.attach("biomed_accounts", "other_orders", "DIM_CUST_CURR_ID", "flagged", "DIM_CUST_CURR_ID", {}, "LEFT SEMI")
    v.union("reportable", "biomed_orders", "biomed_accounts")


def _orders(v: SqlSteps) -> None:
    """Order rows with device index and rent calendar, once per price-list entry."""
    v.select("started", "biomed_sales", ["DIM_BIOMED_SLS_ID", "REF_NUM", "DEVICE_CD", S.has_asset(), "REPAIR_TKT_NUM",
                                         rent_start(F.col("BILL_START_END")).alias("RENT_START_DT")])
    v.attach("indexed", "started", "DEVICE_CD", "device_index", "DEVICE_CODE",
             {"TYPE": "TYPE", "DEVICE_GROUP_LVL_1": "RAW_GROUP_LVL_1", "DEVICE_GROUP_LVL_2": "RAW_GROUP_LVL_2"})
    v.attach("rented", "indexed", "RENT_START_DT", "period", "DT", {"FISC_YR_MTH_NUM": "RENT_FISC_YR_MTH_NUM"})
    v.repeat("orders", "rented", "DEVICE_CD", "price_list", "PLY553PLITM", F.col("PLTORG") == "OT")


def _customers(v: SqlSteps) -> None:
    """Customers with division and bill-to name, distinct, and the names of their bill-to's specialists."""
    v.attach("billed", "customers_blend", "DIM_BILL_TO_CUST_CURR_ID", "customers_blend", "DIM_CUST_CURR_ID",
             {"CUST_NAME": "BILL_TO_CUST_NAME"})
    v.select("bill_to_customers", "billed", [
        F.col("DIM_CUST_CURR_ID").alias("cus_id"), "CUST_E1_NUM", "CUST_NAME", "MSTR_GRP_NAME", "BIOMED_ACCT_FLG",
        F.col("BILL_TO_CUST_E1_NUM").alias("BILL_TO_CUST_NUM"),
        R.division(F.col("MMS_SUB_CLASS_CD")).alias("NEW_E1_DIV"), "BILL_TO_CUST_NAME"], distinct=True)
    v.attach("customers", "bill_to_customers", "BILL_TO_CUST_NUM", "named", "BILL_TO_CUST_NUM", _same(SPECIALISTS))


def _specialists(v: SqlSteps, as_of) -> None:
    """Active specialists of bill-to customers, distinct, and their names as one array."""
    v.select("active", "multi_rep", ["CMAN8", "CMSLSM"], F.col("CMSTMEDT") > S._today(as_of))
    v.select("bill_tos", "customers_curr", ["CUST_E1_NUM", "BILL_TO_CUST_NUM"], F.col("BILL_TO_CUST_NUM") == F.col("CUST_E1_NUM"))
    v.select("staff", "account_managers", ["ACCT_MGR_TERR_E1_NUM", "ACCT_MGR_EMPLY_ID", "ACCT_MGR_NAME"],
             F.col("ACCT_MGR_TYPE_CD").isin(list(R.SPECIALIST_TYPES)))
    v.attach("served", "active", "CMAN8", "bill_tos", "CUST_E1_NUM", _same("BILL_TO_CUST_NUM"), "INNER")
    v.attach("serving", "served", "CMSLSM", "staff", "ACCT_MGR_TERR_E1_NUM", _same("ACCT_MGR_EMPLY_ID", "ACCT_MGR_NAME"), "INNER")
    v.select("specialists", "serving", ["BILL_TO_CUST_NUM", "ACCT_MGR_EMPLY_ID", "ACCT_MGR_NAME"], distinct=True)
    names = F.sort_array(F.collect_list(F.struct("ACCT_MGR_NAME"))).getField("ACCT_MGR_NAME")  # a NULL name stays
    v.aggregate("named", "specialists", ["BILL_TO_CUST_NUM"], [names.alias(SPECIALISTS)])


def publish_report_view(spark: SparkSession, name: str = "BIOMED_SALES_QUERY", **options) -> DataFrame:
    """Create or replace the report's view (options of :func:`biomed_sales_sql`)."""
    return create_view(spark, name, biomed_sales_sql(spark, **options))
