"""Biomed sales transactions report.

Shape of :func:`biomed_sales`, in join order:

* fact lines limited to the selected fiscal months by the implied range of
  period ids (a literal range the fact's scan can use), and to lines that can
  be reported at all in two disjoint branches: flagged orders (a filter the
  scan can use) and other orders of flagged accounts (``biomed_facts``);
* GL accounts joined to the single lines: they only choose a line's cost and
  repeat it, so their keys and the costs by other accounts end here;
* those lines summed by their other keys while narrow (``sales_groups``): every
  further dimension hangs off these keys alone, so a group joins exactly what
  each of its lines would, and a repeated dimension key repeats its sums;
* the groups, then joined to:
* the order-level biomed dimension, enriched *before* it meets the fact:
  device index and rent calendar hang off its device code and billing text,
  and those join predicates reject NULL, so ``fact LEFT JOIN bmd LEFT JOIN x``
  equals ``fact LEFT JOIN (bmd LEFT JOIN x)``;
* items, then the wider customers; each is broadcast or shuffled by its size. At
  scale the groups are shuffled by order, item and customer, the lines themselves
  once;
* dimensions the report joins only for their row effect (price list, second
  GL account, manager, second period) cost a join with their repeated keys
  alone, which are normally none (``operators.joins.repeat_rows``);
* one exchange by a few report keys that no single value fills; behind it the
  bounded calendar, every label and class, the raw-group GROUP BY and the
  DISTINCT over it, all inside that partitioning;
* the specialist names last: nothing stands above that join, so a bill-to
  customer with very many report rows can be split. Columns that follow from
  others of the row are added behind it.

Money stays DECIMAL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelens.functions import rules as R
from devicelens.functions.dates import date_lit, rent_start
from devicelens.operators.audit import key_multiplicities
from devicelens.operators.joins import repeat_rows
from devicelens.operators.materialize import checkpointed
from devicelens.sources.catalog import Tables

CAL_COLUMNS = ("FISC_YR_NUM", "FISC_MTH_NUM", "FISC_YR_MTH_NUM", "CAL_YR_NUM", "CAL_MTH_NUM",
               "CAL_YR_MTH_NUM", "CAL_WK_NUM", "FISC_WK_NUM")

# Output keys in report order; the two device groups are labels computed
# from the raw columns (see ``merge_other``).
KEYS = ("BIOMED_FLG", "ORDR_NUM", "OTORDERNUM", "DEVICE_CD", "PARNT_SUPLR_NAME", "ITEM_E1_NUM",
        "ITEM_DSC", "TYPE", "PRMRY_UOM", "BIOMED_ACCT_FLG", "DIM_ACCT_MGR_CURR_ID",
        "BILL_TO_CUST_NUM", "MSTR_GRP_NAME", "DIM_CUST_CURR_ID", "BILL_TO_CUST_NAME", "INV_NUM",
        "REPAIR_TKT_NUM", "REF_NUM", "CUST_NAME", "NEW_E1_DIV", *CAL_COLUMNS,
        "ADJ_FISC_YR_MTH_NUM", "PPPM_OR_FLEET_FLAG", "DEVICE_GROUP_LVL_1", "DEVICE_GROUP_LVL_2",
        "PROD_SUB_CTGRY_LVL4_DSC", "SALES_TYPE", "CONSOL_SALES_TYPE", "LINE_TYPE_CD",
        "LINE_TYPE_DSC", "ORDR_TYPE_CD", "ORDR_TYPE_DSC")
DIVISOR_KEY = "PRMRY_TO_SELL_DIVISOR"

def _today(as_of) -> Column:
    return date_lit(as_of) if as_of is not None else F.current_date()


def biomed_rep(t: Tables, *, as_of=None) -> DataFrame:
    """Active biomed specialists (EBO/PBO) of bill-to customers: distinct
    (BILL_TO_CUST_NUM, ACCT_MGR_EMPLY_ID, ACCT_MGR_NAME)."""
    m = (t["multi_rep"].where(F.col("CMSTMEDT") > _today(as_of))
         .select("CMAN8", "CMSLSM"))
    c = (t["customers_curr"].where(F.col("BILL_TO_CUST_NUM") == F.col("CUST_E1_NUM"))
         .select("CUST_E1_NUM", "BILL_TO_CUST_NUM"))
    a = (t["account_managers"].where(F.col("ACCT_MGR_TYPE_CD").isin(list(R.SPECIALIST_TYPES)))
         .select("ACCT_MGR_TERR_E1_NUM", "ACCT_MGR_EMPLY_ID", "ACCT_MGR_NAME"))
    return (m.join(c, c.CUST_E1_NUM == m.CMAN8, "inner")
            .join(a, m.CMSLSM == a.ACCT_MGR_TERR_E1_NUM, "inner")
            .select("BILL_TO_CUST_NUM", "ACCT_MGR_EMPLY_ID", "ACCT_MGR_NAME").distinct())


def names_array() -> Column:
    """The names of a group of specialists, a NULL name included, in one order."""
    return F.sort_array(F.collect_list(F.struct("ACCT_MGR_NAME"))).getField("ACCT_MGR_NAME").alias(SPECIALISTS)


def customer_bill_to(t: Tables) -> DataFrame:
    """Customers with division and bill-to name (self-join on the blend
    dimension), distinct."""
    cb = t["customers_blend"]
    bill = cb.select(F.col("DIM_CUST_CURR_ID").alias("bt_id"),
                     F.col("CUST_NAME").alias("BILL_TO_CUST_NAME"))
    return (cb.join(bill, cb.DIM_BILL_TO_CUST_CURR_ID == bill.bt_id, "left")
            .select("DIM_CUST_CURR_ID", "CUST_E1_NUM", "CUST_NAME", "MSTR_GRP_NAME",
                    "BIOMED_ACCT_FLG", F.col("BILL_TO_CUST_E1_NUM").alias("BILL_TO_CUST_NUM"),
                    R.division(F.col("MMS_SUB_CLASS_CD")).alias("NEW_E1_DIV"),
                    "BILL_TO_CUST_NAME")
            .distinct())


def biomed_dimension(t: Tables) -> DataFrame:
    """Order-level biomed rows with device index, price-list matches and the
    rent-start fiscal month attached (all keyed off the order row). A billing
    text without a readable date has a NULL date; ``unreadable_rent_starts``
    lists those."""
    bmd = t["biomed_sales"]
    di = t["device_index"].select(F.col("DEVICE_CODE").alias("di_code"), "TYPE",
                                  F.col("DEVICE_GROUP_LVL_1").alias("RAW_GROUP_LVL_1"),
                                  F.col("DEVICE_GROUP_LVL_2").alias("RAW_GROUP_LVL_2"))
    rentcal = t["period"].select(F.col("DT").alias("rent_dt"),
                                 F.col("FISC_YR_MTH_NUM").alias("RENT_FISC_YR_MTH_NUM"))
    b = bmd.withColumn("RENT_START_DT", rent_start(F.col("BILL_START_END")))
    joined = (b.join(di, b.DEVICE_CD == di.di_code, "left")
              .join(rentcal, b.RENT_START_DT == rentcal.rent_dt, "left")
              .drop("di_code", "rent_dt"))
    # A price-list item listed several times for the org multiplies its lines.
    return repeat_rows(joined, "DEVICE_CD", t["price_list"].where(F.col("PLTORG") == "OT"), "PLY553PLITM")


def period_id_range(t: Tables, min_fiscal_month: str):
    """(min, max) period id of the fiscal months selected, from the bounded
    calendar (one small aggregate), or None when none is selected."""
    lo, hi = (t["period"].where(F.col("FISC_YR_MTH_NUM") >= F.lit(min_fiscal_month))
              .agg(F.min("DIM_PERIOD_ID"), F.max("DIM_PERIOD_ID")).first())
    return None if lo is None else (lo, hi)


# What a fact line is joined and labelled by behind the sum: its own keys, no measure.
FACT_KEYS = ("SLS_ID", "ORDR_NUM", "INV_NUM", "BIOMED_FLG", "DIM_CUST_CURR_ID", "DIM_GL_DT_ID",
             "DIM_ITEM_E1_CURR_ID", "DIM_ACCT_MGR_CURR_ID", "DIM_TRANS_TYPE_ID")
# Its GL accounts, which are joined before the sum.
ACCOUNT_KEYS = ("DIM_SLS_GL_ACCT_ID", "DIM_COGS_GL_ACCT_ID")
# Accounts whose lines have a cost; which one a line has is known after the account join.
COST_ACCOUNTS = (R.SELL_GL_ACCOUNT, R.COGS_GL_ACCOUNT)
# Measure inputs of a line, or their sums over a group of lines.
NET = "EXT_NET_SLS_AMT"
PARTS = (NET, "GL_COST", "GL_MARGIN")


def biomed_facts(t: Tables, facts: DataFrame) -> DataFrame:
    """The fact lines of biomed orders or of customers with a biomed account row.

    Two disjoint branches instead of one predicate over both join sides: the
    order flag is a filter on the fact alone, and the other lines (a NULL flag
    included) are semi-joined with the flagged customers, which Spark
    broadcasts or prunes by a Bloom filter as their size allows.
    """
    biomed = F.col("BIOMED_FLG") == "Y"
    flagged = (t["customers_blend"].where(F.col("BIOMED_ACCT_FLG") == "Y")
               .select(F.col("DIM_CUST_CURR_ID").alias("flagged_id")))
    others = facts.where(F.col("BIOMED_FLG").isNull() | ~biomed)
    return facts.where(biomed).unionByName(
        others.join(flagged, others.DIM_CUST_CURR_ID == flagged.flagged_id, "left_semi"))


def line_inputs() -> list[Column]:
    """Keys, ``LINES`` = 1, net, and cost and margin by either cost account of a fact line."""
    net = F.col(NET)
    costs = {a: R.gl_cost(F.lit(a), net, F.col("EXT_SELL_GP_FIN_AMT"), F.col("EXT_COGS_ACQ_AMT"))
             for a in COST_ACCOUNTS}
    return [*[F.col(c) for c in (*FACT_KEYS, *ACCOUNT_KEYS)], F.lit(1).cast("long").alias("LINES"), net,
            *[c for a, cost in costs.items()
              for c in (cost.alias(f"COST_{a}"), (net - cost).alias(f"MARGIN_{a}"))]]


def booked_inputs() -> list[Column]:
    """Keys and measure inputs of a fact line by its own account, ``GLS_OBJ_ACCT_CD``."""
    def by_account(part: str, without: Column) -> Column:
        # A line without a cost account costs 0, so its margin is its net.
        account, first, second = F.col("GLS_OBJ_ACCT_CD"), *COST_ACCOUNTS
        return (F.when(account == F.lit(first), F.col(f"{part}_{first}"))
                .when(account == F.lit(second), F.col(f"{part}_{second}")).otherwise(without))

    return [*[F.col(c) for c in (*FACT_KEYS, "LINES", NET)], by_account("COST", F.lit(0)).alias("GL_COST"),
            by_account("MARGIN", F.col(NET)).alias("GL_MARGIN")]


def booked(t: Tables, lines: DataFrame) -> DataFrame:
    """Fact lines with the cost and margin of their sales account, repeated as both accounts are."""
    gls = t["gl_accounts"].select(F.col("DIM_GL_ACCT_ID").alias("gls_id"),
                                  F.col("OBJ_ACCT_CD").alias("GLS_OBJ_ACCT_CD"))
    j = lines.join(gls, lines.DIM_SLS_GL_ACCT_ID == gls.gls_id, "left")
    j = repeat_rows(j, "DIM_COGS_GL_ACCT_ID", t["gl_accounts"], "DIM_GL_ACCT_ID")
    return j.select(*booked_inputs())


def line_sums() -> list[Column]:
    """``LINES`` and the measure inputs summed over a group of lines."""
    return [F.sum(c).alias(c) for c in ("LINES", *PARTS)]


def _fact_lines(t: Tables, min_fiscal_month: str, derive_date_range: bool, split: bool = True) -> DataFrame:
    """Fact lines that the report can hold, once per match of their GL accounts: keys, ``LINES`` = 1 and measure inputs."""
    s = t["fact_sales"]
    if derive_date_range:
        rng = period_id_range(t, min_fiscal_month)
        s = (s.where(F.col("DIM_GL_DT_ID").between(F.lit(rng[0]), F.lit(rng[1])))
             if rng else s.where(F.lit(False)))
    else:
        days = (t["period"].where(F.col("FISC_YR_MTH_NUM") >= F.lit(min_fiscal_month))
                .select(F.col("DIM_PERIOD_ID").alias("selected_day")))
        s = s.join(days, s.DIM_GL_DT_ID == days.selected_day, "left_semi")
    return booked(t, (biomed_facts(t, s) if split else s).select(*line_inputs()))


def sales_lines(t: Tables, *, min_fiscal_month: str = "202400", derive_date_range: bool = True,
                stored: bool = False, dealt: bool = False) -> DataFrame:
    """Fact lines since ``min_fiscal_month`` of biomed orders or biomed
    accounts, with every attribute and classification the report groups by
    (raw device groups kept as RAW_GROUP_LVL_1/2) and the per-line measure
    inputs (``LINES`` is 1).

    ``derive_date_range`` adds ``min_id <= DIM_GL_DT_ID <= max_id`` over the
    selected calendar rows to the fact. It is implied by the calendar join
    (no other fact row can match), and as a literal range it reaches the
    fact's scan, where row groups or partitions outside it are skipped. It
    costs a small job on the calendar while the plan is built. Without it the
    fact is semi-joined with those rows, which a fact stored by
    :func:`store_sales` turns into dynamic partition pruning at run time. The
    other options are those of :func:`sales_groups`.
    """
    lines = _fact_lines(t, min_fiscal_month, derive_date_range and not stored, split=not stored)
    return _attributes(t, lines, min_fiscal_month, dealt)


def sales_groups(t: Tables, *, min_fiscal_month: str = "202400", stored: bool = False,
                 dealt: bool = False) -> DataFrame:
    """:func:`sales_lines` with lines of equal fact keys summed before any dimension join.

    ``LINES`` counts a group's lines and the measure inputs are sums over them;
    a sum skips NULL inputs as the report's own sums do, and is NULL only if
    all are. Sums are of DECIMAL values, so any grouping gives the same result.
    ``stored`` says that the fact comes from :func:`store_sales`: days are then
    pruned at run time, and the lines stay in one branch, whose buckets make
    the sum and the order join free of exchanges (a union would lose them).
    ``dealt`` partitions the groups by ``DEALT_BY``.
    """
    lines = _fact_lines(t, min_fiscal_month, not stored, split=not stored)
    groups = lines.groupBy(*FACT_KEYS).agg(*line_sums())
    return _attributes(t, groups, min_fiscal_month, dealt)


def has_asset() -> Column:
    """Whether an order row has an asset: all that the report asks of its id."""
    return F.col("ASSET_ID").isNotNull().alias("HAS_ASSET")


def _attributes(t: Tables, s: DataFrame, min_fiscal_month: str, dealt: bool) -> DataFrame:
    """Join every further dimension to fact lines, or to groups of them."""
    bmd = biomed_dimension(t).select(
        F.col("DIM_BIOMED_SLS_ID"), "REF_NUM", "DEVICE_CD", has_asset(), "REPAIR_TKT_NUM", "TYPE",
        "RAW_GROUP_LVL_1", "RAW_GROUP_LVL_2", "RENT_FISC_YR_MTH_NUM")
    j = s.join(bmd, s.SLS_ID == bmd.DIM_BIOMED_SLS_ID, "left")
    i = t["items"].select(F.col("DIM_ITEM_E1_CURR_ID").alias("i_id"), "ITEM_E1_NUM", "ITEM_DSC",
                          "PARNT_SUPLR_NAME", "PRMRY_UOM", "PROD_SUB_CTGRY_LVL4_DSC",
                          "PRMRY_TO_SELL_DIVISOR", "STNDRD_COST_AMT")
    j = j.join(i, j.DIM_ITEM_E1_CURR_ID == i.i_id, "inner")
    # Customers after the items: their columns are the widest, and at scale
    # each of these joins shuffles what was joined before.
    cus = customer_bill_to(t).withColumnRenamed("DIM_CUST_CURR_ID", "cus_id")
    j = (j.join(cus, j.DIM_CUST_CURR_ID == cus.cus_id, "left")
         .where((F.col("BIOMED_FLG") == "Y") | (F.col("BIOMED_ACCT_FLG") == "Y")))
    j = repeat_rows(j, "DIM_ACCT_MGR_CURR_ID", t["account_managers"], "DIM_ACCT_MGR_CURR_ID")
    tt = t["trans_types"].select(F.col("DIM_TRANS_TYPE_ID").alias("tt_id"), "LINE_TYPE_CD",
                                 "LINE_TYPE_DSC", "ORDR_TYPE_CD", "ORDR_TYPE_DSC")
    j = j.join(tt, j.DIM_TRANS_TYPE_ID == tt.tt_id, "left")
    # The source joins the period twice: a repeated id multiplies rows again.
    j = repeat_rows(j, "DIM_GL_DT_ID", t["period"], "DIM_PERIOD_ID")
    if dealt:
        j = j.repartition(*DEALT_BY)
    # The calendar has a row per day whatever the data's size: broadcast, it keeps the
    # dealt rows where they are, and its columns and all labels stand behind that exchange.
    cal = (t["period"].where(F.col("FISC_YR_MTH_NUM") >= F.lit(min_fiscal_month))
           .select(F.col("DIM_PERIOD_ID").alias("cal_id"), *CAL_COLUMNS))
    j = j.join(F.broadcast(cal), j.DIM_GL_DT_ID == cal.cal_id, "inner")
    return j.select(*attributes())


def attributes() -> list[Column | str]:
    """What the report groups by and sums, over lines or groups of them with every dimension joined."""
    item, sub = F.col("ITEM_E1_NUM"), F.col("PROD_SUB_CTGRY_LVL4_DSC")
    line, cust = F.col("LINE_TYPE_CD"), F.col("CUST_E1_NUM")
    return [
        "BIOMED_FLG", "ORDR_NUM", F.col("REF_NUM").alias("OTORDERNUM"), "DEVICE_CD",
        "PARNT_SUPLR_NAME", "ITEM_E1_NUM", "ITEM_DSC", "TYPE", "PRMRY_UOM", "BIOMED_ACCT_FLG",
        "DIM_ACCT_MGR_CURR_ID", "BILL_TO_CUST_NUM", "MSTR_GRP_NAME",
        F.col("cus_id").alias("DIM_CUST_CURR_ID"), "BILL_TO_CUST_NAME", "INV_NUM",
        "REPAIR_TKT_NUM", "REF_NUM", "CUST_NAME", "NEW_E1_DIV", *CAL_COLUMNS,
        F.coalesce(F.col("RENT_FISC_YR_MTH_NUM"), F.col("FISC_YR_MTH_NUM"))
        .alias("ADJ_FISC_YR_MTH_NUM"),
        R.pppm_flag(F.col("BILL_TO_CUST_NUM"), item).alias("PPPM_OR_FLEET_FLAG"),
        "RAW_GROUP_LVL_1", "RAW_GROUP_LVL_2",
        R.null_as_other(F.col("RAW_GROUP_LVL_1")).alias("DEVICE_GROUP_LVL_1"),
        R.null_as_other(F.col("RAW_GROUP_LVL_2")).alias("DEVICE_GROUP_LVL_2"),
        "PROD_SUB_CTGRY_LVL4_DSC",
        R.sales_type(item, cust, line, sub).alias("SALES_TYPE"),
        R.consolidated_sales_type(item, cust, line, sub).alias("CONSOL_SALES_TYPE"),
        "LINE_TYPE_CD", "LINE_TYPE_DSC", "ORDR_TYPE_CD", "ORDR_TYPE_DSC", DIVISOR_KEY,
        "HAS_ASSET", "STNDRD_COST_AMT", "LINES", *PARTS,
    ]


UOM_SCALE = 6


def uom_cost_sum(lines: Column | None = None) -> Column:
    """Sum of cost per primary unit, rounded once after the sum (zero divisor: 0; NULL: skipped).

    ``lines`` is the number of lines a row stands for. A quotient has too many
    digits to be multiplied in DECIMAL(38), so its whole and broken parts are
    multiplied and summed apart; nothing is rounded before the end.
    """
    divisor = F.col(DIVISOR_KEY)
    quotient = F.when(divisor == 0, F.lit(0)).otherwise(F.col("STNDRD_COST_AMT") / divisor)
    if lines is None:
        return F.round(F.sum(quotient), UOM_SCALE)
    n = lines.cast("decimal(17,0)")
    whole = F.when(quotient < 0, F.ceil(quotient)).otherwise(F.floor(quotient)).cast("decimal(20,0)")
    broken = (quotient - whole).cast("decimal(20,20)")
    exact = F.sum(whole * n).cast("decimal(18,0)") + F.sum(broken * n).cast("decimal(38,20)")
    return F.round(exact, UOM_SCALE).cast("decimal(25,6)")


def measures(with_uom_cost: bool) -> list[Column]:
    """The report's measures over :func:`sales_lines` or :func:`sales_groups`, in order."""
    item, net, cost, margin = (F.col(c) for c in ("ITEM_E1_NUM", NET, "GL_COST", "GL_MARGIN"))
    zero, lines = F.lit(0), F.col("LINES")
    oem = F.when(item == F.lit(R.OEM_FEE_ITEM), net).otherwise(zero)
    non_oem = F.when(item != F.lit(R.OEM_FEE_ITEM), net).otherwise(zero)
    service = F.when(item.isin(list(R.SERVICE_FEE_ITEMS)), net).otherwise(zero)
    # Net outside OEM fees less cost, line by line.
    less_cost = F.when(item != F.lit(R.OEM_FEE_ITEM), margin).otherwise(-cost)
    named = [
        ("TTL_DEVICE_QTY", F.sum(F.when(F.col("HAS_ASSET"), lines).otherwise(zero))),
        *([("PRIMARY_UOM_COST", uom_cost_sum(lines))] if with_uom_cost else []),
        ("STNDRD_COST_AMT", F.sum(F.col("STNDRD_COST_AMT") * lines.cast("decimal(18,0)"))),
        ("OEM_FEES", F.sum(oem)),
        ("SERVICE_FEES", F.sum(service)),
        ("GL_SELL_GP", F.sum(margin)),
        ("GL_COGS", F.sum(cost)),
        ("SLS_OEM_FEES", F.sum(oem)),
        ("SLS_EXCL_OEM_FEES", F.sum(non_oem)),
        ("GL_SELL_GP_EXCL_OEM_FEES", F.sum(less_cost)),
        ("NET_SLS", F.sum(net)),
    ]
    return [value.cast(MEASURE_TYPES.get(name, "decimal(28,4)")).alias(name) for name, value in named]


# Types of the measures that are no sum of DECIMAL(18,4) inputs.
MEASURE_TYPES = {"TTL_DEVICE_QTY": "long", "PRIMARY_UOM_COST": "decimal(25,6)", "GL_COGS": "decimal(29,4)",
                 "GL_SELL_GP": "decimal(30,4)", "GL_SELL_GP_EXCL_OEM_FEES": "decimal(30,4)"}

# Report keys the rows are dealt by: part of every grouping below, and no
# single combination of their values holds many lines.
DEALT_BY = ("ORDR_NUM", "INV_NUM", "ITEM_E1_NUM", "DEVICE_CD")


def transactions(t: Tables, *, min_fiscal_month: str = "202400", with_uom_cost: bool = True,
                 merge_other: bool = False, stored: bool = False) -> DataFrame:
    """Aggregated, de-duplicated transactions.

    Device groups are grouped by their *raw* values and labelled afterwards,
    so a NULL group and a literal ``Other`` group are separate report rows
    that print alike, and the DISTINCT merges such rows only when every
    measure is equal. ``merge_other=True`` groups by the label (sums them).

    The groups of lines are dealt once by ``DEALT_BY``; GROUP BY and DISTINCT both
    contain those keys, so neither needs an exchange of its own.
    """
    groups = sales_groups(t, min_fiscal_month=min_fiscal_month, stored=stored, dealt=True)
    keys = [*KEYS, *([DIVISOR_KEY] if with_uom_cost else [])]
    raw = [] if merge_other else ["RAW_GROUP_LVL_1", "RAW_GROUP_LVL_2"]
    grouped = groups.groupBy(*keys, *raw).agg(*measures(with_uom_cost)).drop(*raw)
    return grouped.select(*report_columns(keys, grouped.columns)).distinct()


def report_columns(keys: list[str], columns: list[str]) -> list[Column | str]:
    """The report's columns in order, from its keys and the columns of the grouped rows."""
    return [*keys[:13], R.group_name_trim(F.col("MSTR_GRP_NAME")).alias("MSTR_GRP_NAME_TRIM"), *keys[13:],
            *[c for c in columns if c not in keys]]


def biomed_sales(t: Tables, *, min_fiscal_month: str = "202400", as_of=None,
                 with_uom_cost: bool = True, merge_other: bool = False,
                 stored: bool = False) -> DataFrame:
    """The biomed sales transactions report with the specialist name.

    ``with_uom_cost=False`` gives the published-view variant (no divisor key,
    no UOM cost). A bill-to customer with several specialists repeats its
    rows, once per specialist.
    """
    rows = transactions(t, min_fiscal_month=min_fiscal_month, with_uom_cost=with_uom_cost,
                        merge_other=merge_other, stored=stored)
    names = biomed_rep(t, as_of=as_of).select(F.col("BILL_TO_CUST_NUM").alias("sp_bill_to"),
                                              F.col("ACCT_MGR_NAME").alias("BIOMED_SPECIALIST_NAME"))
    # At scale the join shuffles the report's rows: without what follows from the rest of a row.
    follows = {"OTORDERNUM": F.col("REF_NUM"), "MSTR_GRP_NAME_TRIM": R.group_name_trim(F.col("MSTR_GRP_NAME")),
               "PPPM_OR_FLEET_FLAG": R.pppm_flag(F.col("BILL_TO_CUST_NUM"), F.col("ITEM_E1_NUM")),
               "SLS_OEM_FEES": F.col("OEM_FEES")}
    named = rows.drop(*follows).join(names, F.col("BILL_TO_CUST_NUM") == names.sp_bill_to, "left")
    return named.select(*[follows[c].alias(c) if c in follows else c for c in rows.columns], "BIOMED_SPECIALIST_NAME")


def store_sales(t: Tables, prefix: str = "", *, buckets: int = 64) -> Tables:
    """Store the fact and the order dimension for the report, and read them from there.

    The fact is partitioned by its day id and both are bucketed by the order
    id: with ``stored=True`` the report reads the selected days only, without a
    job to find them, and sums lines and joins orders without an exchange. Rows
    are dealt by day and bucket before they are written, so a bucket of a day
    is one file; ``buckets`` should keep a bucket of the whole selection within
    an executor's memory. Lines of one order stay together, so don't bucket a
    fact where a single order id (such as one for "unknown") holds much of it.
    The tables are replaced. Dimensions stay where they are.
    """
    names = {"fact_sales": ("SLS_ID", "DIM_GL_DT_ID"), "biomed_sales": ("DIM_BIOMED_SLS_ID", None)}
    stored = {}
    for logical, (order, day) in names.items():
        df = t[logical]
        # Spark's bucket of a row, so that a bucket is written by few tasks.
        bucket = F.pmod(F.hash(order), F.lit(buckets))
        rows = df.repartition(*([day] if day else []), bucket)
        out = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, order).sortBy(order)
        (out.partitionBy(day) if day else out).saveAsTable(prefix + logical)
        stored[logical] = t.spark.table(prefix + logical)
    return t.override(**stored)


def publish_table(df: DataFrame, name: str = "BIOMED_SALES_QUERY") -> DataFrame:
    """Publish a report as a catalog table that other sessions can read; an existing one is replaced.

    The rows are a snapshot; ``sales_view.publish_report_view`` keeps the SQL instead.
    """
    df.write.mode("overwrite").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def publish_view(df: DataFrame, name: str = "BIOMED_SALES_QUERY", global_view: bool = False):
    """Publish a report as a (global) temporary view."""
    if global_view:
        df.createOrReplaceGlobalTempView(name)
    else:
        df.createOrReplaceTempView(name)
    return df


# ---------------------------------------------------------------------------
# Smaller reports over the same lines
# ---------------------------------------------------------------------------

# Keys of the line-level reports.
REPORT_SETS = {"sales_type_mix": ("SALES_TYPE", "CONSOL_SALES_TYPE"), "gl_measures": ("FISC_YR_MTH_NUM",),
               "uom_cost": ("PRMRY_UOM", DIVISOR_KEY)}


def _line_count() -> Column:
    return F.sum("LINES").alias("LINE_COUNT")


def sales_type_mix(t: Tables, *, min_fiscal_month: str = "202400",
                   lines: DataFrame | None = None) -> DataFrame:
    """Line count and net sales per sales type and consolidated type."""
    lines = lines if lines is not None else sales_groups(t, min_fiscal_month=min_fiscal_month)
    return (lines.groupBy(*REPORT_SETS["sales_type_mix"])
            .agg(_line_count(), F.sum(NET).cast("decimal(28,4)").alias("NET_SLS")))


def gl_measures(t: Tables, *, min_fiscal_month: str = "202400",
                lines: DataFrame | None = None) -> DataFrame:
    """Fee and GL measures per fiscal month."""
    lines = lines if lines is not None else sales_groups(t, min_fiscal_month=min_fiscal_month)
    return lines.groupBy(*REPORT_SETS["gl_measures"]).agg(*measures(False))


def uom_cost(t: Tables, *, min_fiscal_month: str = "202400",
             lines: DataFrame | None = None) -> DataFrame:
    """Primary-UOM cost per unit of measure and divisor."""
    lines = lines if lines is not None else sales_groups(t, min_fiscal_month=min_fiscal_month)
    return (lines.groupBy(*REPORT_SETS["uom_cost"])
            .agg(uom_cost_sum(F.col("LINES")).alias("PRIMARY_UOM_COST"), _line_count()))


def report_sets(t: Tables, *, min_fiscal_month: str = "202400",
                lines: DataFrame | None = None) -> DataFrame:
    """All line-level reports from one run of the joins, as grouping sets.

    ``REPORT`` names the set a row belongs to; keys of the other sets are NULL
    (a NULL key of the own set too, so tell sets apart by ``REPORT``). Every
    set has all measures. Partial sums stand before the only shuffle, so the
    rows that meet there are few, however many lines there are.
    """
    lines = lines if lines is not None else sales_groups(t, min_fiscal_month=min_fiscal_month)
    keys = [k for of in REPORT_SETS.values() for k in of]
    # The grouping id has a bit for each key, the first key's highest; 1 where the set lacks it.
    ids = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in of): name
           for name, of in REPORT_SETS.items()}
    named = F.coalesce(*[F.when(F.col("__set") == i, F.lit(name)) for i, name in ids.items()])
    rows = (lines.groupingSets([[F.col(k) for k in of] for of in REPORT_SETS.values()], *keys)
            .agg(F.grouping_id().alias("__set"), _line_count(), *measures(True)))
    return rows.select(named.alias("REPORT"), *[c for c in rows.columns if c != "__set"])


def unreadable_rent_starts(t: Tables) -> DataFrame:
    """Order rows per shape of billing text that holds a text but no readable start date.

    The original raises on these; the report keeps the GL month for them.
    """
    shape = F.regexp_replace("BILL_START_END", "[0-9]", "9").alias("BILL_SHAPE")
    return (t["biomed_sales"].where(F.col("BILL_START_END").isNotNull() & (F.col("BILL_START_END") != "*")
                                    & rent_start(F.col("BILL_START_END")).isNull())
            .groupBy(shape).agg(F.count(F.lit(1)).alias("ROW_COUNT")))


def check_rent_starts(t: Tables) -> None:
    """Strict mode: raise, as the original does, if any billing text is unreadable."""
    first = unreadable_rent_starts(t).orderBy(F.desc("ROW_COUNT"), "BILL_SHAPE").first()
    if first is not None:
        raise ValueError(f"billing texts like {first['BILL_SHAPE']!r} hold no readable date ({first['ROW_COUNT']} rows)")


def rent_adjusted_month(t: Tables) -> DataFrame:
    """Rent-start date and its fiscal month for every biomed order row."""
    return biomed_dimension(t).select("DIM_BIOMED_SLS_ID", "BILL_START_END", "RENT_START_DT",
                                      "RENT_FISC_YR_MTH_NUM")


def group_name_trim(t: Tables) -> DataFrame:
    """Master group name with the BIO prefixes removed, per customer."""
    return t["customers_blend"].select(
        "DIM_CUST_CURR_ID", "MSTR_GRP_NAME",
        R.group_name_trim(F.col("MSTR_GRP_NAME")).alias("MSTR_GRP_NAME_TRIM"))


def other_group_semantics(t: Tables, *, min_fiscal_month: str = "202400",
                          merge_other: bool = False) -> DataFrame:
    """Report rows and net sales per printed device-group pair, showing the
    effect of grouping by raw values (NULL and ``Other`` separately)."""
    tx = transactions(t, min_fiscal_month=min_fiscal_month, with_uom_cost=False,
                      merge_other=merge_other)
    return (tx.groupBy("DEVICE_GROUP_LVL_1", "DEVICE_GROUP_LVL_2")
            .agg(F.count(F.lit(1)).alias("ROW_COUNT"), F.sum("NET_SLS").alias("NET_SLS")))


def join_key_audit(t: Tables, *, as_of=None) -> DataFrame:
    """Repeated join keys of the dimensions the jobs join to (each repeat
    multiplies rows)."""
    return key_multiplicities([
        (t["biomed_sales"], {"DIM_BIOMED_SLS_ID": "V_DIM_BIOMED_SLS"}),
        (t["price_list"].where(F.col("PLTORG") == "OT"), {"PLY553PLITM": "SRC_E1_MMS_F55413PL"}),
        (t["device_index"], {"DEVICE_CODE": "MR_DEVICE_INDEX"}),
        (t["period"], {"DT": "V_DIM_PERIOD", "DIM_PERIOD_ID": "V_DIM_PERIOD id"}),
        (t["gl_accounts"], {"DIM_GL_ACCT_ID": "V_DIM_GL_ACCT"}),
        (t["trans_types"], {"DIM_TRANS_TYPE_ID": "V_DIM_TRANS_TYPE"}),
        (biomed_rep(t, as_of=as_of), {"BILL_TO_CUST_NUM": "specialists"}),
        (t["devices"], {"BarCodeNumber": "qryDevices barcode", "DeviceUID": "qryDevices uid"}),
        (t["clients"], {"ID": "Clients id", "PK_ClientId": "Clients key"}),
        (t["associates"], {"UserId": "Associates"}),
        (t["event_codes"], {"Code": "EventCodes"}),
        (t["account_managers"], {"DIM_ACCT_MGR_CURR_ID": "V_DIM_ACCT_MGR_CURR"}),
        (t["customers_blend"], {"DIM_CUST_CURR_ID": "V_DIM_CUST_E1_BLEND_CURR"}),
        (t["items"], {"DIM_ITEM_E1_CURR_ID": "V_DIM_ITEM_E1_CURR"}),
        (t["oem_info"], {"EquipmentTypeId": "EquipmentTypeOEMInfo"}),
        (t["import_history"], {"FK_DeviceId": "E1ImportHistory"}),
    ])


def sales_reports(t: Tables, *, min_fiscal_month: str = "202400",
                  materialize: bool = True) -> dict[str, DataFrame]:
    """The line-level reports computed in one pass (:func:`report_sets`).

    With ``materialize`` the few rows of all reports are checkpointed in the
    shared checkpoint folder, so that reading the second report runs nothing
    again and a lost executor takes no lineage with it.
    """
    rows = report_sets(t, min_fiscal_month=min_fiscal_month)
    if materialize:
        rows = checkpointed(rows)
    of = lambda name, *columns: (rows.where(F.col("REPORT") == name)
                                 .select(*REPORT_SETS[name], *columns))
    month = [c for c in rows.columns[rows.columns.index("TTL_DEVICE_QTY"):] if c != "PRIMARY_UOM_COST"]
    return {
        "sales_type_mix": of("sales_type_mix", "LINE_COUNT", "NET_SLS"),
        "gl_measures": of("gl_measures", *month),
        "uom_cost": of("uom_cost", "PRIMARY_UOM_COST", "LINE_COUNT"),
    }
