"""Adapters from the driver's test tables to the logical schema.

The test data is a TPC-H-like star schema plus an ``events`` table. Each
logical table is *derived* from one or two driver tables by deterministic
column rules, so every job's work grows with the test scale. The same rules
are written in SQL in ``checks/oracle_sql.py`` so an independent engine
can recompute every job.

Rules (``k`` is the integer in ``events.props``):

* Events: barcode and device id = ``user_id``; code by event type
  (signup -> 1 check-in, click -> 2 cleaned, view -> 3 or 33 PM by k
  parity, error -> 924 repair, purchase -> ship code ``SHIP_CYCLE[k % 8]``);
  source = client ``k % 25``, destination = client ``event_id % 25``;
  technician = associate ``k % 10``.
* Clients: one site per nation (id from ``CLIENT_IDS``; parent company 108
  for region 0, else the region key; ``POOL`` and ``Field Service`` name
  tags) plus one end-user client per customer.
* Devices: one per customer. Associates: one per supplier.
* Repair tickets: the error events; RMA rows for a third of them.
* PO receipts / import history: one per order (receipt = order date + 23y).
* Sales fact: lineitem joined to orders; dimensions from part, customer,
  supplier, nation, region; the period dimension is a generated calendar.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelens.sources.catalog import Tables

# ---------------------------------------------------------------------------
# Fixture values (test-data mapping, not business rules).
# ---------------------------------------------------------------------------

# Client id of nation 0..24. Regions 0 and 1 (nations n with n % 5 in {0, 1})
# hold the ten depots; region 0 is the operator's own parent company.
CLIENT_IDS = ("00373", "18885", "00060", "00000", "00072",
              "04362", "00882", "05549", "00249", "90001",
              "10415", "19142", "00475", "90002", "00784",
              "19112", "00883", "90003", "00920", "90004",
              "00301", "18441", "01045", "90005", "90006")

# Ship code of a purchase event, by k % 8.
SHIP_CYCLE = (4, 6, 8, 66, 301, 508, 666, 903)

# Event code descriptions.
EVENT_CODES = ((1, "Check In"), (2, "Cleaned"), (3, "PM Complete"), (33, "PM Complete - Extended"),
               (924, "Repair Complete"), (4, "Shipped to Customer"), (6, "Shipped to Vendor"),
               (8, "Transfer"), (66, "Shipped - Loaner"), (301, "Shipped - Exchange"),
               (508, "Shipped - Pool"), (666, "Shipped - Other"), (903, "Relocated"))

# Item numbers given to part keys 0..19 (mod 40); they reach every branch
# of the sales classification.
SPECIAL_ITEMS = ("1167563", "1066182", "307728", "1151926", "1151927", "1167552", "1167881",
                 "1167556", "1167564", "1167565", "1167545", "1167541", "1167562", "1167566",
                 "1163161", "1163164", "1170554", "1167548", "1167546", "1200820")

# Item sub-category by part type.
SUB_CATEGORY_BY_TYPE = (("ECONOMY", "Feeding Pumps- New"),
                        ("SMALL", "Infusion Pumps - Used Ambulatory"),
                        ("MEDIUM", "Vents - Rentals"),
                        ("PROMO", "Infusion Pumps - New LVP"),
                        ("STANDARD", "Humidifiers, Used"),
                        ("LARGE", "Patient Supplies"))

DEVICE_TYPE_BY_SEGMENT = (("FURNITURE", "Pump - Enteral"), ("MACHINERY", "Pump - Syringe"),
                          ("BUILDING", "Ventilator"), ("AUTOMOBILE", "Pulse Oximeter"))
DEFAULT_DEVICE_TYPE = "Cable"

GROUP_PREFIXES = ("BIO - ", "BIO-", "BIO ", "")
SUB_CLASSES = ("06", "10", "45", "36", "99")
GL_ACCOUNT_CODES = ("411010", "414021", "410000", "500100", "500200")
LINE_TYPES = ("B3", "B4", "B5", "S", "SF")
LINE_TYPE_NAMES = ("Rental", "New Equipment", "Used Equipment", "Service", "Freight")
ORDER_TYPES = ("SO", "SR", "SE")
ORDER_TYPE_NAMES = ("Sales Order", "Rental Order", "Exchange Order")
MANAGER_TYPES = ("EBO", "PBO", "ISR")
CUSTOMER_BASE = 65296440
FLAGGED_ACCOUNT = "66050515"
CALENDAR_START = dt.date(1992, 1, 1)
CALENDAR_END = dt.date(2030, 12, 31)
FISCAL_START_MONTH = 4


def _pick(values, index: Column) -> Column:
    """``values[index]`` for a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + F.lit(1)).cast("int"))


def _case(col: Column, pairs, default=None) -> Column:
    expr = None
    for key, value in pairs:
        cond = col == F.lit(key)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def _props_k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def _client_id(key: Column) -> Column:
    return _pick(CLIENT_IDS, key % F.lit(25))


def _str(col: Column) -> Column:
    return col.cast("string")


# ---------------------------------------------------------------------------
# Device operations
# ---------------------------------------------------------------------------

def events(raw: DataFrame) -> DataFrame:
    k = _props_k(F.col("props"))
    code = (F.when(F.col("event_type") == "signup", F.lit(1))
            .when(F.col("event_type") == "click", F.lit(2))
            .when(F.col("event_type") == "view",
                  F.when(k % 2 == 0, F.lit(3)).otherwise(F.lit(33)))
            .when(F.col("event_type") == "error", F.lit(924))
            .when(F.col("event_type") == "purchase", _pick(SHIP_CYCLE, k % 8)))
    return raw.select(
        F.col("event_id").alias("EventId"),
        _str(F.col("user_id")).alias("BarCodeNumber"),
        F.col("user_id").alias("FK_DeviceId"),
        code.cast("int").alias("EventCode"),
        _client_id(k).alias("SrcID"),
        _client_id(F.col("event_id")).alias("DestID"),
        F.col("ts").alias("TimeStamp"),
        (k % 10).cast("long").alias("FK_UserId"),
    )


def clients(nation: DataFrame, customer: DataFrame) -> DataFrame:
    """Site clients (one per nation: depots, internal and other sites) and
    end-user clients (one per customer). End-user ids have six digits and
    keys from 1000 up, so they never collide with the 25 site clients that
    events, devices, staff and repair tickets refer to."""
    key = F.col("n_nationkey")
    name = F.concat(F.col("n_name"),
                    F.when(key % 6 == 0, F.lit(" POOL")).otherwise(F.lit("")),
                    F.when(key % 5 == 4, F.lit(" Field Service")).otherwise(F.lit("")))
    sites = nation.select(
        _client_id(key).alias("ID"),
        key.cast("long").alias("PK_ClientId"),
        F.when(F.col("n_regionkey") == 0, F.lit(108)).otherwise(F.col("n_regionkey"))
         .cast("long").alias("FK_ParentCompanyId"),
        name.alias("Name"),
        F.concat(_str(key + 100), F.lit(" Main St")).alias("Address1"),
        F.when(key % 2 == 0, F.concat(F.lit("Suite "), _str(key))).alias("Address2"),
        F.concat(F.lit("City "), _str(key)).alias("City"),
        _pick(("TX", "CA", "NY", "OH", "GA"), F.col("n_regionkey")).alias("State"),
        _str(key + 75000).alias("Zip"),
        _str(key + 60000000).alias("E1_AccountNumber"),
        F.when(key % 7 == 1, F.lit(1)).otherwise(F.lit(0)).alias("Manufacturer"),
    )
    ck = F.col("c_custkey")
    end_users = customer.select(
        _str(ck + 100000).alias("ID"),
        (ck + 1000).alias("PK_ClientId"),
        (F.col("c_nationkey") % 5 + 1).cast("long").alias("FK_ParentCompanyId"),
        F.concat(F.col("c_name"), F.when(ck % 50 == 7, F.lit(" Pool")).otherwise(F.lit("")))
         .alias("Name"),
        F.concat(_str(ck), F.lit(" Customer Way")).alias("Address1"),
        F.lit(None).cast("string").alias("Address2"),
        F.concat(F.lit("City "), _str(F.col("c_nationkey"))).alias("City"),
        _pick(("TX", "CA", "NY", "OH", "GA"), F.col("c_nationkey") % 5).alias("State"),
        _str(ck % 90000 + 10000).alias("Zip"),
        _str(ck + CUSTOMER_BASE).alias("E1_AccountNumber"),
        F.lit(0).alias("Manufacturer"),
    )
    return sites.unionByName(end_users)


def devices(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    make = (F.when(key % 12 == 6, F.lit("BREAS")).when(key % 6 == 0, F.lit("Breas"))
            .when(key % 6 == 3, F.lit("Breas Medical"))
            .when(key % 3 == 1, F.lit("Philips"))
            .otherwise(F.lit("Baxter")))
    return customer.select(
        key.alias("DeviceUID"),
        _str(key).alias("BarCodeNumber"),
        F.concat(F.lit("M"), F.lpad(_str(key), 6, "0")).alias("SerialNumber"),
        _str(key % 1000).alias("DeviceCode"),
        _case(F.col("c_mktsegment"), DEVICE_TYPE_BY_SEGMENT, DEFAULT_DEVICE_TYPE).alias("DeviceType"),
        make.alias("Make"),
        F.concat(F.lit("Model "), _str(key % 7)).alias("Model"),
        F.concat(F.lit("Owner "), _str(F.col("c_nationkey"))).alias("Owner"),
        _client_id(F.col("c_nationkey")).alias("OwnerID"),
        F.when(key % 4 == 0, F.lit("In Repair")).otherwise(F.lit("In Service")).alias("StatusDescription"),
        F.when(key % 4 == 0, F.lit("IR")).otherwise(F.lit("IS")).alias("StatusCode"),
    )


def event_codes(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({code}, '{text}')" for code, text in EVENT_CODES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v(Code, Description)")


def oem_info(part: DataFrame) -> DataFrame:
    return part.select(_str(F.col("p_partkey")).alias("EquipmentTypeId"),
                       F.col("p_brand").alias("PartNumber"))


def associates(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        F.concat(F.lit("A"), _str(key)).alias("ID"),
        _client_id(F.col("s_nationkey")).alias("ClientID"),
        F.col("s_nationkey").cast("long").alias("FK_ClientId"),
        F.when(key % 4 == 3, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("E"), F.lpad(_str(key), 5, "0"))).alias("Eid"),
        F.col("s_name").alias("Name"),
        key.alias("UserId"),
    )


def _receipt_date() -> Column:
    return F.col("o_orderdate") + F.expr("INTERVAL 23 YEARS")


def po_receipts(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("E1PurchaseOrderReceiptId"),
        F.concat(F.lit("PO"), _str(F.col("o_orderkey"))).alias("PONumber"),
        _str(F.col("o_custkey") % 1000).alias("DeviceCode"),
        _receipt_date().alias("ReceiptDate"),
    )


def import_history(orders: DataFrame) -> DataFrame:
    imported = (F.col("o_orderkey") % 13 != 0) & (F.col("o_custkey") % 9 != 0)
    return orders.where(imported).select(
        F.col("o_orderkey").alias("E1PurchaseOrderReceiptId"),
        F.col("o_custkey").alias("FK_DeviceId"),
        F.concat(F.lit("loader"), _str(F.col("o_orderkey") % 5)).alias("CreatedBy"),
        (_receipt_date() + F.expr("INTERVAL 1 DAYS")).alias("CreatedDate"),
    )


def repair_tickets(raw: DataFrame) -> DataFrame:
    k = _props_k(F.col("props"))
    eid = F.col("event_id")
    completed = F.when(k % 10 != 0, F.timestamp_add("HOUR", k, F.col("ts")))
    return raw.where(F.col("event_type") == "error").select(
        eid.alias("PK_RepairTicketId"),
        F.col("user_id").alias("FK_DeviceId"),
        (k % 10).cast("long").alias("FK_RepairPerformedById"),
        _str(F.col("user_id")).alias("BarCodeNumber"),
        _pick(("Closed", "Open", "Pending"), k % 3).alias("Status"),
        _client_id(k).alias("PerformedAt"),
        F.concat(F.lit("RT"), _str(eid)).alias("RepairTicketNo"),
        F.when(k % 4 != 0, F.concat(F.lit("RMA"), _str(eid))).alias("VendorRMANumber"),
        F.concat(F.lit("Tech "), _str(k % 10)).alias("RepairedBy"),
        _pick(("Repair", "Inspection", "Calibration"), eid % 3).alias("RepairType"),
        F.concat(F.lit("Tech "), _str((k + 1) % 10)).alias("PMPerformedBy"),
        F.col("ts").alias("DateOpened"),
        completed.alias("DateRepairCompleted"),
        F.coalesce(completed, F.col("ts")).alias("DateLastModified"),
    )


def rma_tracker(raw: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    return (raw.where((F.col("event_type") == "error") & (eid % 3 == 0))
            .select((eid * 10 + 1).alias("PK_RMATrackerId"), eid.alias("FK_RepairTicketId")))


# ---------------------------------------------------------------------------
# Sales warehouse
# ---------------------------------------------------------------------------

def _dec(col: Column, p: int, s: int) -> Column:
    return col.cast(f"decimal({p},{s})")


def _yyyymmdd(d: Column) -> Column:
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("long")


def fact_sales(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    price = _dec(F.col("l_extendedprice"), 12, 2)
    net = _dec(price * (F.lit(1) - _dec(F.col("l_discount"), 4, 2)), 18, 4)
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    # The first three lines of an order share item, day, manager and type, so
    # report rows sum several lines.
    alike = line <= 3
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                         "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
                         "l_linestatus", "l_shipdate")
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey, "inner").select(
        F.col("l_orderkey").alias("SLS_ID"),
        _str(order).alias("ORDR_NUM"),
        F.concat(F.lit("INV"), _str(order),
                 F.when(alike, F.lit("")).otherwise(F.concat(F.lit("-"), _str(line)))).alias("INV_NUM"),
        F.when(order % 2 == 0, F.lit("Y")).otherwise(F.lit("N")).alias("BIOMED_FLG"),
        F.when(order % 17 != 0, F.col("o_custkey")).alias("DIM_CUST_CURR_ID"),
        _yyyymmdd(F.when(alike, F.col("o_orderdate")).otherwise(F.col("l_shipdate"))).alias("DIM_GL_DT_ID"),
        F.when(alike, order % 150 + 1).otherwise(F.col("l_partkey")).alias("DIM_ITEM_E1_CURR_ID"),
        F.when(alike, F.col("o_custkey") % 10).otherwise(F.col("l_suppkey")).alias("DIM_ACCT_MGR_CURR_ID"),
        (F.when(F.col("l_returnflag") == "R", F.lit(0))
         .when(F.col("l_returnflag") == "A", F.lit(1)).otherwise(F.lit(2)))
        .cast("long").alias("DIM_SLS_GL_ACCT_ID"),
        F.when(F.col("l_linestatus") == "O", F.lit(3)).otherwise(F.lit(4))
         .cast("long").alias("DIM_COGS_GL_ACCT_ID"),
        ((order + F.when(alike, F.lit(0)).otherwise(line)) % 25).cast("long").alias("DIM_TRANS_TYPE_ID"),
        net.alias("EXT_NET_SLS_AMT"),
        F.when(line != 7, _dec(price * F.lit(0.25).cast("decimal(2,2)"), 18, 4))
         .alias("EXT_SELL_GP_FIN_AMT"),
        _dec(_dec(F.col("l_quantity"), 12, 2) * F.lit(10), 18, 4).alias("EXT_COGS_ACQ_AMT"),
    )


def period(spark: SparkSession, start: dt.date = CALENDAR_START, end: dt.date = CALENDAR_END,
           fiscal_start_month: int = FISCAL_START_MONTH) -> DataFrame:
    """Generated day calendar with calendar and fiscal attributes.

    Its size is fixed by the span (one row per day), so it is a safe
    broadcast side.
    """
    days = (end - start).days + 1
    fs = fiscal_start_month
    d = F.date_add(F.lit(start.isoformat()).cast("date"), F.col("id").cast("int"))
    base = spark.range(days).select(d.alias("DT"))
    y, m = F.year("DT"), F.month("DT")
    fy = y + (F.when(m >= fs, F.lit(1)).otherwise(F.lit(0)) if fs > 1 else F.lit(0))
    fm = (m - fs + 12) % 12 + 1
    fy_start = F.make_date(fy - (1 if fs > 1 else 0), F.lit(fs), F.lit(1))
    return base.select(
        _yyyymmdd(F.col("DT")).alias("DIM_PERIOD_ID"),
        F.col("DT"),
        fy.cast("int").alias("FISC_YR_NUM"),
        fm.cast("int").alias("FISC_MTH_NUM"),
        (F.floor(F.datediff(F.col("DT"), fy_start) / 7) + 1).cast("int").alias("FISC_WK_NUM"),
        y.alias("CAL_YR_NUM"),
        m.alias("CAL_MTH_NUM"),
        F.weekofyear("DT").alias("CAL_WK_NUM"),
        F.concat(_str(fy), F.lpad(_str(fm), 2, "0")).alias("FISC_YR_MTH_NUM"),
        F.concat(_str(y), F.lpad(_str(m), 2, "0")).alias("CAL_YR_MTH_NUM"),
    )


def items(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    slot = key % 40
    item = (F.when(slot == 39, F.lit(None).cast("string"))
            .when(slot < len(SPECIAL_ITEMS), _pick(SPECIAL_ITEMS, slot))
            .otherwise(_str(key + 3000000)))
    divisor = F.when(key % 11 != 0, _dec(_pick((0, 1, 3, 7), F.col("p_size") % 4), 18, 4))
    return part.select(
        key.alias("DIM_ITEM_E1_CURR_ID"),
        item.alias("ITEM_E1_NUM"),
        F.col("p_name").alias("ITEM_DSC"),
        F.col("p_brand").alias("PARNT_SUPLR_NAME"),
        _pick(("EA", "BX", "CS"), F.col("p_size") % 3).alias("PRMRY_UOM"),
        _case(F.col("p_type"), SUB_CATEGORY_BY_TYPE).alias("PROD_SUB_CTGRY_LVL4_DSC"),
        divisor.alias("PRMRY_TO_SELL_DIVISOR"),
        _dec(_dec(F.col("p_retailprice"), 12, 2) * F.lit(0.6).cast("decimal(1,1)"), 18, 4)
        .alias("STNDRD_COST_AMT"),
    )


def _us_date(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd/yyyy")


def biomed_sales(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    start = _us_date(F.col("o_orderdate"))
    stop = _us_date(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    slot = key % 8
    bill = (F.when(slot <= 2, F.concat(start, F.lit(" - "), stop))
            .when(slot <= 4, start)
            .when(slot == 5, F.lit("*"))
            .when(slot == 7, F.concat(start, F.lit("-"), stop)))
    return orders.select(
        key.alias("DIM_BIOMED_SLS_ID"),
        F.when(key % 5 != 0, F.concat(F.lit("OT"), _str(key))).alias("REF_NUM"),
        _str(F.col("o_custkey") % 1000).alias("DEVICE_CD"),
        F.when(key % 7 != 0, F.concat(F.lit("AS"), _str(key))).alias("ASSET_ID"),
        F.when(key % 3 == 0, F.concat(F.lit("RT"), _str(key))).alias("REPAIR_TKT_NUM"),
        bill.alias("BILL_START_END"),
    )


def gl_accounts(region: DataFrame) -> DataFrame:
    return region.select(F.col("r_regionkey").cast("long").alias("DIM_GL_ACCT_ID"),
                         _pick(GL_ACCOUNT_CODES, F.col("r_regionkey")).alias("OBJ_ACCT_CD"))


def trans_types(nation: DataFrame) -> DataFrame:
    key = F.col("n_nationkey")
    return nation.select(
        key.cast("long").alias("DIM_TRANS_TYPE_ID"),
        _pick(LINE_TYPES, key % 5).alias("LINE_TYPE_CD"),
        _pick(LINE_TYPE_NAMES, key % 5).alias("LINE_TYPE_DSC"),
        _pick(ORDER_TYPES, key % 3).alias("ORDR_TYPE_CD"),
        _pick(ORDER_TYPE_NAMES, key % 3).alias("ORDR_TYPE_DSC"),
    )


def account_managers(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        key.alias("DIM_ACCT_MGR_CURR_ID"),
        F.concat(F.lit("E"), F.lpad(_str(key), 5, "0")).alias("ACCT_MGR_EMPLY_ID"),
        F.col("s_name").alias("ACCT_MGR_NAME"),
        _str(key).alias("ACCT_MGR_TERR_E1_NUM"),
        _pick(MANAGER_TYPES, key % 3).alias("ACCT_MGR_TYPE_CD"),
    )


def _cust_num(key: Column) -> Column:
    """Customer number; key 50 bills to the flagged account."""
    return F.when(key == 50, F.lit(FLAGGED_ACCOUNT)).otherwise(_str(key + CUSTOMER_BASE))


def _bill_to_key(key: Column) -> Column:
    return key - key % 10


def customers_curr(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(_cust_num(key).alias("CUST_E1_NUM"),
                           _cust_num(_bill_to_key(key)).alias("BILL_TO_CUST_NUM"))


def customers_blend(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(
        key.alias("DIM_CUST_CURR_ID"),
        _bill_to_key(key).alias("DIM_BILL_TO_CUST_CURR_ID"),
        _cust_num(key).alias("CUST_E1_NUM"),
        F.col("c_name").alias("CUST_NAME"),
        F.concat(_pick(GROUP_PREFIXES, key % 4), F.col("c_mktsegment")).alias("MSTR_GRP_NAME"),
        F.when(key % 3 == 0, F.lit("Y")).otherwise(F.lit("N")).alias("BIOMED_ACCT_FLG"),
        _cust_num(_bill_to_key(key)).alias("BILL_TO_CUST_E1_NUM"),
        _pick(SUB_CLASSES, key % 5).alias("MMS_SUB_CLASS_CD"),
    )


def multi_rep(customer: DataFrame) -> DataFrame:
    """One territory per customer, and a second one for every bill-to customer."""
    key = F.col("c_custkey")
    end = (F.when(key % 2 == 0, F.lit("2030-12-31").cast("date"))
           .otherwise(F.lit("2020-12-31").cast("date")).alias("CMSTMEDT"))
    first = customer.select(_cust_num(key).alias("CMAN8"), _str(F.col("c_nationkey")).alias("CMSLSM"), end)
    second = customer.where(key % 10 == 0).select(
        _cust_num(key).alias("CMAN8"), _str((F.col("c_nationkey") + 1) % 25).alias("CMSLSM"), end)
    return first.unionByName(second)


def price_list(part: DataFrame) -> DataFrame:
    """Every ninth listed item is listed twice."""
    key = F.col("p_partkey")
    once = part.select(_str(key).alias("PLY553PLITM"),
                       F.when(key % 2 == 0, F.lit("OT")).otherwise(F.lit("CA")).alias("PLTORG"))
    twice = part.where(key % 18 == 0).select(_str(key).alias("PLY553PLITM"), F.lit("OT").alias("PLTORG"))
    return once.unionByName(twice)


def device_index(part: DataFrame) -> DataFrame:
    """Device codes without a first-level group are, for every fifth part, also listed as ``Other``."""
    size, key = F.col("p_size"), F.col("p_partkey")
    level2 = F.when(size % 3 == 1, F.lit("Other")).when(size % 3 == 2, F.lit("Enteral")).alias("DEVICE_GROUP_LVL_2")
    level1 = (F.when(size % 4 == 1, F.lit("Other")).when(size % 4 == 2, F.lit("Pumps"))
              .when(size % 4 == 3, F.lit("Respiratory")))
    listed = part.select(_str(key).alias("DEVICE_CODE"), F.col("p_type").alias("TYPE"),
                         level1.alias("DEVICE_GROUP_LVL_1"), level2)
    again = part.where((size % 4 == 0) & (key % 5 == 0)).select(
        _str(key).alias("DEVICE_CODE"), F.col("p_type").alias("TYPE"), F.lit("Other").alias("DEVICE_GROUP_LVL_1"), level2)
    return listed.unionByName(again)


# ---------------------------------------------------------------------------


def driver_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All logical tables, derived from the driver parquet files in ``sf_dir``."""
    raw_cache: dict[str, DataFrame] = {}

    def raw(name: str) -> DataFrame:
        if name not in raw_cache:
            raw_cache[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return raw_cache[name]

    loaders = {
        "events": lambda: events(raw("events")),
        "devices": lambda: devices(raw("customer")),
        "event_codes": lambda: event_codes(spark),
        "oem_info": lambda: oem_info(raw("part")),
        "clients": lambda: clients(raw("nation"), raw("customer")),
        "associates": lambda: associates(raw("supplier")),
        "po_receipts": lambda: po_receipts(raw("orders")),
        "import_history": lambda: import_history(raw("orders")),
        "repair_tickets": lambda: repair_tickets(raw("events")),
        "rma_tracker": lambda: rma_tracker(raw("events")),
        "fact_sales": lambda: fact_sales(raw("lineitem"), raw("orders")),
        "period": lambda: period(spark),
        "items": lambda: items(raw("part")),
        "biomed_sales": lambda: biomed_sales(raw("orders")),
        "gl_accounts": lambda: gl_accounts(raw("region")),
        "trans_types": lambda: trans_types(raw("nation")),
        "account_managers": lambda: account_managers(raw("supplier")),
        "customers_curr": lambda: customers_curr(raw("customer")),
        "customers_blend": lambda: customers_blend(raw("customer")),
        "multi_rep": lambda: multi_rep(raw("customer")),
        "price_list": lambda: price_list(raw("part")),
        "device_index": lambda: device_index(raw("part")),
    }
    return Tables(spark, loaders)
