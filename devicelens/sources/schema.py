"""The declared types of the logical tables, and reading stored tables by them.

Stored tables come as their sources keep them: event codes as numbers or as
text, codes padded with blanks, money and months as text, dates of the ERP as
Julian numbers (``CYYDDD``). :func:`typed` casts each declared column once, at
the source, so that the jobs compare equal types and never rely on an implicit
cast (which raises on ``'A4' = 4`` in ANSI mode).

Kinds: ``code`` (text without surrounding blanks, empty is NULL), ``text`` (as
it is), ``long``, ``int``, ``money`` (DECIMAL(18,4)), ``time`` (TIMESTAMP_NTZ),
``date``, ``julian`` (a date, or a Julian number). A value that can't be read is
NULL; :func:`unreadable` lists those values. A column that has its declared type
already is passed on bare, so filters on it still reach the scan; codes are
trimmed unless ``trim=False`` says that the stored ones are clean.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DECLARED = {
    "events": "EventId long, BarCodeNumber code, FK_DeviceId long, EventCode int, SrcID code, DestID code, TimeStamp time, FK_UserId long",
    "devices": "DeviceUID long, BarCodeNumber code, SerialNumber code, DeviceCode code, DeviceType text, Make text, Model text, Owner text, "
               "OwnerID code, StatusDescription text, StatusCode code",
    "event_codes": "Code int, Description text",
    "oem_info": "EquipmentTypeId code, PartNumber code",
    "clients": "ID code, PK_ClientId long, FK_ParentCompanyId long, Name text, Address1 text, Address2 text, City text, State text, Zip text, "
               "E1_AccountNumber code, Manufacturer int",
    "associates": "ID code, ClientID code, FK_ClientId long, Eid code, Name text, UserId long",
    "po_receipts": "E1PurchaseOrderReceiptId long, PONumber code, DeviceCode code, ReceiptDate time",
    "import_history": "E1PurchaseOrderReceiptId long, FK_DeviceId long, CreatedBy text, CreatedDate time",
    "repair_tickets": "PK_RepairTicketId long, FK_DeviceId long, FK_RepairPerformedById long, BarCodeNumber code, Status text, PerformedAt text, "
                      "RepairTicketNo code, VendorRMANumber code, RepairedBy text, RepairType text, PMPerformedBy text, DateOpened time, "
                      "DateRepairCompleted time, DateLastModified time",
    "rma_tracker": "PK_RMATrackerId long, FK_RepairTicketId long",
    "fact_sales": "SLS_ID long, ORDR_NUM code, INV_NUM code, BIOMED_FLG code, DIM_CUST_CURR_ID long, DIM_GL_DT_ID long, "
                  "DIM_ITEM_E1_CURR_ID long, DIM_ACCT_MGR_CURR_ID long, DIM_SLS_GL_ACCT_ID long, DIM_COGS_GL_ACCT_ID long, "
                  "DIM_TRANS_TYPE_ID long, EXT_NET_SLS_AMT money, EXT_SELL_GP_FIN_AMT money, EXT_COGS_ACQ_AMT money",
    "period": "DIM_PERIOD_ID long, DT date, FISC_YR_NUM int, FISC_MTH_NUM int, FISC_WK_NUM int, CAL_YR_NUM int, CAL_MTH_NUM int, "
              "CAL_WK_NUM int, FISC_YR_MTH_NUM code, CAL_YR_MTH_NUM code",
    "items": "DIM_ITEM_E1_CURR_ID long, ITEM_E1_NUM code, ITEM_DSC text, PARNT_SUPLR_NAME text, PRMRY_UOM code, PROD_SUB_CTGRY_LVL4_DSC text, "
             "PRMRY_TO_SELL_DIVISOR money, STNDRD_COST_AMT money",
    "biomed_sales": "DIM_BIOMED_SLS_ID long, REF_NUM code, DEVICE_CD code, ASSET_ID code, REPAIR_TKT_NUM code, BILL_START_END text",
    "gl_accounts": "DIM_GL_ACCT_ID long, OBJ_ACCT_CD code",
    "trans_types": "DIM_TRANS_TYPE_ID long, LINE_TYPE_CD code, LINE_TYPE_DSC text, ORDR_TYPE_CD code, ORDR_TYPE_DSC text",
    "account_managers": "DIM_ACCT_MGR_CURR_ID long, ACCT_MGR_EMPLY_ID code, ACCT_MGR_NAME text, ACCT_MGR_TERR_E1_NUM code, ACCT_MGR_TYPE_CD code",
    "customers_curr": "CUST_E1_NUM code, BILL_TO_CUST_NUM code",
    "customers_blend": "DIM_CUST_CURR_ID long, DIM_BILL_TO_CUST_CURR_ID long, CUST_E1_NUM code, CUST_NAME text, MSTR_GRP_NAME text, "
                       "BIOMED_ACCT_FLG code, BILL_TO_CUST_E1_NUM code, MMS_SUB_CLASS_CD code",
    "multi_rep": "CMAN8 code, CMSLSM code, CMSTMEDT julian",
    "price_list": "PLY553PLITM code, PLTORG code",
    "device_index": "DEVICE_CODE code, TYPE text, DEVICE_GROUP_LVL_1 text, DEVICE_GROUP_LVL_2 text",
}
# Column -> kind, by logical table.
SCHEMAS: dict[str, dict[str, str]] = {table: dict(c.split() for c in columns.split(", ")) for table, columns in _DECLARED.items()}
TYPES: dict[str, T.DataType] = {
    "code": T.StringType(), "text": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "money": T.DecimalType(18, 4),
    "time": T.TimestampNTZType(), "date": T.DateType(), "julian": T.DateType()}


def julian_date(number: Column) -> Column:
    """The date of a ``CYYDDD`` number (century since 1900, year, day of the year); NULL for 0 and for no such day."""
    year = F.floor(1900 + number / 1000).cast("int")
    day = (number % 1000).cast("int")
    date = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1)
    return F.when((number > 0) & (day > 0) & (F.year(date) == year), date)


def read_as(value: Column, kind: str, stored: T.DataType, trim: bool = True) -> Column:
    """``value``, stored as ``stored``, as the declared kind."""
    wanted = TYPES[kind]
    if kind == "code":
        # A number stored as DECIMAL(p,0) or double has no point in its text.
        whole = isinstance(stored, (T.DecimalType, T.DoubleType, T.FloatType))
        text = value.try_cast("long").cast("string") if whole else value.cast("string")
        return F.nullif(F.trim(text), F.lit("")) if trim or not isinstance(stored, T.StringType) else value
    if stored == wanted:
        return value
    text = F.nullif(F.trim(value), F.lit("")) if isinstance(stored, T.StringType) else value
    if kind == "julian":
        number = julian_date(text.try_cast("int")) if not isinstance(stored, (T.TimestampType, T.TimestampNTZType)) else None
        if isinstance(stored, T.StringType):
            return F.when(text.rlike("^[0-9]+$"), number).otherwise(text.try_cast("date"))
        return value.cast("date") if number is None else number
    return text.try_cast(wanted)


def _stored(df: DataFrame, table: str) -> dict[str, T.StructField]:
    """Declared column -> the stored field of that name, in any case."""
    fields = {f.name.lower(): f for f in df.schema.fields}
    missing = [c for c in SCHEMAS[table] if c.lower() not in fields]
    if missing:
        raise ValueError(f"{table} lacks the columns {', '.join(missing)}")
    return {c: fields[c.lower()] for c in SCHEMAS[table]}


def typed(df: DataFrame, table: str, *, trim: bool = True) -> DataFrame:
    """The declared columns of a stored table, read as their kinds; further columns follow as they are."""
    stored = _stored(df, table)
    rest = [f.name for f in df.schema.fields if f.name not in {s.name for s in stored.values()}]
    return df.select(*[read_as(F.col(f"`{f.name}`"), SCHEMAS[table][c], f.dataType, trim).alias(c) for c, f in stored.items()],
                     *[F.col(f"`{c}`") for c in rest])


def unreadable(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, value, row_count) of stored values that can't be read as declared.

    One scan; values are counted with partial sums.
    """
    pairs = []
    for c, f in _stored(df, table).items():
        kind, value = SCHEMAS[table][c], F.col(f"`{f.name}`")
        if kind in ("code", "text") or f.dataType == TYPES[kind]:
            continue
        text = value.cast("string")
        zero = F.lit(False) if kind != "julian" else F.trim(text).isin("0", "")  # no date
        bad = value.isNotNull() & (F.trim(text) != "") & ~zero & read_as(value, kind, f.dataType).isNull()
        pairs.append(F.when(bad, F.struct(F.lit(c).alias("column_name"), text.alias("value"))))
    found = df.select(F.explode(F.array_compact(F.array(*pairs))).alias("p")) if pairs else None
    if found is None:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, value string, row_count long")
    return (found.groupBy(F.col("p.column_name").alias("column_name"), F.col("p.value").alias("value"))
            .agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(table).alias("table_name"), "column_name", "value", "row_count"))


def unreadable_values(frames: Mapping[str, DataFrame]) -> DataFrame:
    """:func:`unreadable` of several stored tables, by logical name."""
    return reduce(DataFrame.unionByName, [unreadable(df, table) for table, df in frames.items()])
