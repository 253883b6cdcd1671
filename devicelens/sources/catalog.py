"""Logical tables used by the jobs, and how to read them.

A job takes a :class:`Tables` object: a lazy, memoised mapping from logical
table name to ``DataFrame``. The same ``DataFrame`` object is handed out for
every role a table plays (clients as source and as destination, the period
dimension as GL calendar and rent calendar), so Catalyst sees one relation
and can reuse its scan or broadcast exchange.

Logical names and the reference tables they stand for:

=================  =============================  =================
logical name       reference table                area
=================  =============================  =================
fact_sales         V_FACT_SLS                     sales warehouse
period             V_DIM_PERIOD                   sales warehouse
items              V_DIM_ITEM_E1_CURR             sales warehouse
biomed_sales       V_DIM_BIOMED_SLS               sales warehouse
gl_accounts        V_DIM_GL_ACCT                  sales warehouse
trans_types        V_DIM_TRANS_TYPE               sales warehouse
account_managers   V_DIM_ACCT_MGR_CURR            sales warehouse
customers_curr     V_DIM_CUST_E1_CURR             sales warehouse
customers_blend    V_DIM_CUST_E1_BLEND_CURR       sales warehouse
multi_rep          SRC_E1_MMS_F42140              sales warehouse
price_list         SRC_E1_MMS_F55413PL            sales warehouse
device_index       MR_DEVICE_INDEX                sales warehouse
events             Events                         device operations
devices            qryDevices                     device operations
event_codes        EventCodes                     device operations
oem_info           EquipmentTypeOEMInfo           device operations
clients            Clients                        device operations
associates         Associates                     device operations
po_receipts        E1PurchaseOrderReceipt         device operations
import_history     E1ImportHistory                device operations
repair_tickets     RepairTickets                  device operations
rma_tracker        RMATracker                     device operations
=================  =============================  =================
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from devicelens.sources.ranges import bounds_sql, counts_sql, plan_reads
from devicelens.sources.schema import typed

LOGICAL_TABLES = {
    "fact_sales": "V_FACT_SLS",
    "period": "V_DIM_PERIOD",
    "items": "V_DIM_ITEM_E1_CURR",
    "biomed_sales": "V_DIM_BIOMED_SLS",
    "gl_accounts": "V_DIM_GL_ACCT",
    "trans_types": "V_DIM_TRANS_TYPE",
    "account_managers": "V_DIM_ACCT_MGR_CURR",
    "customers_curr": "V_DIM_CUST_E1_CURR",
    "customers_blend": "V_DIM_CUST_E1_BLEND_CURR",
    "multi_rep": "SRC_E1_MMS_F42140",
    "price_list": "SRC_E1_MMS_F55413PL",
    "device_index": "MR_DEVICE_INDEX",
    "events": "Events",
    "devices": "qryDevices",
    "event_codes": "EventCodes",
    "oem_info": "EquipmentTypeOEMInfo",
    "clients": "Clients",
    "associates": "Associates",
    "po_receipts": "E1PurchaseOrderReceipt",
    "import_history": "E1ImportHistory",
    "repair_tickets": "RepairTickets",
    "rma_tracker": "RMATracker",
}


class Tables(Mapping):
    """Lazy, memoised name -> DataFrame mapping."""

    def __init__(self, spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame]]):
        self.spark = spark
        self._loaders = dict(loaders)
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self._loaders[name]()
        return self._cache[name]

    def __iter__(self):
        return iter(self._loaders)

    def __len__(self) -> int:
        return len(self._loaders)

    def override(self, **frames: DataFrame) -> "Tables":
        """A copy with some tables replaced (used by tests and fixtures)."""
        loaders = dict(self._loaders)
        for name, df in frames.items():
            loaders[name] = (lambda d=df: d)
        return Tables(self.spark, loaders)


def catalog_tables(spark: SparkSession, names: Mapping[str, str] | None = None,
                   prefix: str = "", trim: bool = True) -> Tables:
    """Read the logical tables from the session catalog, typed as declared (``sources.schema``).

    ``names`` maps a logical name to a (possibly multi-part) table name; by
    default the reference name under ``prefix`` is used, e.g.
    ``prefix="edw.edwrpt."`` reads ``edw.edwrpt.V_FACT_SLS``. ``trim=False``
    takes codes as stored, so that filters on them reach the scan.
    """
    names = dict(names or {})
    loaders = {}
    for logical, ref_name in LOGICAL_TABLES.items():
        full = names.get(logical, prefix + ref_name)
        loaders[logical] = (lambda t=logical, n=full: typed(spark.table(n), t, trim=trim))
    return Tables(spark, loaders)


def parquet_tables(spark: SparkSession, root: str, trim: bool = True) -> Tables:
    """Read each logical table from ``<root>/<reference name>`` parquet, typed as declared."""
    loaders = {logical: (lambda t=logical, n=ref: typed(spark.read.parquet(f"{root}/{n}"), t, trim=trim))
               for logical, ref in LOGICAL_TABLES.items()}
    return Tables(spark, loaders)


# Operational (device-service) tables live in a relational database in the
# source system; these are their logical names.
OPERATIONAL_TABLES = ("events", "devices", "event_codes", "oem_info", "clients", "associates",
                      "po_receipts", "import_history", "repair_tickets", "rma_tracker")


def jdbc_tables(spark: SparkSession, url: str, properties: Mapping[str, str], *,
                schema: str = "dbo", partitions: Mapping[str, tuple] | None = None,
                base: Tables | None = None, trim: bool = True) -> Tables:
    """Read the operational tables over JDBC; other names come from ``base``.

    ``partitions`` maps a logical name to ``(column, lower, upper, n)`` for a
    parallel bulk read split into ``n`` ranges of a numeric column (without
    it a JDBC table is read by a single task, which only suits small
    tables), e.g. ``{"events": ("EventId", 0, 10**10, 512)}``. With
    ``(column, n)`` the database finds the bounds and counts its rows per key
    range when the table is first used, and about ``n`` ranges of about equal
    rows are read (``sources.ranges``). Filters and column pruning of the jobs
    are pushed into the generated SQL.
    """
    partitions = dict(partitions or {})
    props = dict(properties)

    def reader(logical: str):
        table = f"{schema}.{LOGICAL_TABLES[logical]}"
        if len(partitions.get(logical, ())) == 2:
            column, n = partitions[logical]
            ask = lambda sql: spark.read.format("jdbc").options(url=url, query=sql, **props).load()
            return lambda: typed(spark.read.jdbc(url, table, properties=props, predicates=plan_reads(
                column, n, lambda: tuple(ask(bounds_sql(table, column)).first()),
                lambda low, width, high: [tuple(r) for r in ask(counts_sql(table, column, low, width, high)).collect()])),
                logical, trim=trim)
        if logical in partitions:
            column, lower, upper, n = partitions[logical]
            return lambda: typed(spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper,
                                                 numPartitions=n, properties=props), logical, trim=trim)
        return lambda: typed(spark.read.jdbc(url, table, properties=props), logical, trim=trim)

    loaders = {name: (lambda n=name: base[n]) for name in (base or {})}
    loaders.update({name: reader(name) for name in OPERATIONAL_TABLES})
    return Tables(spark, loaders)
