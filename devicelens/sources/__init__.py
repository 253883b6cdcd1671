"""Logical tables: catalog/parquet readers and driver test-data adapters."""

from devicelens.sources.catalog import (LOGICAL_TABLES, Tables, catalog_tables, jdbc_tables,
                                        parquet_tables)
from devicelens.sources.driver import driver_tables
from devicelens.sources.schema import SCHEMAS, typed, unreadable_values

__all__ = ["LOGICAL_TABLES", "SCHEMAS", "Tables", "catalog_tables", "driver_tables", "jdbc_tables",
           "parquet_tables", "typed", "unreadable_values"]
