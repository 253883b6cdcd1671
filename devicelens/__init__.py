"""devicelens: Spark-native jobs for equipment sales and device-service analytics.

Layout
------
sources/    logical-table readers (catalog or parquet) and adapters from the
            driver's TPC-H-ish test tables to the logical schema
functions/  business rules and scalar column builders (dates, text)
operators/  reusable relational building blocks (ranking, joins, audits)
plans/      the end-to-end jobs (sales report, placement tracing, depot metrics)
"""

from devicelens.session import get_session

__all__ = ["get_session"]
