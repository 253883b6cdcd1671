"""Ranking operators.

``rank() over (partition by key order by ts)`` is a window: one shuffle by
``key`` and a sort per key. Two shapes appear in the jobs:

* only ``rank = 1`` is kept (first event per device). Filtering on the rank
  right after the window lets Catalyst plan a *partial* WindowGroupLimit
  before the shuffle, so every map task already drops all but the first
  rows of each key; a hot key no longer ships its whole history to one task.
* every rank is kept (full history). A single hot key would then be sorted
  by one task. :func:`bucketed_rank` splits each key's rows into time
  buckets, large buckets into ranges at quantiles of their own times, ranks
  inside each piece and adds the row count of the key's earlier pieces, which
  is the same rank with the work spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows above which a time bucket of one key is split, and into how many ranges.
MOST_ROWS, SPLITS = 1_000_000, 256


def with_rank(df: DataFrame, partition_by, order_by: str, name: str = "eventRank") -> DataFrame:
    """``rank()`` (ties share a rank, gaps follow) ascending, NULLs first."""
    w = Window.partitionBy(*_cols(partition_by)).orderBy(F.col(order_by).asc_nulls_first())
    return df.withColumn(name, F.rank().over(w))


def first_by_rank(df: DataFrame, partition_by, order_by: str,
                  name: str = "eventRank") -> DataFrame:
    """Rows ranked first in their partition, ties kept (rank, not row_number)."""
    return with_rank(df, partition_by, order_by, name).where(F.col(name) == 1)


def rank_buckets(df: DataFrame, keys: list, order_by: str, unit: str = "DAY", most: int = MOST_ROWS,
                 splits: int = SPLITS) -> DataFrame:
    """``df`` with ``__bucket`` and ``__range``: consecutive pieces of each key's rows in order of ``order_by``.

    A piece is a time bucket; a bucket of more than ``most`` rows is cut into
    up to ``splits`` ranges at approximate quantiles of its own times. Equal
    times stay together, so ranks agree whatever the quantiles are. NULL times
    sort first and form the first bucket.
    """
    at = F.unix_micros(F.col(order_by).cast("timestamp_ltz"))
    rows = df.withColumn("__bucket", F.coalesce(F.date_trunc(unit, F.col(order_by)), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")))
    by = [*keys, "__bucket"]
    same = lambda prefix: reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by])
    large = (rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
             .select(*[F.col(c).alias(f"__l_{c}") for c in by]))
    steps = [i / splits for i in range(1, splits)]
    cuts = (rows.join(large, same("__l_"), "left_semi").groupBy(*by).agg(F.percentile_approx(at, steps, 100 * splits).alias("__cuts"))
            .select(*[F.col(c).alias(f"__c_{c}") for c in by], F.array_distinct("__cuts").alias("__cuts")))
    below = F.coalesce(F.size(F.filter("__cuts", lambda c: c < at)), F.lit(0))
    # size(NULL) is -1: a bucket without cuts is one range.
    return (rows.join(cuts, same("__c_"), "left").withColumn("__range", F.when(F.col("__cuts").isNull(), 0).otherwise(below))
            .drop("__cuts", *[f"__c_{c}" for c in by]))


def bucketed_rank(df: DataFrame, partition_by, order_by: str, name: str = "eventRank",
                  bucket: str = "DAY", most: int = MOST_ROWS, splits: int = SPLITS) -> DataFrame:
    """Same values as :func:`with_rank`, computed without one task per key.

    ``bucket`` is a ``date_trunc`` unit for ``order_by`` (a timestamp); buckets
    with very many rows are split further (:func:`rank_buckets`). Rows of one
    key are ranked inside a piece; a piece's offset is the number of the key's
    rows in earlier pieces, from a small count table.
    """
    keys = _cols(partition_by)
    pieces = rank_buckets(df, keys, order_by, bucket, most, splits)
    by = [*keys, "__bucket", "__range"]
    # The window over the counts sees one row per piece of a key, so even a hot key stays small.
    counts = pieces.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket", "__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"__o_{c}") for c in by],
                            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*by).orderBy(F.col(order_by).asc_nulls_first())
    # NULL keys form a window partition of their own: match them null-safely.
    cond = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in by])
    return (pieces.withColumn("__local", F.rank().over(inside)).join(offsets, cond, "inner")
            .withColumn(name, (F.col("__offset") + F.col("__local")).cast("int"))
            .drop("__bucket", "__range", "__offset", "__local", *[f"__o_{c}" for c in by]))


def _cols(cols) -> list[str]:
    if isinstance(cols, (str, Column)):
        return [cols]
    return list(cols)
