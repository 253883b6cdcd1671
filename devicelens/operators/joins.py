"""Join helpers.

Dimension joins are left to Spark's size-based choice (static estimate,
then AQE with the real shuffle size); nothing that grows with the data is
broadcast by a hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeat_rows(df: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """The row effect of ``df LEFT JOIN dim ON key = dim_key`` alone.

    Only keys that ``dim`` holds more than once are joined, with their counts:
    normally none, so a unique dimension costs the fact no shuffle.
    """
    repeats = (dim.groupBy(F.col(dim_key).alias("__key")).agg(F.count(F.lit(1)).cast("int").alias("__n"))
               .where(F.col("__key").isNotNull() & (F.col("__n") > 1))
               .select("__key", F.sequence(F.lit(1), F.col("__n")).alias("__copies")))
    return (df.join(repeats, F.col(key) == F.col("__key"), "left")
            .withColumn("__copy", F.explode_outer("__copies")).drop("__key", "__copies", "__copy"))


def latest_per_key(df: DataFrame, key: str, ts: str, name: str) -> DataFrame:
    """(key, max(ts) as name): the latest event per key.

    A plain grouped max; partial aggregation before the shuffle makes a hot
    key cost one row per map task.
    """
    return df.groupBy(key).agg(F.max(ts).alias(name))


def after_latest(left: DataFrame, latest: DataFrame, key: str, left_ts: str,
                 latest_ts: str) -> DataFrame:
    """Rows of ``left`` later than the key's latest marker in ``latest``.

    Equi-join on ``key`` with the residual ``latest_ts < left_ts``. Rows
    before the latest marker are dropped (the marker is the overall latest,
    not the latest before the row).
    """
    cond = (left[key] == latest[key]) & (latest[latest_ts] < left[left_ts])
    return left.join(latest, cond, "inner").drop(latest[key])
