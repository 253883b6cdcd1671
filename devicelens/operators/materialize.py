"""Cutting lineage in the cluster's shared checkpoint folder.

``DataFrame.checkpoint`` (reliable) writes the rows to ``spark.checkpoint.dir``
(a shared folder on a cluster), so a lost executor never forces the whole
upstream plan to be recomputed and several reports can read one
materialised input. ``localCheckpoint`` (executor-local, lost with the
executor) is never used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from devicelens.session import ensure_checkpoint_dir


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint of ``df`` in the session's checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def stored(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet to the session's shared folder; the folder written, for SQL that names its input."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path
