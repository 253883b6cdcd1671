"""SparkSession construction with settings that matter at scale.

The jobs never rely on session settings for correctness; these only shape
the physical plan (AQE, skew-join splitting, broadcast threshold).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Applied where neither the operator (spark-defaults, spark-submit) nor the
# caller has set the key.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Static broadcast only for plans whose size estimate is below this;
    # AQE re-checks against the real shuffle size at runtime.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}
# Local sessions only (tests, bench): no web page, one time zone, and no
# Python call-site capture (a static key) while plans are built.
LOCAL_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "devicelens", extra_conf: dict | None = None) -> SparkSession:
    own = dict(LOCAL_CONF) if (master or "").startswith("local") else {}
    own.update(extra_conf or {})
    if shuffle_partitions:
        own["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in own.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for k, v in DEFAULT_CONF.items():
        if k not in own and not given.contains(k):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    ``spark.checkpoint.dir`` names it on a cluster. A scratch folder is made
    only where that is unset on a local master; elsewhere an unset folder is
    an error, because a machine-local one would not be seen by all executors.
    """
    sc = spark.sparkContext
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="devicelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local
