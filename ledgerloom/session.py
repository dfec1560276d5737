"""Spark session defaults for the library.

Everything here is a plain ``SparkSession.builder`` configuration. On a
cluster the platform's own settings win: ``get_session`` only fills in
values that are not already set, and ``checkpoint_dir`` reads the shared
folder from ``spark.checkpoint.dir`` before falling back to a local one
(tests only).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the jobs rely on for correct answers (UTC day boundaries, ANSI
# arithmetic) and for a good plan at any scale (AQE re-plans joins and
# coalesces/splits partitions from runtime statistics).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    # streaming state (latest scan per shipment) can grow with the number of keys: keep it in RocksDB
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledgerloom", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        # a local session: nothing of a platform's is overridden
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    conf = dict(extra or {})
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for k, v in DEFAULTS.items():  # all are runtime settings of the session; what was submitted wins
        if not given.contains(k) and k not in conf:
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only when none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...);
    it is read, never replaced. ``spark.checkpoint.dir`` cannot be changed on
    a running session, so when it is unset in a local run (tests) a folder of
    this machine is registered with ``SparkContext.setCheckpointDir``; on a
    cluster, where executors could not share such a folder, that is an error.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="ledgerloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local
