"""Session helpers.

The library never hard-codes a cluster layout.  On a cluster the session is
handed in by the caller; the builder here is what tests and the bench use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # broadcast only what is provably small; the operators that broadcast
    # check the size themselves, this is the planner's own cap.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "veil", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's defaults."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("VEIL_DRIVER_MEMORY", "8g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    The cluster names it in ``spark.checkpoint.dir``.  Where it is unset, a
    session in one process (tests) gets a scratch folder of its own; on a
    cluster that is an error, since executors share no local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="veil-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


# DataFrames the library materialised for reuse inside a query (ranked copies,
# model count tables).  A long-lived session releases them between jobs.
_MATERIALISED: list = []


def keep(df):
    """Persist (memory, then disk) and remember ``df`` for ``release``."""
    from pyspark import StorageLevel
    d = df.persist(StorageLevel.MEMORY_AND_DISK)
    _MATERIALISED.append(d)
    return d


def release() -> int:
    """Unpersist everything ``keep`` materialised; returns how many."""
    n = len(_MATERIALISED)
    while _MATERIALISED:
        _MATERIALISED.pop().unpersist(blocking=False)
    return n
