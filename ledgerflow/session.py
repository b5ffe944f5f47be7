"""Session construction and cluster-facing settings.

On a cluster the session already exists and carries the operator's configuration;
``get_spark`` only fills in settings that are unset.  Lineage cuts and streaming
checkpoints go to the shared folder named by ``spark.checkpoint.dir``; a local
scratch folder is used only when that setting is absent (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale.  They are defaults only: a value the cluster already
# set wins.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Dimension sides are broadcast only when their measured size is under this bound;
    # above it Spark keeps the sort-merge / shuffled-hash plan.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # keep the driver's job / task bookkeeping small in long sessions
    "spark.ui.retainedJobs": "200",
    "spark.ui.retainedStages": "200",
    "spark.ui.retainedTasks": "20000",
    "spark.sql.ui.retainedExecutions": "50",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "ledgerflow") -> SparkSession:
    """Return the active session, or build a local one with ``DEFAULT_CONF``."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("LEDGERFLOW_MASTER", "local[8]"))
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", os.environ.get("LEDGERFLOW_DRIVER_MEM", "16g"))
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    The folder is the one the session names (``spark.checkpoint.dir`` or an earlier
    ``setCheckpointDir``).  A scratch folder is made only for a local master, where driver
    and executors are one process; anywhere else a missing setting is an error, because a
    folder of the driver's own machine would not be seen by the executors.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="ledgerflow-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def sub_checkpoint(spark: SparkSession, name: str) -> str:
    """A named sub-folder of the shared checkpoint folder (streaming state, written tables)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the Arrow operators."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerflow-"), "ledgerflow_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def cut(df):
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lookup(rows, few, on: list[str], how: str = "inner", bound: int = 1 << 16):
    """Join to a grouped table whose keys may be very frequent in ``rows``: a broadcast if
    it is counted to hold at most ``bound`` rows, so that no row moves; else a join keyed by
    a column of its own, which lets AQE split frequent keys."""
    from pyspark.sql import functions as F

    few = cut(few)
    if few.count() <= bound:
        return rows.join(F.broadcast(few), on, how)
    both = [df.withColumn("_join", F.xxhash64(*on)) for df in (rows, few)]
    return both[0].join(both[1], ["_join", *on], how).drop("_join")
