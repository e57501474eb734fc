"""Session helpers: a local session for tests and bench, and the checkpoint folder.

On a cluster the session comes from the platform; nothing here overrides its
settings. Only where ``spark.checkpoint.dir`` is unset (local tests) do we pick
a folder of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


#: A Connect client writes under a folder of its own, so two of them never share a path.
_CONNECT_ID = uuid.uuid4().hex


def _default_driver_memory() -> str:
    """Half of the host's RAM, between 1 and 16 GB (local mode: the driver is the executor)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    gb = max(1, min(16, int(total / 2**30 * 0.5)))
    return f"{gb}g"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "stafflens") -> SparkSession:
    """Local session with AQE on and the UI off (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", os.environ.get("STAFFLENS_CLEAN_CHECKPOINTS", "true"))
        .config("spark.driver.memory", os.environ.get("STAFFLENS_DRIVER_MEMORY", _default_driver_memory()))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; choose one only if none is set.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we read it and
    keep it. Without one, a local master gets a fresh scratch folder, any other
    master a folder under the (shared) warehouse directory.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session: the server owns the folder
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        return f"{shared.rstrip('/')}/stafflens-{_CONNECT_ID}"
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        target = configured
    elif sc.master.startswith("local"):
        target = tempfile.mkdtemp(prefix="stafflens-ckpt-")
    else:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        target = warehouse.rstrip("/") + "/_stafflens_checkpoints"
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Ask Spark's file system to delete ``path`` when the session's JVM ends."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:  # a remote session cannot ask for it
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)


def delete_now(spark: SparkSession, path: str) -> None:
    """Delete ``path`` by Spark's file system."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:  # a remote session cannot ask for it
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
