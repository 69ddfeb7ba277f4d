"""Session helpers.

Library code never creates a session on its own; it only reads settings
from the one it is given.  ``local_session`` is for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators rely on.  They are applied by ``local_session`` and
# can be applied to an existing cluster session with ``apply_defaults``.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Parquet scans: keep files splittable into ~128 MiB tasks.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}

# Streaming state (one row per meter / per user) lives in RocksDB, off the
# JVM heap.  Set at session start: a running query keeps the provider it
# was started with.
STREAMING_DEFAULTS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Spark's own default: state on the executor heap.
_HEAP_STATE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the defaults above on ``spark`` where the cluster left them unset."""
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    for key, value in STREAMING_DEFAULTS.items():
        if spark.conf.get(key, None) in (None, "", _HEAP_STATE):
            spark.conf.set(key, value)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage; it is only set
    here (to a fresh local folder) when it is missing, which is the case in
    local tests.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "")
    if not path and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    if not path:
        path = tempfile.mkdtemp(prefix="gridwatch-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    try:  # classic sessions: let DataFrame.checkpoint() use the same folder
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
    except Exception:  # noqa: BLE001 - no SparkContext handle (remote session)
        pass
    return path


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "gridwatch") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("GRIDWATCH_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # remove checkpointed relations once no DataFrame refers to them
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in {**DEFAULTS, **STREAMING_DEFAULTS}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``gridwatch`` importable in the Python workers (``addPyFile`` of a
    zip of this package, as ``--py-files`` would), for the operators that run
    Python inside tasks.  Once per application; a no-op where the session
    exposes no SparkContext."""
    key = spark.conf.get("spark.app.id", "")
    if key in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    # the zip only needs to exist on the driver: Spark serves it to the
    # executors, exactly as it does for --py-files
    path = os.path.join(tempfile.mkdtemp(prefix="gridwatch-pyfiles-"), "gridwatch.zip")
    with zipfile.ZipFile(path, "w") as zf:
        for root, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    try:
        spark.sparkContext.addPyFile(path)
    except Exception:  # noqa: BLE001 - remote session: install the package on the cluster instead
        return
    _SHIPPED.add(key)
