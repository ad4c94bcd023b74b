"""Spark session helpers.

The library never builds its own cluster session: jobs receive the
session they run in. ``local_session`` exists for tests, the bench and
``__spark_entry__``; it only sets what is unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # bytes that could be scanned while a file is opened: 27 detectors read far less than the
    # 4 MB that Spark assumes, and no split is made smaller than this
    "spark.sql.files.openCostInBytes": "262144",
    # likewise a shuffled megabyte of texts is a second of scanning, not a task too small to keep
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "leakscan") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("LEAKSCAN_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is
    used as is; without it the call fails, as no machine-local folder is
    shared. Only in local mode (tests) a fresh local folder is made.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not _one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="leakscan-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for derived tables
    (callers make ``name`` unique)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``leakscan`` importable in Python workers (pandas engine): zip
    the package into the shared checkpoint folder once per session and
    add it with ``addPyFile``."""
    import os
    import uuid
    import zipfile
    key = id(spark.sparkContext)
    if key in _SHIPPED:
        return
    import tempfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    target = scratch_path(spark, f"pyfiles-{uuid.uuid4().hex}")
    if not target.startswith("file:") and ("://" in target or not _one_machine(spark)):
        # addPyFile reads a driver-side file and serves it to the executors; without a
        # scheme the folder lies in the cluster's default file system
        local = tempfile.mkdtemp(prefix="leakscan-pyfiles-")
    else:
        local = target[len("file:"):] if target.startswith("file:") else target
    os.makedirs(local, exist_ok=True)
    zpath = os.path.join(local, "leakscan.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("leakscan", os.path.relpath(full, pkg)))
    spark.sparkContext.addPyFile(zpath)
    _SHIPPED.add(key)
