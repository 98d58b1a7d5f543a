"""Session helpers.

On a cluster the session is created by the platform; we only read from it.
``checkpoint_dir`` honours ``spark.checkpoint.dir`` when the cluster sets it
and only falls back to a scratch folder (tests, local runs) when it is unset.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Local mode: the driver JVM is the only executor; 1g (the default) thrashes GC.
    "spark.driver.memory": "8g",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName("rosterline")
    if master:
        builder = builder.master(master)
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_FALLBACK_DIRS: dict[int, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's setting, else a scratch dir.

    The scratch fallback is for ``local`` masters only (tests, local runs): elsewhere
    each executor would write to its own disk, so an unset folder raises.  It is chosen
    once per session and removed when the process ends; if the session refuses a runtime
    change of the setting it is still used directly.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = id(spark.sparkContext)
        if key not in _FALLBACK_DIRS:
            _FALLBACK_DIRS[key] = tempfile.mkdtemp(prefix="rosterline-ckpt-")
            atexit.register(shutil.rmtree, _FALLBACK_DIRS[key], ignore_errors=True)
        d = _FALLBACK_DIRS[key]
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - core configs may be read-only at runtime
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "rosterline", spark.sparkContext.applicationId)


def clean_scratch(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; call it when no frame that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor re-reads files instead of recomputing the
    upstream plan) and lets later branches prune columns on the written copy.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"{tag}-{uuid.uuid4().hex}")
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
