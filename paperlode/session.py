"""Session defaults and the shared folder for tables that outlive one stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

_local_folders: list[tempfile.TemporaryDirectory] = []


def build_session(app_name: str = "paperlode", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's `spark.checkpoint.dir`.

    Every executor must reach the folder, so a machine-local one is made only when the
    setting is absent and the session runs in local mode; it goes when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        made = tempfile.TemporaryDirectory(prefix="paperlode-", ignore_cleanup_errors=True)
        _local_folders.append(made)  # removed when the process ends
        base = made.name
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    """How many ordered blocks a distributed scan uses: the session's shuffle partitions."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
