"""A folder that driver and executors share, for snapshots and caches that nobody has named a place for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a local run (one process) gets a temporary folder; on a
    cluster it is an error, as executors wouldn't see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: snapshots need a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tilth-"))
        base = _local[0]
    return f"{base.rstrip('/')}/tilth-{name}-{uuid.uuid4().hex}"
