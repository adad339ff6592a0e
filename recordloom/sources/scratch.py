"""Where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder the cluster names.

    Executors may be lost and replaced on other machines, so a machine-local folder is
    used only by a local session that names no shared one.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="recordloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
