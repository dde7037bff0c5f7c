"""The shared folder of a job: where checkpoints and scratch tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only where none is set."""
    configured = spark.sparkContext.getConf().get(_SETTING)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder all executors share")
    return tempfile.mkdtemp(prefix="plumbline-")


def use_checkpoints(spark: SparkSession) -> None:
    """Make sure checkpoint() has a folder, keeping the one already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
