"""Where operators and pipelines write what their steps hand on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine in local mode (as in tests), and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_folder(spark: SparkSession) -> str:
    """A new folder under it."""
    return f"{checkpoint_folder(spark).rstrip('/')}/stages-{uuid.uuid4().hex}"
