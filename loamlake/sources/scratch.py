"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder where the session keeps its checkpoints, which the driver and all executors share.

    Only a local session that names none gets a folder of the machine.
    """
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="loamlake-scratch-")
    return f"{root}/scratch-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
