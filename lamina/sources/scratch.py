"""A folder that driver and executors share, for queries that write files and read them back."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one
    process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lamina-records-")
    if "://" in at.replace("file://", "", 1):
        raise ValueError(f"record files need a mounted file system, not {at}")
    path = os.path.join(at.removeprefix("file://"), f"records-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path
