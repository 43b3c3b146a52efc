"""A new folder for intermediate files, where driver and executors share it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; only where the session names none, in a new local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        named = tempfile.mkdtemp(prefix="ledgerlink-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named}/{name}-{uuid.uuid4().hex}"
