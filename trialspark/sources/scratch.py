"""Folders for tables that live as long as a query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors see.

    A local session without that setting takes a temporary folder; on a cluster that would
    be a different disk for every executor, so there the setting is required.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="trials-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
