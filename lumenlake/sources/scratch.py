"""Folders for tables that operators write on their way, where all executors can read them."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone when the interpreter ends
        pass


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, removed when the interpreter ends.

    Without that setting only a session on one machine gets one of its own; a cluster's would lie where others can't read."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/lumenlake-scratch"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path
