"""A versioned store: each write is a new folder, then a manifest names it; readers pin a version."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

VERSION = 4


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest manifest; None if there is none or its schema version is another."""
    fs, p = _fs(spark, f"{root}/_manifest")
    if not fs.exists(p):
        return None
    # one short line a version, written by write()
    rows = [json.loads(r.value) for r in spark.read.text(f"{root}/_manifest").collect()]
    best = max(rows, key=lambda r: r["version"], default=None)
    return best if best and best["schema"] == VERSION else None


class Conflict(Exception):
    """Another writer has the version that was to follow the one read."""


def _claim(fs, mark) -> bool:
    """Create a mark that isn't there yet; False if it is. Hadoop's local file system looks first and creates then, so two writers could both do so."""
    if fs.getUri().getScheme() == "file":
        try:
            os.close(os.open(mark.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        return fs.createNewFile(mark)
    except Exception:  # another writer was first
        return False


def write(df: DataFrame, root: str, partition_by: list[str] | None = None, after: int | None = None) -> int:
    """Write a new version. The folder of a version is claimed by creating its mark, which only one writer can; another takes the next.

    after: the version that df was made from; if the next one is another writer's, Conflict is raised and nothing written."""
    spark = df.sparkSession
    now = manifest(spark, root) if after is None else None
    version = (after if after is not None else now["version"] if now else 0) + 1
    while True:
        fs, mark = _fs(spark, f"{root}/_claims/v{version}")
        fs.mkdirs(mark.getParent())
        if _claim(fs, mark):
            break
        if after is not None:
            raise Conflict(version)
        version += 1
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{root}/v{version}")
    spark.createDataFrame([(json.dumps({"version": version, "schema": VERSION}),)], "value string").coalesce(1).write.mode("append").text(f"{root}/_manifest")
    return version


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    if version is None:
        now = manifest(spark, root)
        if now is None:
            return None
        version = now["version"]
    return spark.read.parquet(f"{root}/v{version}")


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that are whole, in order."""
    fs, p = _fs(spark, f"{root}/_manifest")
    if not fs.exists(p):
        return []
    return sorted({json.loads(r.value)["version"] for r in spark.read.text(f"{root}/_manifest").collect()})


def set_meta(spark: SparkSession, root: str, tries: int = 60, **values: str) -> int:
    """Put values under keys; the others stay, whoever writes at the same time: a version is made from the one just before it, or made again.

    A writer that died with a version claimed and not finished stops the others after `tries` half seconds with TimeoutError."""
    new = spark.createDataFrame(list(values.items()), "key string, value string")
    for _ in range(tries):
        now = manifest(spark, root)
        version = now["version"] if now else 0
        old = read(spark, root, version) if version else None
        try:
            return write(new if old is None else old.join(new.select("key"), "key", "left_anti").unionByName(new), root, after=version)
        except Conflict:
            time.sleep(0.5)
    raise TimeoutError(f"version {version + 1} of {root} is claimed and was never finished")


def get_meta(spark: SparkSession, root: str, key: str) -> str | None:
    rows = read(spark, root)
    found = rows.where(rows.key == key).head(1) if rows is not None else []
    return found[0].value if found else None
