"""Streams over events: windows with watermarks, deduplication, sessions, and the turn state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import scratch


def events(spark: SparkSession, folder: str) -> DataFrame:
    """A file stream of the events table; its time is made a timestamp, as watermarks ask for."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(stream: DataFrame, late: str = "1 hour", size: str = "2 days", step: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def by_session(stream: DataFrame, late: str = "1 hour", gap: str = "6 hours") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def once(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def turns(stream: DataFrame, key: str = "session_id") -> DataFrame:
    """State by session over (session_id, kind, path): a prompt opens a turn, writes count files, a stop tells whether the
    turn should have left a checkpoint (it wrote and none came). State is dropped after 48 hours without events."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        open_, writes, saved = state.get if state.exists else (False, 0, False)
        out = []
        for kind in pd.concat(list(batches))["kind"]:
            if kind == "prompt":
                open_, writes, saved = True, 0, False
            elif kind == "write":
                writes += 1
            elif kind == "checkpoint":
                saved = True
            elif kind == "stop" and open_:
                out.append((k[0], writes, writes > 0 and not saved))
                open_ = False
        state.update((open_, writes, saved))
        state.setTimeoutDuration(48 * 3600 * 1000)
        yield pd.DataFrame(out, columns=[key, "writes", "block"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, writes int, block boolean", "open boolean, writes int, saved boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def drain(stream: DataFrame, spark: SparkSession, name: str, mode: str = "complete", once: bool = False, conf: dict[str, str] | None = None) -> DataFrame:
    """Run a bounded stream to its end and return the rows of its last batch, which in complete mode are all: each batch is
    written to a folder that all executors share, none is gathered in the driver. once: as one batch, for streams whose state
    has timeouts, as these never run out of batches. conf: settings that hold while it runs."""
    path = scratch.folder(spark, name)
    last: list[int] = []

    def put(batch: DataFrame, at: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")
        last.append(at)

    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(**({"once": True} if once else {"availableNow": True})).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows") if last else spark.createDataFrame([], stream.schema)
