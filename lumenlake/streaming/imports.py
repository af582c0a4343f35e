"""Imports that count once: old state files as a stream, whatever is sent again.

A batch writes its rows under its own name and then a line in a ledger; only what the ledger names is read. So a batch that broke off
is written over, one that is there already is left out, and rows that come again in another batch are told by their keys. Metrics
are new by the hash of what they say, sessions are written each time (the newest holds), and a pointer to the active session counts if
that session is there. Late rows are imported like any, and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sessions as S
from ..operators import state
from ..sources import scratch

SCHEMAS = {
    "metrics": "key string, payload string, ts timestamp", "sessions": "session_id string, updated_at timestamp, payload string", "active": "session_id string, ts timestamp",
    "ledger": "kind string, imported long, skipped long, late long, newest timestamp",
}


def stored(spark: SparkSession, root: str, part: str) -> DataFrame:
    """Rows of a part with their batch, of batches that the ledger names (the ledger: all)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{part}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], f"{SCHEMAS[part]}, batch string")
    rows = spark.read.schema(f"{SCHEMAS[part]}, batch string").option("basePath", f"{root}/{part}").parquet(f"{root}/{part}")
    return rows if part == "ledger" else rows.join(stored(spark, root, "ledger").select("batch").distinct(), "batch", "left_semi")


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions as last updated; of equal times the greatest payload."""
    return S.latest_by_key(stored(spark, root, "sessions"), "session_id", [F.desc("updated_at"), F.desc("payload"), F.desc("batch")])


def metrics(spark: SparkSession, root: str) -> DataFrame:
    return stored(spark, root, "metrics")


def active(spark: SparkSession, root: str) -> DataFrame:
    """One row: the session that was named last."""
    return stored(spark, root, "active").agg(F.max_by("session_id", F.struct("ts", "session_id")).alias("session_id"))


def import_batch(rows: DataFrame, batch: str, root: str, late: str = "1 hour") -> bool:
    """Import rows(kind session, metric or active, payload JSON, ts) under a batch's name; False if the ledger has it."""
    spark = rows.sparkSession
    ledger = stored(spark, root, "ledger")
    if ledger.where(F.col("batch") == batch).head(1):
        return False
    put = lambda df, part: df.write.mode("overwrite").parquet(f"{root}/{part}/batch={batch}")
    of = lambda kind: rows.where(F.col("kind") == kind)
    id_ = F.get_json_object("payload", "$.sessionId").alias("session_id")
    new = of("metric").where(F.get_json_object("payload", "$").isNotNull()).select(state.legacy_key("metric", F.col("payload")).alias("key"), "payload", "ts")
    put(state.insert_new(new, stored(spark, root, "metrics"), "key"), "metrics")
    put(of("session").select(id_, F.get_json_object("payload", "$.updatedAt").try_cast("timestamp").alias("updated_at"), "payload").where("session_id is not null"), "sessions")
    own = lambda part: spark.read.schema(SCHEMAS[part]).parquet(f"{root}/{part}/batch={batch}")
    there = stored(spark, root, "sessions").select("session_id").union(own("sessions").select("session_id")).distinct()
    put(of("active").select(id_, "ts").join(there, "session_id", "left_semi"), "active")
    before = ledger.agg(F.max("newest").alias("before"))
    seen = rows.crossJoin(F.broadcast(before)).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("ts") < F.col("before") - F.expr(f"INTERVAL {late}")).alias("late"), F.max("ts").alias("newest"))
    done = [own(part).agg(F.lit(kind).alias("kind"), F.count("*").alias("imported")) for kind, part in (("metric", "metrics"), ("session", "sessions"), ("active", "active"))]
    lines = done[0].union(done[1]).union(done[2]).join(seen, "kind", "left")
    n = F.coalesce("n", F.lit(0))
    put(lines.select("kind", "imported", (n - F.col("imported")).alias("skipped"), F.coalesce("late", F.lit(0)).alias("late"), "newest"), "ledger")
    return True


def import_stream(stream: DataFrame, root: str, source: str, late: str = "1 hour", checkpoint: str | None = None) -> StreamingQuery:
    """A started query that imports a stream of rows batch by batch. A batch is named by its source and number, so a source that
    is read again from its start changes nothing."""
    at = checkpoint or scratch.folder(stream.sparkSession, f"import-{source}")

    def put(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        import_batch(rows, f"{source}-{number}", root, late)
        rows.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", at).trigger(availableNow=True).start()
