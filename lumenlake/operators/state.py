"""The state store's upkeep: imports of old files, which of them may go, and what goes with what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def legacy_key(prefix: str, payload: Column) -> Column:
    """prefix:SHA-1 of a payload."""
    return F.concat(F.lit(f"{prefix}:"), F.sha1(payload))


def insert_new(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key isn't in old, each key once (the row that is least by its columns)."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti")
    least = F.min(F.struct(*[c for c in new.columns if c != key])).alias("r")
    return fresh.groupBy(key).agg(least).select(key, "r.*").select(*new.columns)


def imported(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """One row: how many keys of new are imported, and how many rows are skipped as there or repeated."""
    marked = new.select(key).groupBy(key).agg(F.count("*").alias("n")).join(old.select(key).distinct().withColumn("old", F.lit(True)), key, "left")
    return marked.agg(F.coalesce(F.sum(F.when(F.col("old").isNull(), 1).otherwise(0)), F.lit(0)).alias("imported"), F.coalesce(F.sum(F.when(F.col("old").isNull(), F.col("n") - 1).otherwise(F.col("n"))), F.lit(0)).alias("skipped"))


def removable_sessions(files: DataFrame, rows: DataFrame) -> DataFrame:
    """files(file, session_id, updated_at; a null session_id: unreadable) with whether they may go, and why: those in rows(session_id, updated_at) no older than the file may."""
    there = rows.select(F.col("session_id").alias("__id"), F.col("updated_at").alias("__at"))
    out = files.join(there, files.session_id == F.col("__id"), "left")
    why = F.when(F.col("session_id").isNull(), "invalid_json").when(F.col("__id").isNull(), "missing_in_store").when(F.col("__at") >= F.coalesce("updated_at", "__at"), "imported_and_not_newer").otherwise("file_is_newer")
    return out.withColumns({"why": why, "eligible": why == "imported_and_not_newer"}).drop("__id", "__at")


def removable_pointer(pointer: DataFrame, active: DataFrame) -> DataFrame:
    """One row: whether the file that names the active session (session_id, updated_at) may go, and why; active: the stored one, one row or none."""
    row = pointer.join(active.select(F.col("session_id").alias("__id"), F.col("updated_at").alias("__at")), F.lit(True), "left")
    same = (F.col("session_id") == F.col("__id")) & (F.col("__at") >= F.coalesce("updated_at", "__at"))
    why = F.when(F.col("session_id").isNull(), "orphaned").when(F.col("__id").isNull(), "none_active").when(same, "matches").otherwise("differs")
    return row.select("session_id", why.alias("why"), (why != "differs").alias("eligible"))


def removable_metrics(entries: DataFrame, stored: DataFrame, bad: DataFrame, key: str = "legacy_key") -> DataFrame:
    """One row: whether a file of entries may go: none of its lines is bad and none of its entries missing."""
    missing = entries.join(stored.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n_missing"))
    row = entries.agg(F.count("*").alias("n_entries")).crossJoin(missing).crossJoin(bad.agg(F.count("*").alias("n_bad")))  # one row each
    why = F.when(F.col("n_bad") > 0, "invalid_lines").when(F.col("n_missing") > 0, "missing_entries").otherwise(F.lit("all_imported"))
    return row.withColumns({"why": why, "eligible": why == "all_imported"})


def compacted(sessions: DataFrame, events: DataFrame, keep_sessions: DataFrame, keep_events: DataFrame, key: str = "session_id", id_: str = "event_id") -> DataFrame:
    """(part, before, deleted, after) of sessions and of events, of which those of deleted sessions go too."""
    kept = keep_events.join(keep_sessions.select(key).distinct(), key, "left_semi")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    rows = n(sessions, "before").crossJoin(n(keep_sessions, "after")).withColumn("part", F.lit("sessions")).unionByName(n(events, "before").crossJoin(n(kept, "after")).withColumn("part", F.lit("events")))
    return rows.select("part", "before", (F.col("before") - F.col("after")).alias("deleted"), "after")


def stale_patterns(patterns: DataFrame, files: DataFrame, as_of: Column, days: int = 30, keys: tuple[str, ...] = ("signature", "intent")) -> tuple[DataFrame, DataFrame]:
    """(patterns, files) without the patterns last seen before the cutoff, and without their files."""
    kept = patterns.where(F.col("last_seen") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    return kept, files.join(kept.select(*keys), list(keys), "left_semi")
