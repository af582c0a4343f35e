"""Roll-ups of usage metrics: totals by tool, windows, latest entries, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOWS = {"24h": "INTERVAL 24 HOURS", "7d": "INTERVAL 7 DAYS", "30d": "INTERVAL 30 DAYS"}


def percent(saved: Column, raw: Column) -> Column:
    return F.when(raw > 0, F.round(saved / raw * 100, 2)).otherwise(F.lit(0.0))


def normalised(entries: DataFrame) -> DataFrame:
    """Defaults of missing fields; savings are clamped at zero row by row."""
    compressed = F.coalesce("compressed_tokens", "final_tokens", F.lit(0)).cast("long")
    raw = F.coalesce("raw_tokens", F.lit(0)).cast("long")
    return entries.withColumns({"tool": F.coalesce("tool", F.lit("unknown")), "raw_tokens": raw, "compressed_tokens": compressed, "saved_tokens": F.coalesce(F.col("saved_tokens").cast("long"), F.greatest(raw - compressed, F.lit(0)))})


#: columns of an entry that have a place of their own; all others go to its metadata
OWN = ["metric_id", "tool", "action", "target", "session_id", "created_at", "raw_tokens", "compressed_tokens", "final_tokens", "saved_tokens", "savings_pct", "latency_ms", "metadata"]


def stored(entries: DataFrame) -> DataFrame:
    """Entries as they are kept: defaults and savings of normalised(), the percentage worked out (one that was given holds where
    there are no raw tokens), and every other column in the JSON of the metadata, beside what is there."""
    names = entries.columns
    rest = [c for c in names if c not in OWN]
    given = F.col("savings_pct").cast("double") if "savings_pct" in names else F.lit(None).cast("double")
    out = normalised(entries)
    pct = F.when(F.col("raw_tokens") > 0, F.round(F.col("saved_tokens") / F.col("raw_tokens") * 100, 2)).otherwise(F.coalesce(given, F.lit(0.0)))
    had = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")) if "metadata" in names else F.create_map().cast("map<string,string>")
    own = F.create_map(*(x for c in rest for x in (F.lit(c), F.col(c).cast("string")))) if rest else F.create_map().cast("map<string,string>")
    fresh = F.map_filter(own, lambda k, v: v.isNotNull())
    metadata = F.to_json(F.map_concat(F.map_filter(had, lambda k, v: ~F.map_contains_key(fresh, k)), fresh))
    return out.withColumns({"savings_pct": pct, "metadata": metadata}).drop(*rest)


def _measures() -> list[Column]:
    return [F.count("*").alias("n"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"), F.sum("saved_tokens").alias("saved_tokens"), percent(F.sum("saved_tokens"), F.sum("raw_tokens")).alias("savings_pct")]


def by_tool(entries: DataFrame) -> DataFrame:
    return entries.groupBy("tool").agg(*_measures())


def report(entries: DataFrame) -> DataFrame:
    """By tool, and the grand total in the row whose tool is null: one pass."""
    return entries.rollup("tool").agg(*_measures())


def overhead(entries: DataFrame, tokens: str = "overhead_tokens") -> DataFrame:
    """(tool, n, overhead_tokens, overhead_pct) of entries that cost tokens beside what they save: pct of the raw tokens of all entries."""
    raw = entries.agg(F.sum("raw_tokens").alias("__raw"))  # one row
    by = entries.where(F.col(tokens) > 0).groupBy("tool").agg(F.count("*").alias("n"), F.sum(tokens).cast("long").alias("overhead_tokens"))
    return by.crossJoin(F.broadcast(raw)).select("tool", "n", "overhead_tokens", percent(F.col("overhead_tokens"), F.col("__raw")).alias("overhead_pct"))


def within(entries: DataFrame, window: str, as_of: Column, ts: str = "created_at") -> DataFrame:
    """Entries of the last 24h, 7d or 30d before as_of, or all; an unknown window counts as 7d."""
    return entries if window == "all" else entries.where(F.col(ts) >= as_of - F.expr(WINDOWS.get(window, WINDOWS["7d"])))


def latest(entries: DataFrame, n: int, ts: str = "created_at", key: str = "metric_id") -> DataFrame:
    return entries.orderBy(F.date_trunc("SECOND", ts).desc(), F.col(key).desc()).limit(n)


def percentile(x: str, p: float) -> Column:
    """Nearest rank."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})")


def of_texts(raw: Column, final: Column) -> Column:
    """The measures of a text that was made shorter, from its tokens before and after: never less than nothing saved."""
    saved = F.greatest(raw - final, F.lit(0))
    return F.struct(raw.alias("raw_tokens"), final.alias("final_tokens"), final.alias("compressed_tokens"), saved.alias("saved_tokens"), percent(saved, raw).alias("savings_pct"))
