"""Patterns of access: learnt from a log, compared by Jaccard similarity, used to predict files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: patterns that are tried, the least likeness, the bonus of often seen ones, and the days that one is remembered
CANDIDATES, LEAST, BONUS_FROM, BONUS, DECAY_DAYS = 20, 0.6, 3, 0.1, 30


def learn(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns, files) of log(task, intent, accessed_at, path, position, relevance)."""
    rows = log.withColumn("signature", T.task_signature(F.col("task")))
    patterns = rows.groupBy("signature", "intent").agg(F.countDistinct("accessed_at").alias("occurrences"), F.max("accessed_at").alias("last_seen"))
    relevance = F.when(F.coalesce("relevance", F.lit(0.0)) == 0, 1.0).otherwise(F.col("relevance"))
    files = rows.groupBy("signature", "intent", "path").agg(F.min_by("position", F.struct("accessed_at", "position")).alias("access_order"), F.count("*").alias("access_count"), F.avg(relevance).alias("avg_relevance"))
    return patterns, files


def remembered(patterns: DataFrame, as_of: Column | None, days: int = DECAY_DAYS) -> DataFrame:
    """Patterns seen since `days` before as_of; all without a date."""
    return patterns if as_of is None else patterns.where(F.col("last_seen") > as_of - F.expr(f"INTERVAL {days} DAYS"))


def best(patterns: DataFrame, tasks: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(all of tasks, signature, score) of the most similar of the most frequent patterns, if similar enough, for each of
    tasks(task, intent). The intent is tested after the top-k, which has CANDIDATES rows and is handed to all tasks."""
    top = remembered(patterns, as_of).orderBy(F.desc("occurrences"), "signature", "intent").limit(CANDIDATES)
    top = F.broadcast(top.select("signature", F.col("intent").alias("of_intent"), "occurrences"))
    words = F.split(T.task_signature(F.col("task")), " ")
    met = tasks.join(top, F.col("intent") == F.col("of_intent")).where(T.task_signature(F.col("task")) != "")
    score = T.jaccard(F.array_distinct(F.split("signature", " ")), F.array_distinct(words)) + F.when(F.col("occurrences") >= BONUS_FROM, BONUS).otherwise(0.0)
    met = met.withColumn("score", score).where(F.col("score") >= LEAST)
    first = F.row_number().over(Window.partitionBy(*tasks.columns).orderBy(F.desc("score"), F.desc("occurrences"), "signature"))
    return met.withColumn("__rn", first).where("__rn = 1").select(*tasks.columns, "signature", "score")


def predict(patterns: DataFrame, files: DataFrame, tasks: DataFrame, k: int = 8, as_of: Column | None = None) -> DataFrame:
    """(all of tasks, path, avg_relevance, access_count, place) of the k likeliest files of each task."""
    hit = best(patterns, tasks, as_of)
    met = hit.join(files, ["signature", "intent"])
    w = Window.partitionBy(*tasks.columns).orderBy(F.desc("avg_relevance"), F.desc("access_count"), "access_order", "path")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(*tasks.columns, "score", "path", "avg_relevance", "access_count", "place")


def prefetched(seeds: DataFrame, predicted: DataFrame, least: float = LEAST) -> DataFrame:
    """(task, rel, via): the seeds, and the predicted files that aren't among them, of predictions that are sure enough."""
    new = predicted.where(F.col("score") >= least).select("task", F.col("path").alias("rel")).distinct().join(seeds.select("task", "rel"), ["task", "rel"], "left_anti")
    return seeds.select("task", "rel", F.lit("search").alias("via")).union(new.withColumn("via", F.lit("prefetch")))


def similar_pairs(rows: DataFrame, key: str, words: Column, least: float) -> DataFrame:
    """Pairs of sets of words with Jaccard similarity of `least` or more.

    Words are ordered from rare to common; sets that are similar share one of their first words (all but the ceil(least * n)
    - 1 last ones), so only these are joined, and the pairs held against each other in full."""
    w = rows.select(F.col(key).alias("k"), F.array_distinct(words).alias("w")).where(F.size("w") > 0)
    of = w.select("k", F.explode("w").alias("word"))
    rare = of.join(of.groupBy("word").agg(F.count("*").alias("df")), "word")
    sets = rare.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("o")).select("k", F.transform("o", lambda x: x["word"]).alias("w"))
    n = F.size("w")
    first = sets.select("k", n.alias("n"), F.explode(F.slice("w", F.lit(1), (n - F.ceil(F.lit(least) * n) + 1).cast("int"))).alias("word"))
    two = first.withColumnsRenamed({"k": "k2", "n": "n2"})
    pairs = first.join(two, "word").where("k < k2 and least(n, n2) >= %r * greatest(n, n2)" % least).select("k", "k2").distinct()
    met = pairs.join(sets.withColumnRenamed("w", "a"), "k").join(sets.select(F.col("k").alias("k2"), F.col("w").alias("b")), "k2")
    return met.select("k", "k2", T.jaccard(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= least)
