"""Retrieval evaluation: expected against retrieved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


def recall_at(expected: DataFrame, retrieved: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """expected(task, item), retrieved(task, item, rank): share of expected items within rank k; 1 where none are expected."""
    hits = expected.join(retrieved, ["task", "item"], "left")
    return hits.groupBy("task").agg(F.count("*").alias("n_expected"), *((F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall{k}") for k in ks))


def recall_of_ranks(ranked: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """recall_at() where all that is expected was retrieved: ranked(task, item, rank), read once."""
    return ranked.groupBy("task").agg(F.count("*").alias("n_expected"), *((F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall{k}") for k in ks))


def calibration(results: DataFrame) -> DataFrame:
    """results(high boolean, passed boolean): shares of the four combinations."""
    n = F.count("*")
    cell = lambda h, p: F.round(F.count_if((F.col("high") == h) & (F.col("passed") == p)) / n, 4)
    return results.agg(n.alias("n"), cell(True, True).alias("high_pass"), cell(True, False).alias("high_fail"), cell(False, True).alias("low_pass"), cell(False, False).alias("low_fail"))


def summary(results: DataFrame, by: str | None = None) -> DataFrame:
    """Averages and pass rates of results(recall, tokens, latency_ms, passed), of all or by a column, and nearest-rank latencies."""
    keys = [by] if by else []
    means = results.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"))
    late = ranks.percentiles(results, "latency_ms", keys, {"p50": 0.5, "p95": 0.95})
    if not by:
        return means.join(late, F.lit(True), "left")  # one row each
    return means.join(late.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")


#: fixed values: the intent that a kind of task is searched with
INTENT_OF = {"find-definition": "implementation", "debug": "debug", "review": "implementation", "tests": "tests", "refactor": "implementation", "config": "config", "onboard": "explore", "explore": "explore"}


def matched(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(task, expected, rank) of expected(task, path) in retrieved(task, path, rank): a path that ends with the expected one is it.

    Both are met by the end of the last part of the path: whole if the expected path has a folder, else any end of it, which
    each retrieved path has as many of as its name has letters; no path is held against all of its task."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    e = expected.select("task", F.col("path").alias("expected"), name.alias("end"), F.col("path").contains("/").alias("whole"))
    r = retrieved.select("task", F.col("path").alias("got"), "rank", name.alias("name"))
    ends = r.select("task", "got", "rank", F.col("name").alias("end"), F.lit(True).alias("whole"))
    some = r.where("name <> ''").select("task", "got", "rank", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.right("name", n))).alias("end"), F.lit(False).alias("whole"))
    hit = e.join(ends.union(some), ["task", "end", "whole"]).where(F.col("got").endswith(F.col("expected"))).groupBy("task", "expected").agg(F.min("rank").alias("rank"))
    return e.select("task", "expected").join(hit, ["task", "expected"], "left")


def search_quality(expected: DataFrame, retrieved: DataFrame, tasks: DataFrame) -> DataFrame:
    """precision5, precision10 (shares of the expected paths; 1 if none is) and whether the first hit is a wrong one, for each task."""
    m = matched(expected, retrieved)
    share = lambda k: F.count_if(F.col("rank") <= k) / F.count("*")
    by = m.groupBy("task").agg(share(5).alias("precision5"), share(10).alias("precision10"), (F.count_if(F.col("rank") == 1) == 0).alias("missed"))
    any_ = retrieved.select("task").distinct().withColumn("has", F.lit(True))
    out = tasks.select("task").join(by, "task", "left").join(any_, "task", "left")
    return out.select("task", F.coalesce("precision5", F.lit(1.0)).alias("precision5"), F.coalesce("precision10", F.lit(1.0)).alias("precision10"), F.coalesce(F.col("missed") & F.col("has"), F.lit(False)).alias("wrong_first"))


def symbols_found(texts: DataFrame) -> DataFrame:
    """texts(…, symbols, found) with how many of the symbols the extracted text holds."""
    hit = F.filter("symbols", lambda s: F.contains(F.col("found"), s) & ~F.contains(F.col("found"), F.concat(F.lit("Symbol not found: "), s)))
    return texts.withColumns({"symbol_hits": F.size(hit), "symbol_total": F.size("symbols")})


def until_success(reads: DataFrame, most: int = 5) -> DataFrame:
    """(task, reads, tokens, hits, total) of reads(task, rank, tokens, hits, total) in order until one finds all symbols."""
    from pyspark.sql import Window

    w = Window.partitionBy("task").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max((F.col("hits") >= F.col("total")).cast("int")).over(w), F.lit(0))
    return reads.where(F.col("rank") <= most).withColumn("__done", done).where("__done = 0").groupBy("task").agg(F.count("*").alias("reads"), F.sum("tokens").alias("tokens"), F.max("hits").alias("hits"), F.max("total").alias("total"))


def context_quality(items: DataFrame, expected: DataFrame) -> DataFrame:
    """Of each task's context items (task, place, path, role, reason, previews): precision, explained and previewed shares, and the primary file.

    expected: (task, path)."""
    m = matched(expected, items.select("task", "path", F.col("place").alias("rank")))
    hit = m.groupBy("task").agg((F.count("rank") / F.count("*")).alias("precision"))
    named = F.coalesce(F.trim("reason") != "", F.lit(False))
    by = items.groupBy("task").agg(F.count("*").alias("n_items"), F.round(F.count_if(named) / F.count("*"), 3).alias("explained"), F.round(F.count_if(F.col("previews") > 0) / F.count("*"), 3).alias("previewed"), F.min_by("path", F.struct(F.when(F.col("role") == "primary", 0).otherwise(1), "place")).alias("primary"))
    ok = by.select("task", F.col("primary").alias("path"), F.lit(1).alias("rank"))
    primary = matched(expected, ok).groupBy("task").agg((F.count("rank") > 0).alias("primary_hit"))
    return by.join(hit, "task", "left").join(primary, "task", "left").withColumns({"precision": F.coalesce("precision", F.lit(1.0)), "primary_hit": F.coalesce("primary_hit", F.lit(False)), "passed": F.coalesce(F.col("precision") > 0, F.lit(True))})


def passed(precision5: Column, hits: Column, total: Column, context: Column | None = None, mode: str = "search") -> Column:
    """Whether a task is done: half of the files among the first five, and a symbol if some are wanted; by mode the context counts too or alone."""
    search = (precision5 >= 0.5) & ((total == 0) | (hits > 0))
    if mode == "context":
        return F.coalesce(context, F.lit(False))
    return search & F.coalesce(context, F.lit(True)) if mode == "both" else search


def honest(engine: Column, freshness: Column, confidence: Column) -> Column:
    """Whether a search claims no more than it can know: none is sure that walked the files, or whose index is stale."""
    return ~((confidence == "high") & ((engine == "walk") | (freshness == "stale")))


def compared(runs: DataFrame) -> DataFrame:
    """Each run with the one before it of the same mode, else the latest baseline: (run, mode, other, label, delta of each measure).

    runs: (run, mode, at, baseline boolean, score)."""
    from pyspark.sql import Window

    w = Window.partitionBy("mode").orderBy("at", "run")
    own = runs.where("not baseline").withColumns({"other": F.lag("run").over(w), "before": F.lag("score").over(w)})
    base = runs.where("baseline").agg(F.max_by("run", F.struct("at", "run")).alias("b_run"), F.max_by("score", F.struct("at", "run")).alias("b_score"))  # one row
    out = own.crossJoin(F.broadcast(base))
    label = F.when(F.col("other").isNotNull(), "previous").when(F.col("b_run").isNotNull(), "baseline")
    return out.select("run", "mode", F.coalesce("other", "b_run").alias("other"), label.alias("label"), F.round(F.col("score") - F.coalesce("before", "b_score"), 3).alias("delta"))


#: Words of the windows that find where a wanted text stands, and characters of those of texts with fewer words.
WORDS, CHARS = 4, 24


def _runs(text: Column, n: int = WORDS) -> Column:
    """A hash of each run of n words; words are what single spaces part."""
    w = F.split(text, " ")
    shifted = F.arrays_zip(*(F.slice(w, F.lit(i + 1), F.greatest(F.size(w) - n + 1, F.lit(0))).alias(f"w{i}") for i in range(n)))
    return F.transform(shifted, lambda z: F.xxhash64(*(z[f"w{i}"] for i in range(n))))


def containing(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(task, item, want, all of texts) of texts(item, text) that hold a text of wanted(task, want) as it is.

    Of a wanted text the words behind the first are whole wherever it stands: their run is looked for among the runs of
    words of the texts by an equi-join. Wanted texts of few words are found by a window of characters instead. What meets
    is held against each other as a whole."""
    w = wanted.where("want <> ''")
    many = F.size(F.split("want", " ")) >= WORDS + 2
    rows = texts.where("text is not null")
    long = w.where(many).withColumn("key", F.get(_runs(F.col("want")), F.lit(1)))
    runs = rows.select("item", F.explode(F.array_distinct(_runs(F.col("text")))).alias("key"))
    met = runs.join(long, "key").select("task", "item", "want")
    short = w.where(~many).withColumn("size", F.least(F.lit(CHARS), F.length("want"))).withColumn("key", F.xxhash64(F.left("want", F.col("size"))))
    at = rows.crossJoin(F.broadcast(short.select("size").distinct())).where(F.length("text") >= F.col("size"))  # CHARS numbers at most
    chars = at.select("item", "size", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - F.col("size") + 1), lambda i: F.xxhash64(F.substr(F.col("text"), i, F.col("size")))))).alias("key"))
    met = met.union(chars.join(short, ["size", "key"]).select("task", "item", "want"))
    return met.join(texts, "item").where(F.contains("text", F.col("want")))
