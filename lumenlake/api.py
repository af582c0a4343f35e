"""The engine's tools, each over DataFrames: index, read, search, context, summaries, turns, metrics.

files have path and text (and mtime); an Index is made of them once and handed to the other tools."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import tasks
from .functions import text as T
from .operators import graph, metrics, outline, planning, search, sessions, symbols, turns


@dataclass
class Index:
    """Files that declare or import something, their symbols, links and edges; seen: (path, mtime) of all files that were there;
    scanned: paths that were read for this state of it."""

    files: DataFrame
    symbols: DataFrame
    links: DataFrame
    edges: DataFrame
    seen: DataFrame
    scanned: DataFrame

    @staticmethod
    def read(spark: SparkSession, folder: str) -> "Index":
        return Index(*(spark.read.parquet(f"{folder}/{part.name}") for part in fields(Index)))


def _imports(links: DataFrame) -> DataFrame:
    return links.where("kind = 'import'").select(F.col("path").alias("src"), F.col("name").alias("spec"))


def build_index(files: DataFrame, old: Index | None = None, folder: str | None = None) -> Index:
    """An index of files(path, text, mtime); with an old one only what is new to it is read.

    Files that are new or have another time are scanned, and their symbols and links take the place of the old ones; those of
    files that are gone go. Edges are resolved again for scanned files and for those that a file which came or went may be
    meant by, so the result is that of a build from nothing. Without a time a file counts as unchanged while its path is there.
    folder: each part is written there as it is made and read back (Index.read() gives it again), so that every file is scanned once
    and an index that is brought up to date again and again doesn't hold all it came from."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        if folder is None:
            return df
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.parquet(f"{folder}/{name}")

    stamped = files if "mtime" in files.columns else files.withColumn("mtime", F.lit(0.0))
    seen = keep(stamped.select("path", "mtime"), "seen")
    if old is None:
        found, linked = keep(symbols.with_snippets(symbols.symbols(files), files), "symbols"), keep(symbols.links(files), "links")
        kept = keep(symbols.indexable(files, found, linked), "files")
        return Index(kept, found, linked, keep(graph.edges(_imports(linked), kept.select("path")), "edges"), seen, keep(files.select("path"), "scanned"))
    moved = keep(graph.stale(old.seen, seen), "moved")
    new = files.join(moved.where("state <> 'removed'"), "path", "left_semi")
    stay = lambda df: df.join(moved.select("path"), "path", "left_anti")
    found = keep(symbols.with_snippets(symbols.symbols(new), new), "found")
    linked = keep(symbols.links(new), "linked")
    links = keep(stay(old.links).unionByName(linked), "links")
    kept = keep(stay(old.files).unionByName(symbols.indexable(new, found, linked).select(*old.files.columns)), "files")
    before, now = old.files.select("path").distinct(), kept.select("path").distinct()
    turned = before.join(now, "path", "left_anti").union(now.join(before, "path", "left_anti"))
    again = keep(moved.select("path").union(graph.unsettled(_imports(links), kept, turned)).distinct(), "again")
    only = again.withColumnRenamed("path", "src")
    redone = graph.edges(_imports(links).join(only, "src", "left_semi"), kept.select("path"), kept.join(again, "path", "left_semi"))
    edges = keep(old.edges.join(only, "src", "left_anti").unionByName(redone), "edges")
    return Index(kept, keep(stay(old.symbols).unionByName(found), "symbols"), links, edges, seen, keep(new.select("path"), "scanned"))


def index_counts(index: Index) -> DataFrame:
    """One row: files and symbols of an index."""
    return index.files.agg(F.count("*").alias("n_files")).crossJoin(index.symbols.agg(F.count("*").alias("n_symbols")))


def read(files: DataFrame, mode: str = "outline", max_tokens: int | None = None) -> DataFrame:
    """(path, parser, mode, text, raw_tokens, tokens) of files in a form: whole, outline, signatures."""
    got = outline.read(files, mode, max_tokens).join(files.select("path", T.token_count(F.col("text")).alias("raw_tokens")), "path")
    return got.withColumn("tokens", T.token_count(F.col("text")))


def read_lines(files: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    return files.select("path", T.line_range(F.col("text"), F.lit(start).cast("int"), F.lit(end).cast("int")).alias("text"))


def read_symbols(files: DataFrame, names: list[str], index: Index | None = None) -> DataFrame:
    """(path, found) of the symbols in each file; lines of an index help where a file's format says nothing."""
    rows = files.select("path", symbols.language(F.col("path")).alias("lang"), "text", F.array(*(F.lit(n) for n in names)).alias("names"))
    if index is None:
        return outline.of_symbols(rows.withColumn("hints", F.array(*(F.lit(None).cast("int") for _ in names))))
    of = [F.min(F.when(F.lower("name") == n.lower(), F.col("line"))).alias(f"h{i}") for i, n in enumerate(names)]
    lines = index.symbols.groupBy("path").agg(*of)
    return outline.of_symbols(rows.join(lines, "path", "left").withColumn("hints", F.array(*(F.col(f"h{i}") for i in range(len(names))))))


def read_batch(batches: DataFrame, max_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files read, totals by batch) of batches(batch, place, path, text, mode): in order while they fit the budget, the first in any case.

    Files that can't be read (a null text) cost nothing. Totals: tokens before and after, the share saved, files left out."""
    asked = {r.mode for r in batches.select("mode").distinct().limit(8).collect()}  # three forms are known
    every = batches.sparkSession.createDataFrame([], "path string, mode string, shown string")
    for m in sorted(asked & {"full", "outline", "signatures"}):
        form = outline.read(batches.where(F.col("mode") == m).select("path", "text"), m)
        every = every.unionByName(form.select("path", "mode", F.col("text").alias("shown")))
    every = every.dropDuplicates(["path", "mode"])
    rows = batches.join(every, ["path", "mode"], "left").withColumns({"raw_tokens": T.token_count(F.col("text")), "tokens": T.token_count(F.col("shown"))})
    kept = rows if max_tokens is None else planning.prefix_budget(rows, "batch", [F.col("place")], "tokens", max_tokens)
    n = batches.groupBy("batch").agg(F.count("*").alias("n"))
    by = kept.groupBy("batch").agg(F.count("*").alias("n_read"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("tokens").alias("tokens")).join(n, "batch")
    saved = F.when(F.col("raw_tokens") > 0, F.floor((F.col("raw_tokens") - F.col("tokens")) / F.col("raw_tokens") * 100 + 0.5)).otherwise(0).cast("long")
    return kept.select("batch", "place", "path", "mode", "shown", "tokens"), by.select("batch", "n_read", "raw_tokens", "tokens", saved.alias("saved_pct"), (F.col("n") - F.col("n_read")).alias("skipped"))


def find(files: DataFrame, query: str, intent: str = "explore", index: Index | None = None, k: int = 10) -> DataFrame:
    """The k best files for a literal; an index lifts those that declare it and those linked with them."""
    if index is None:
        return search.search(files, query, intent, k=k)
    hits = index.symbols.where(F.lower("name") == query.lower()).select("path").distinct()
    e = index.edges
    near = e.join(hits.withColumnRenamed("path", "dst"), "dst").select(F.col("src").alias("path")).union(e.where("kind = 'import'").join(hits.withColumnRenamed("path", "src"), "src").select(F.col("dst").alias("path")))
    return search.search(files, query, intent, k=k, hits=hits, related=near.distinct().join(hits, "path", "left_anti"))


def plan_texts(plan: DataFrame, files: DataFrame, max_tokens: int) -> DataFrame:
    """The entries of plans (of any number of tasks) that fit the budget, with the texts of their files, each read once in each form."""
    entry = F.to_json(F.struct(*(c for c in ("rel", "role", "reason", "told", "names", "signatures", "previews") if c in plan.columns)))
    sized = plan.withColumn("base_tokens", T.token_count(entry).cast("long"))
    asked = sized.where("read_text").select("task", "rel", "mode")
    every = plan.sparkSession.createDataFrame([], "path string, mode string, text string")
    for m in ("full", "outline", "signatures"):
        some = files.join(asked.where(F.col("mode") == m).select(F.col("rel").alias("path")).distinct(), "path", "left_semi")
        every = every.unionByName(outline.read(some.select("path", "text"), m).select("path", "mode", "text"))
    texts = asked.join(every.withColumnRenamed("path", "rel"), ["rel", "mode"]).select("task", "rel", "text")
    return planning.with_texts(sized, texts, max_tokens)


def context(files: DataFrame, index: Index, task: str, max_tokens: int = 8000, detail: str = "balanced", changed: DataFrame | None = None, texts: bool = False) -> DataFrame:
    """What to read for a task: the best files of its queries (six at most), what is linked with them, in what form and why.

    changed: paths that a change touched; they are the seeds then, in their order. texts: the texts of files that the plan wants read
    come along, in their forms, as far as the budget of tokens goes."""
    spark = files.sparkSession
    job = spark.createDataFrame([(0, task)], "task int, text string")
    row = job.select(tasks.query_candidates(F.col("text")).alias("q"), T.infer_intent(F.col("text")).alias("i")).first()  # six queries
    schema = "task int, query_at int, query string, rank int, rel string"
    hits = spark.createDataFrame([], schema)
    if changed is not None:
        order = Window.orderBy("path")
        hits = changed.orderBy("path").limit(5).select(F.lit(0).alias("task"), F.lit(0).alias("query_at"), F.lit("").alias("query"), F.row_number().over(order).alias("rank"), F.col("path").alias("rel"))
    else:
        for at, q in enumerate(row.q):
            best = find(files, q, row.i, index, 5)  # five rows
            rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("n_matches"), "path"))
            hits = hits.union(best.select(F.lit(0), F.lit(at), F.lit(q), rank, "path"))
    plan = planning.context(job, hits, index.edges, index.symbols, max_tokens, detail)
    return plan_texts(plan, files, max_tokens) if texts else plan


def report(entries: DataFrame, as_of: Column, window: str = "7d", tool: str | None = None, session: object = None, active: DataFrame | None = None) -> DataFrame:
    """Totals by tool and of all in a window; session 'active' means the one that `active` (one row) names."""
    e = metrics.within(metrics.normalised(entries), window, as_of)
    if tool is not None:
        e = e.where(F.col("tool") == tool)
    if session == "active":
        e = e.join(F.broadcast(active.select("session_id").limit(1)), "session_id", "left_semi")
    elif session is not None:
        e = e.where(F.col("session_id") == session)
    return metrics.report(e)


def full_report(entries: DataFrame, as_of: Column, window: str = "7d", latest: int = 5, **which: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals by tool and of all, overhead by tool, the latest entries) of a window; which: as of report()."""
    e = metrics.within(metrics.normalised(entries), window, as_of)
    costs = e if "overhead_tokens" in e.columns else e.withColumn("overhead_tokens", F.lit(0).cast("long"))
    return report(entries, as_of, window, **which), metrics.overhead(costs), metrics.latest(e, latest)


def turn_start(prompts: DataFrame, found: DataFrame) -> DataFrame:
    """prompts(turn, prompt, session_id) with the state they begin in, whether the session is gone on with, and a focus for a new one.

    found: (session_id, summary, ambiguous)."""
    met = prompts.join(found, "session_id", "left")
    state = sessions.turn_state(F.col("summary").isNotNull(), F.coalesce(F.col("ambiguous"), F.lit(False)), F.col("prompt"), F.col("summary"))
    met = met.withColumn("state", state)
    fresh = F.col("state").isin("cold_start", "mismatch") & turns.meaningful_prompt(F.col("prompt"), True)
    return met.select("turn", "session_id", "state", turns.reuse(F.col("state")).alias("reuse"), F.when(fresh, T.shorten(T.collapse(F.col("prompt")), 120)).alias("goal"))


def turn_end(ended: DataFrame) -> DataFrame:
    """ended(turn, kind, before, after) with the checkpoint that an end of a turn makes, if it is worth one."""
    return ended.withColumn("c", sessions.checkpoint(F.coalesce("kind", F.lit("milestone")), "before", "after")).select("turn", "c.*")
