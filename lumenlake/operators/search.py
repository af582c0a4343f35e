"""Literal search over lines with ranking by count, place of the match and intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: points by intent for a file below src, source files, configuration, low-signal names and tests
WEIGHTS = {
    "implementation": {"src": 10, "source": 14, "config": 4, "low": -35, "test": -15},
    "debug": {"src": 10, "source": 14, "config": 4, "low": -35, "test": -15},
    "tests": {"src": 5, "source": 10, "config": 0, "low": -35, "test": 10},
    "config": {"src": 0, "source": 0, "config": 14, "low": -20, "test": -15},
    "docs": {"src": 0, "source": 4, "config": 4, "low": -10, "test": -15},
    "explore": {"src": 10, "source": 14, "config": 4, "low": -35, "test": -15},
}
SOURCE = [".js", ".jsx", ".ts", ".tsx", ".py", ".graphql", ".gql", ".sql", ".go", ".rs", ".java", ".sh", ".bash", ".zsh"]
CONFIG = [".json", ".toml", ".yaml", ".yml", ".tf", ".tfvars", ".hcl"]
LOW_SIGNAL = ["changelog", "readme", "migration", "license", "licence", "contributing", "authors", "code_of_conduct", "security", "history"]
TESTS = [".test.", ".spec.", "__tests__", "__mocks__", "fixtures"]
INDEX_BOOST, GRAPH_BOOST = 50, 25


def match_lines(files: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, line_no, line) of lines that hold the query; whole texts are tested before they are cut into lines."""
    hit = files.where(T.smart_case_contains(F.col(text), query)).select(key, F.posexplode(T.lines(F.col(text))).alias("at", "line"))
    return hit.where(T.smart_case_contains(F.col("line"), query)).select(key, (F.col("at") + 1).alias("line_no"), "line")


def parse_match(line: Column) -> Column:
    """file:line:text, as search tools print it, in parts; null for other lines."""
    part = lambda k: F.regexp_extract(line, r"^(.*?):(\d+):(.*)$", k)
    return F.when(part(2) != "", F.struct(part(1).alias("file"), part(2).cast("int").alias("line_no"), part(3).alias("line")))


def grouped(matches: DataFrame, key: str) -> DataFrame:
    """A file's matches, those alike in line and place once."""
    once = matches.withColumn("line", T.strip(F.col("line"))).dropDuplicates([key, "line_no", "line"])
    return once.groupBy(key).agg(F.count("*").alias("n_matches"), F.min("line_no").alias("first_line"))


def _any(text: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(text, p))


def score(count: Column, path: Column, query: str, intent: str | Column = "explore") -> Column:
    """Points of a file of which `count` lines hold the query: its name and folder, and what the intent makes of its kind.

    An unknown intent counts as explore. That the first matches hold the query gives 8 points, as any match does."""
    intent = F.lit(intent) if isinstance(intent, str) else intent
    table = lambda kind: F.create_map(*(F.lit(x) for i, w in WEIGHTS.items() for x in (i, w[kind])))
    weight = lambda kind: F.coalesce(F.try_element_at(table(kind), intent), F.lit(WEIGHTS["explore"][kind]))
    q = query.lower()
    low = F.lower(path)
    name, ext = T.basename(low), T.extension(path)
    when = lambda condition, points: F.when(condition, points).otherwise(0)
    return (
        F.least(count, F.lit(12)) * 6 + 8 + when(F.contains(name, F.lit(q)), 30)
        + when(F.array_contains(F.filter(F.split(low, r"[\\/._-]+"), lambda p: p != ""), F.lit(q)), 16)
        + when(F.contains(low, F.lit("/src/")), weight("src")) + when(F.contains(low, F.lit("/packages/")) | F.contains(low, F.lit("/apps/")), 8)
        + F.when(ext.isin(SOURCE) | T.is_dockerfile(path), weight("source")).when(ext.isin(CONFIG), weight("config")).otherwise(0)
        + when(_any(name, LOW_SIGNAL), weight("low")) + when(_any(low, TESTS), weight("test"))
        - F.least(F.size(F.split(path, "/")), F.lit(12))
    )


def ranked(groups: DataFrame, key: str, k: int = 10) -> DataFrame:
    return groups.orderBy(F.desc("score"), F.desc("n_matches"), key).limit(k)


def search(files: DataFrame, query: str, intent: str = "explore", key: str = "path", text: str = "text", k: int = 10, hits: DataFrame | None = None, related: DataFrame | None = None) -> DataFrame:
    """The k best files for a literal; hits and related: files that define it, and those linked with them."""
    found = grouped(match_lines(files, key, text, query), key)
    found = found.withColumn("score", score(F.col("n_matches"), F.col(key).cast("string"), query, intent))
    if hits is not None:
        found = boosted(found, hits, related if related is not None else hits.limit(0), key)
    return ranked(found, key, k)


def boosted(groups: DataFrame, hits: DataFrame, related: DataFrame, key: str) -> DataFrame:
    """Points for files that define the symbol (index) or touch one that does (graph); boost_source says which."""
    h, r = hits.select(key).distinct().withColumn("__hit", F.lit(True)), related.select(key).distinct().withColumn("__related", F.lit(True))
    out = groups.join(h, key, "left").join(r, key, "left")
    source = F.when(F.col("__hit"), "index").when(F.col("__related"), "graph").otherwise("text")
    return out.withColumn("boost_source", source).withColumn("score", F.col("score") + F.when(F.col("__hit"), INDEX_BOOST).when(F.col("__related"), GRAPH_BOOST).otherwise(0)).drop("__hit", "__related")


def breakdown(top: DataFrame) -> DataFrame:
    """How many of the best files came by the text alone, by the index and by the graph: one row."""
    n = lambda s: F.count_if(F.col("boost_source") == s)
    return top.agg(n("text").alias("text_match"), n("index").alias("index_boost"), n("graph").alias("graph_boost"))


def compact(matches: DataFrame, files: DataFrame, query: str, root: str, key: str = "path") -> DataFrame:
    """One row of text: all matches if there are 20 at most, else the ten best files and samples of five of them.

    files: (key, n_matches, score). What is gathered has 20 lines, or 10 files and 15 lines, at most."""
    order = Window.orderBy(F.desc("score"), F.desc("n_matches"), key)
    total = files.agg(F.sum("n_matches").alias("total"), F.count("*").alias("n_files"))
    top = ranked(files, key).withColumn("place", F.row_number().over(order))  # ten rows
    line = F.concat_ws(":", F.col(key).cast("string"), F.col("line_no").cast("string"), F.col("line"))
    few = matches.join(F.broadcast(ranked(files, key, 20).withColumn("place", F.row_number().over(order))), key)
    few = few.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).where("rn <= 20")
    shown = few.orderBy("place", "line_no").limit(20).agg(F.sort_array(F.collect_list(F.struct("place", "line_no", line.alias("line")))).alias("all"))
    samples = few.where("place <= 5 and rn <= 3").agg(F.sort_array(F.collect_list(F.struct("place", "line_no", line.alias("line")))).alias("some"))
    heads = top.agg(F.sort_array(F.collect_list(F.struct("place", F.concat(F.col("n_matches").cast("string"), F.lit(" match(es), score "), F.col("score").cast("string"), F.lit(" :: "), F.col(key).cast("string")).alias("line")))).alias("heads"))
    row = total.crossJoin(shown).crossJoin(samples).crossJoin(heads)  # one row each
    get = lambda c: F.transform(F.col(c), lambda x: x["line"])
    head = [F.lit(f"query: {query}"), F.lit(f"root: {root}"), F.concat(F.lit("total matches: "), F.col("total").cast("string")), F.concat(F.lit("matched files: "), F.col("n_files").cast("string")), F.lit(""), F.lit("# Top files")]
    long = F.concat(F.array(*head), get("heads"), F.array(F.lit(""), F.lit("# Sample matches")), get("some"))
    return row.select(T.truncate(F.array_join(F.when(F.coalesce(F.col("total"), F.lit(0)) <= 20, get("all")).otherwise(long), "\n"), 5000).alias("text"))


def confidence(passed_over: DataFrame, whole: bool = False) -> DataFrame:
    """One row: how sure a search is of having seen all: high if it read `whole` tables, else medium, or low if any file was passed over.

    passed_over: (reason, n) of files that were not read."""
    n = F.coalesce(F.sum("n"), F.lit(0))
    return passed_over.agg(F.when(F.lit(whole), "high").when(n > 0, "low").otherwise("medium").alias("confidence"), n.cast("long").alias("skipped"))


def best_of_queries(hits: DataFrame, by: list[str], order: list[Column], k: int = 5) -> DataFrame:
    """The k first hits of each query, with their rank from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
