"""Inverted index and dependency graph over files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: what an import may leave out, in order, and where what a test tests may lie
EXTENSIONS = ["", ".js", ".ts", ".tsx", ".jsx", ".mjs", ".cjs", "/index.js", "/index.ts", "/index.tsx", "/index.jsx"]
SOURCES = [".js", ".ts", ".tsx", ".jsx", ".py", ".go", ".rs", ".java", ".cs", ".kt", ".php", ".swift"]
SIBLINGS = ["src", "lib", "pkg"]
TEST_END = r"\.(?:test|spec)\.[^.]+$|Tests?\.(cs|kt|swift)$|_test\.(cs|kt)$|Test\.php$"


#: Postings that a task gathers before it sends them on by name
GATHERED = 1_000_000


def inverted_index(docs: DataFrame) -> DataFrame:
    """(name, path, n) of docs(path, names): each distinct pair of a name and a path that has it, with the number of paths of the name.

    Paths travel in lists, one for each name and million postings, so a posting costs the shuffle little more than its path, and a common
    name is many lists and never one. That pairs are distinct follows from paths being so; rows of paths that come again are united first."""
    again = docs.groupBy("path").count().where("count > 1").select("path")
    if not again.isEmpty():
        same = docs["path"].eqNullSafe(again["path"])
        united = docs.join(again, same, "left_semi").select("path", F.explode("names").alias("name")).distinct().groupBy("path").agg(F.collect_list("name").alias("names"))
        docs = docs.join(again, same, "left_anti").unionByName(united)
    kind = docs.schema["path"].dataType.simpleString()

    def folded(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        lists = pa.concat_tables(held).group_by("name").aggregate([("path", "list")])
        yield from lists.select(["name", "path_list"]).rename_columns(["name", "paths"]).to_batches()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            names = b.column("names")
            held.append(pa.table({"name": pc.list_flatten(names), "path": b.column("path").take(pc.list_parent_indices(names))}))
            n += held[-1].num_rows
            if n >= GATHERED:
                yield from folded(held)
                held, n = [], 0
        if n:
            yield from folded(held)

    lists = docs.select("path", F.array_distinct(F.filter("names", lambda x: x.isNotNull())).alias("names")).mapInArrow(gathered, f"name string, paths array<{kind}>")
    counted = lists.withColumn("n", F.sum(F.size("paths")).over(Window.partitionBy("name")))
    return counted.select("name", F.explode("paths").alias("path"), "n")


def import_tries(imports: DataFrame) -> DataFrame:
    """(src, spec, rank, dst): the paths that each relative specifier of imports(src, spec) may mean, the first best."""
    base = F.regexp_replace("src", "[^/]*$", "")
    joined = F.concat(base, F.col("spec"))
    # a/./b is a/b, and a/x/../b is a/b: steps up are taken out one by one
    path = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), lambda s, p: F.when(p.isin(".", ""), s).when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))), lambda s: F.array_join(s, "/"))
    return imports.where("spec like '.%'").withColumn("stem", path).select("src", "spec", F.posexplode(F.transform(F.array(*(F.lit(e) for e in EXTENSIONS)), lambda e: F.concat("stem", e))).alias("rank", "dst"))


def resolve_imports(imports: DataFrame, known: DataFrame) -> DataFrame:
    """Edges (src, dst) of imports(src, spec): relative specifiers only; the first known candidate holds."""
    hit = import_tries(imports).join(known.select(F.col("path").alias("dst")).distinct(), "dst")
    return hit.groupBy("src", "spec").agg(F.min_by("dst", "rank").alias("dst"))


def target_tries(tests: DataFrame) -> DataFrame:
    """(src, rank, dst): where a source of the name of each test file (path) may lie."""
    path = F.col("path")
    folder = T.dirname(path)
    above = T.dirname(folder)
    base = F.regexp_replace(T.basename(path), TEST_END, "")
    here = F.when(folder == ".", F.lit("")).otherwise(F.concat(folder, F.lit("/")))
    up = F.when(above == ".", F.lit("")).otherwise(F.concat(above, F.lit("/")))
    parts = tests.select(path.alias("src"), F.concat(here, base).alias("beside"), up.alias("up"), base.alias("base"))
    ends = F.array(*(F.lit(e) for e in SOURCES))
    # lambdas over short lists keep the generated code small
    near = F.transform(ends, lambda e: F.concat(F.col("beside"), e))
    far = F.flatten(F.transform(F.array(*(F.lit(d) for d in SIBLINGS)), lambda s: F.transform(ends, lambda e: F.concat(F.col("up"), s, F.lit("/"), F.col("base"), e))))
    return parts.select("src", F.posexplode(F.concat(near, far)).alias("rank", "dst"))


def infer_targets(tests: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst) of what test files (path) test: a source of their name beside them, else in a src, lib or pkg beside their folder."""
    hit = target_tries(tests).join(known.select(F.col("path").alias("dst")).distinct(), "dst")
    return hit.groupBy("src").agg(F.min_by("dst", "rank").alias("dst"))


def edges(imports: DataFrame, known: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind) of a corpus: resolved imports; a test's are of what it tests too, and one without any is held against names.

    tests: paths among which test files are looked for, if not all of known."""
    found = resolve_imports(imports, known).select("src", "dst")
    test = T.is_test_path(F.col("src"))
    of_tests = found.where(test).select("src", "dst", F.lit("testOf").alias("kind"))
    rest = (known if tests is None else tests).select("path").where(T.is_test_path(F.col("path"))).join(of_tests.select(F.col("src").alias("path")).distinct(), "path", "left_anti")
    return found.withColumn("kind", F.lit("import")).union(of_tests).union(infer_targets(rest, known).withColumn("kind", F.lit("testOf")))


def unsettled(imports: DataFrame, known: DataFrame, moved: DataFrame) -> DataFrame:
    """Paths whose edges may be others now that files (path) of `moved` came or went: importers that one of them may be meant by, and tests that may be of one."""
    at = moved.select(F.col("path").alias("dst")).distinct()
    tests = known.select("path").where(T.is_test_path(F.col("path")))
    met = import_tries(imports).select("src", "dst").union(target_tries(tests).select("src", "dst")).join(at, "dst", "left_semi")
    return met.select(F.col("src").alias("path")).distinct()


def lookup(index: DataFrame, names: DataFrame) -> DataFrame:
    """Postings (name, path, line, kind) of names whatever their case; index: symbols, one row each."""
    wanted = names.select(F.lower("name").alias("low")).distinct()
    return index.withColumn("low", F.lower("name")).join(wanted, "low").select("name", "path", "line", "kind")


def related(edges: DataFrame, path: str, files: DataFrame | None = None) -> DataFrame:
    """(path, relation) of what a file imports, what imports it, what tests it, and its neighbours in its folder."""
    out = edges.where((F.col("src") == path) & (F.col("kind") == "import")).select(F.col("dst").alias("path"), F.lit("imports").alias("relation"))
    inn = edges.where(F.col("dst") == path).select(F.col("src").alias("path"), F.when(F.col("kind") == "testOf", "tests").otherwise("importedBy").alias("relation"))
    found = out.union(inn).distinct()
    if files is not None:
        near = files.where((T.dirname(F.col("path")) == T.dirname(F.lit(path))) & (F.col("path") != path)).select("path", F.lit("neighbors").alias("relation"))
        found = found.union(near.distinct())
    return found


def type_references(text: DataFrame, index: DataFrame) -> DataFrame:
    """(path, name, at) of the type names in texts(path, text) that the index declares: in the same file if it can be, else in the first one."""
    names = text.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9_]+"), 0))).alias("name"))
    # a name that many files declare and many name meets its first file and the file itself, never all of them
    there = index.select("name", "path").where("name is not null and path is not null").distinct()
    least = there.groupBy("name").agg(F.min("path").alias("least"))
    hit = names.distinct().join(there.withColumn("own", F.lit(True)), ["name", "path"], "left").join(least, "name")
    return hit.select("path", "name", F.when(F.col("own"), F.col("path")).otherwise(F.col("least")).alias("at"))


def symbol_context(symbols: DataFrame, edges: DataFrame, files: DataFrame, importers: int = 5, tests: int = 3, lines: int = 3) -> DataFrame:
    """(name, path, relation, other, line_no, line): where the importers and tests of a symbol's file mention it.

    symbols: (name, path). Of each symbol five importers, three tests and three lines of each at most: what is shown."""
    kinds = edges.select(F.col("dst").alias("path"), F.col("src").alias("other"), F.when(F.col("kind") == "testOf", "test").otherwise("importer").alias("relation")).distinct()
    met = symbols.select("name", "path").distinct().join(kinds, "path")
    w = Window.partitionBy("name", "path", "relation").orderBy("other")
    few = met.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.when(F.col("relation") == "test", tests).otherwise(importers)).drop("rn")
    text = few.join(files.select(F.col("path").alias("other"), "text"), "other").where(F.expr("contains(text, name)"))
    line = text.select("name", "path", "relation", "other", F.posexplode(T.lines(F.col("text"))).alias("at", "line")).where(F.expr("contains(line, name)")).withColumn("line_no", F.col("at") + 1)
    w = Window.partitionBy("name", "path", "relation", "other").orderBy("line_no")
    return line.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= lines).select("name", "path", "relation", "other", "line_no", F.trim("line").alias("line"))


#: Lines from a symbol's on in which types that are named belong to it
NEAR_LINES = 30


def types_near(symbols: DataFrame, files: DataFrame, index: DataFrame, lines: int = NEAR_LINES) -> DataFrame:
    """(path, symbol, name, at, line) of the types that the index declares and that are named within `lines` lines from a symbol's on: each once, where it is named first.

    symbols: (path, name, line); files: (path, text); index: (path, name, line). Symbols and names meet in stretches of `lines` lines, of which
    a symbol's lie in two, so a long file with many of both is no single group. at: the file itself if it declares the type, else the first that does."""
    wanted = index.select(F.col("name").alias("type"), F.col("path").alias("at")).where(F.col("type").rlike("^[A-Z][A-Za-z0-9_]+$")).distinct()
    asked = symbols.select("path", F.col("name").alias("symbol"), F.col("line").alias("from")).distinct()
    first = F.floor(F.col("from") / lines)
    asked = asked.withColumn("stretch", F.explode(F.array(first, first + 1)))
    text = files.select("path", "text").join(symbols.select("path").distinct(), "path", "left_semi")
    row = text.select("path", F.posexplode(T.lines(F.col("text"))).alias("place", "said"))
    named = row.select("path", (F.col("place") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("said", F.lit(r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9_]+"), 0))).alias("type"))
    named = named.join(wanted.select("type").distinct(), "type", "left_semi").withColumn("stretch", F.floor(F.col("line") / lines))
    met = named.join(asked, ["path", "stretch"]).where((F.col("line") >= F.col("from")) & (F.col("line") < F.col("from") + lines) & (F.col("type") != F.col("symbol")))
    seen = met.groupBy("path", "symbol", "type").agg(F.min("line").alias("line"))
    # where a type is declared: by all files that do, the least path, and by the file itself
    least = wanted.groupBy("type").agg(F.min("at").alias("least"))
    own = wanted.select("type", F.col("at").alias("path"), F.lit(True).alias("own"))
    out = seen.join(least, "type").join(own, ["type", "path"], "left")
    return out.select("path", "symbol", F.col("type").alias("name"), F.when(F.col("own"), F.col("path")).otherwise(F.col("least")).alias("at"), "line")


def stale(index: DataFrame, disk: DataFrame) -> DataFrame:
    """Paths on disk that are missing from the index or have another time, and indexed paths that are gone."""
    both = index.select("path", F.col("mtime").alias("old")).join(disk.select("path", F.col("mtime").alias("new")), "path", "full_outer")
    state = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.floor("old") != F.floor("new"), "changed")
    return both.withColumn("state", state).where("state is not null").select("path", "state")
