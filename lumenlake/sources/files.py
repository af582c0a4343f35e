"""Sources: folders of files, JSON lines of metrics, session documents, task corpora, lists of changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: what is walked for the index and for searches, and limits
IGNORED = ["node_modules", ".git", ".next", "dist", "build", "coverage", ".venv", "venv", "__pycache__", ".terraform"]
IGNORED_BY_INDEX = [*IGNORED, ".lumenlake"]
CODE = ["js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "go", "rs", "java", "cs", "kt", "php", "swift"]
SEARCHED = ["js", "jsx", "ts", "tsx", "json", "mjs", "cjs", "py", "toml", "yaml", "yml", "md", "graphql", "gql", "sql", "go", "rs", "java", "sh", "bash", "zsh", "tf", "tfvars", "hcl"]
LOCKS = ["pnpm-lock.yaml", "package-lock.json", "yarn.lock", "bun.lockb", "npm-shrinkwrap.json"]
MOST_BYTES, MOST_SEARCHED, PROBE = 512 * 1024, 1024 * 1024, 8192
MOST_METRICS, KEPT_LINES = 1024 * 1024, 500
ENTRY = "tool string, action string, target string, sessionId string, rawTokens long, compressedTokens long, finalTokens long, savedTokens long, savingsPct double, latencyMs long, timestamp string, metadata string"
SESSION = "sessionId string, goal string, status string, nextStep string, completed array<string>, decisions array<string>, touchedFiles array<string>, updatedAt string, _corrupt_record string"


def is_binary(content: Column) -> Column:
    """A byte from 0 to 6 within the first 8192: seen in the hexadecimal form, two digits a byte."""
    return F.hex(F.substring(content, 1, PROBE)).rlike("^(..)*0[0-6]")


def inside(path: str, root: str) -> str:
    """path below root, made plain; an error if it leads out of it."""
    import posixpath

    base = posixpath.normpath(root)
    full = posixpath.normpath(posixpath.join(base, path))
    if full != base and not full.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"{path} leads out of {root}")
    return full


def below(root: str) -> Column:
    """The path of a file below root."""
    cut = F.length(F.lit(root.rstrip("/"))) + 1
    plain = F.regexp_replace(F.col("path"), "^file:/+", "/")
    return F.substring(plain, cut + 1, F.length(plain)) if root.startswith("/") else F.col("path")


def _walk(spark: SparkSession, root: str, ignored: list[str], wanted: Column, most: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("path", below(root))
    skip = F.col("path").rlike("(^|/)(" + "|".join(x.replace(".", r"\.") for x in ignored) + ")/")
    return files.where(wanted & ~skip & (F.col("length") <= most) & ~is_binary(F.col("content"))).select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))


def corpus(spark: SparkSession, root: str, extensions: list[str] | None = None, most: int = MOST_BYTES) -> DataFrame:
    """path, mtime, text of the source files below root that an index is made of; symbols.indexable() drops those without any entry."""
    return _walk(spark, root, IGNORED_BY_INDEX, F.col("path").rlike(rf"(?i)\.({'|'.join(extensions or CODE)})$"), most)


def searched(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, text of the files below root that are searched: more kinds, Dockerfiles, larger ones; no lock files."""
    wanted = (F.col("path").rlike(rf"\.({'|'.join(SEARCHED)})$") | T.is_dockerfile(F.col("path"))) & ~T.basename(F.col("path")).isin(LOCKS)
    return _walk(spark, root, IGNORED, wanted, MOST_SEARCHED)


def passed_over(spark: SparkSession, root: str, most: int = MOST_SEARCHED) -> DataFrame:
    """(reason, n) of the files below root that a search doesn't read though their kind is wanted: too large, or binary; those of ignored folders don't count."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("path", below(root))
    skip = F.col("path").rlike("(^|/)(" + "|".join(x.replace(".", r"\.") for x in IGNORED) + ")/")
    wanted = F.col("path").rlike(rf"\.({'|'.join(SEARCHED)})$") & ~T.basename(F.col("path")).isin(LOCKS)
    why = F.when(F.col("length") > most, "too large").when(is_binary(F.col("content")), "binary")
    return every.where(wanted & ~skip).select(why.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def one_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    """path, mtime, text of one file below root; an error if the path leads out of it."""
    full = inside(path, root)
    return spark.read.format("binaryFile").load(full).select(F.lit(path).alias("path"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))


def metric_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, bad lines) of JSON lines; lines are counted by file, after blank ones are left out.

    Lines are rows from the start; their numbers come from counts of the lines before them by file and part of it."""
    raw = spark.read.text(path).select(T.strip(F.col("value")).alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("id", F.monotonically_increasing_id())
    lines = raw.where("line <> ''")
    from pyspark.sql import Window

    # one row for each part of a file: its lines are numbered within it, behind those of the parts before
    parts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("id"))
    parsed = lines.withColumn("own", own).join(before, ["file", "block"]).withColumn("at", (F.col("before") + F.col("own")).cast("int"))
    parsed = parsed.withColumn("e", F.from_json("line", ENTRY)).withColumn("ok", F.expr("try_parse_json(line) is not null and line like '{%'"))
    e = F.col("e")
    entries = parsed.where("ok").select(
        e.tool.alias("tool"), e.action.alias("action"), e.target.alias("target"), e.sessionId.alias("session_id"), e.rawTokens.alias("raw_tokens"), e.compressedTokens.alias("compressed_tokens"),
        e.finalTokens.alias("final_tokens"), e.savedTokens.alias("saved_tokens"), e.latencyMs.alias("latency_ms"), F.expr("try_to_timestamp(e.timestamp)").alias("created_at"), F.col("at").alias("metric_id"), e.metadata.alias("metadata_json"),
    )
    return entries, parsed.where("not ok").select(F.col("at").alias("line_no"), "line")


def append_metrics(entries: DataFrame, folder: str) -> None:
    """Add entries to a folder of JSON lines."""
    entries.write.mode("append").json(folder)


def rotated(lines: DataFrame, at: str, text: str = "line", most: int = MOST_METRICS, keep: int = KEPT_LINES) -> DataFrame:
    """The last lines of a log that has outgrown its size, all lines of one that has not; at: the order of the lines."""
    size = lines.agg(F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0)).alias("__size"))
    last = lines.orderBy(F.desc(at)).limit(keep).select(F.col(at).alias("__at"))
    marked = lines.join(last.withColumn("__kept", F.lit(True)), lines[at] == F.col("__at"), "left").crossJoin(F.broadcast(size))  # one row
    return marked.where((F.col("__size") <= most) | F.col("__kept")).drop("__at", "__kept", "__size")


def session_files(spark: SparkSession, path: str) -> DataFrame:
    """Session documents, one JSON object a file; the pointer to the active one, and what doesn't parse, are left out.

    The id is the document's own, else the name of its file."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(T.basename(F.col("_metadata.file_path")).alias("file"), "value").where("file <> 'active.json'")
    s = rows.withColumn("s", F.from_json("value", SESSION.replace(", _corrupt_record string", "")))
    good = s.where(F.expr("try_parse_json(value) is not null and ltrim(value) like '{%'"))
    own = F.coalesce(F.nullif(F.trim("s.sessionId"), F.lit("")), F.regexp_replace("file", r"\.json$", ""))
    return good.select(own.alias("session_id"), "s.goal", "s.status", F.col("s.nextStep").alias("next_step"), "s.completed", "s.decisions", F.col("s.touchedFiles").alias("touched_files"), F.expr("try_to_timestamp(s.updatedAt)").alias("updated_at"))


def task_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation tasks from JSON arrays."""
    return spark.read.schema("id string, taskType string, description string, query string, expectedFiles array<string>, expectedSymbols array<string>").json(path, multiLine=True)


def changed_files(listed: DataFrame, untracked: DataFrame | None, there: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed paths that are there, those that are gone) of the listed ones and the untracked ones, each once."""
    every = listed.select("path") if untracked is None else listed.select("path").union(untracked.select("path"))
    every = every.where(T.strip(F.col("path")) != "").distinct()
    known = there.select("path").distinct()
    return every.join(known, "path", "left_semi"), every.join(known, "path", "left_anti")


def safe_ref(ref: str) -> bool:
    """Whether a name of a revision holds nothing that a shell would act on."""
    return not any(c in "|&;<>`\n\r$(){}" for c in ref)
