"""Symbols, imports and exports of source files, by the lines that declare them.

One scanner goes over the lines of a file with the patterns of its language; what differs between languages is how a
member finds its owner: by indentation, by open braces, or by the last declaration. JavaScript and TypeScript are read
by tokens and brackets (script.py). Everything runs file by file in Arrow batches, so files are dealt freely."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .script import Script

BLANKS = re.compile(r"\s+")


@dataclass(frozen=True)
class Language:
    """declares: pattern with kind and name (kind '' takes `kind`); member: pattern with the name of what an owner has.

    owner: 'indent' (deeper lines belong to the last class), 'braces' (until they close), 'last' (the last declaration)."""

    declares: str
    member: str = ""
    kind: str = ""
    owner: str = "last"
    imports: str = ""
    free: str = "function"  # the kind of a member without an owner; '' if there is none
    nested: str = "open"  # for braces: a member counts if they are open, if it is indented, or always
    closes_after_member: bool = False  # whether a line with a member is left out of the count of braces


# fixed values: what a declaration looks like in each language
_CS = "public|private|protected|internal|static"
LANGUAGES = {
    "py": Language(r"^(class|def|async\s+def)\s+(\w+)", owner="indent", imports=r"^(?:from\s+(\S+)\s+import|import\s+(\S+))"),
    "go": Language(r"^(func)\s+(?:\([\w\s*]+\)\s+)?(\w+)\s*\(|^(type)\s+(\w+)\s", imports=r'"([^"]+)"'),
    "rs": Language(r"^(?:pub\s+)?(?:async\s+)?(fn|struct|enum|trait|type|impl|const|static)\s+(\w+)", owner="impl"),
    "java": Language(r"^(?:public|private|protected|static|final|abstract|\s)*(?:class|interface|enum|record)\s+(\w+)", r"^(?:public|private|protected|static|final|abstract|synchronized|\s)*(?:<[\w\s,?]+>\s+)?[\w<>\[\],\s]+\s+(\w+)\s*\(", kind="class", free=""),
    "cs": Language(rf"^(?:{_CS}|abstract|sealed|partial|\s)*(class|struct|interface|enum|record)\s+(\w+)", rf"^(?:{_CS}|virtual|override|abstract|async|\s)*[\w<>\[\],.\s]+\s+(\w+)\s*\(", owner="braces", imports=r"^using\s+([\w.]+);$", free="", nested="always"),
    "kt": Language(r"^(?:open|abstract|data|sealed|internal|private|protected|\s)*(class|object|interface|enum)\s+(\w+)", r"^(?:(?:public|private|protected|internal|open|override|suspend|inline)\s+)*fun\s+(?:<[^>]+>\s+)?(\w+)\s*\(", owner="braces", imports=r"^import\s+([\w.*]+)$", nested="indent", closes_after_member=True),
    "php": Language(r"^(?:abstract|final|\s)*(class|interface|trait|enum)\s+(\w+)", r"^(?:public|protected|private|static|\s)*function\s+(\w+)\s*\(", owner="braces", imports=r"^use\s+([\w\\]+)(?:\s+as\s+\w+)?;$", closes_after_member=True),
    "swift": Language(r"^(?:public|private|internal|open|final|\s)*(class|struct|enum|protocol|actor)\s+(\w+)", r"^(?:(?:public|private|internal|open|override|static|class|@\w+)\s+)*func\s+(\w+)", owner="braces", imports=r"^import\s+(\w+)$", closes_after_member=True),
}
ALIKE = {"jsx": "js", "ts": "js", "tsx": "js", "mjs": "js", "cjs": "js"}
COLUMNS = "path string, name string, kind string, line int, parent string, signature string"


def language(path: Column) -> Column:
    ext = F.substring(T.extension(path), 2, 10)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ALIKE.items() for x in kv)), ext), ext)


def one_line(text: str, most: int = 200) -> str:
    text = BLANKS.sub(" ", text).strip()
    return text[:most] + "..." if len(text) > most else text


def scan(lang: str, text: str) -> list[tuple[str, str, int, str | None, str | None]]:
    """(name, kind, line, parent, signature) of each declaration of a text."""
    if lang == "js":
        return [(name, kind, n, owner, None if said is None else one_line(said)) for name, kind, n, owner, said in Script(text).symbols()]
    if lang not in LANGUAGES:
        return []
    spec = LANGUAGES[lang]
    declares, member = re.compile(spec.declares), re.compile(spec.member) if spec.member else None
    out: list = []
    owner, depth = None, 0
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.lstrip()
        indent = len(raw) - len(line)
        opened = line.count("{") - line.count("}")
        m = declares.match(line)
        if lang == "py":
            if m and m[1] == "class":
                owner = m[2]
                out.append((owner, "class", n, None, one_line(re.sub(":$", "", line))))
            elif m:
                owner = owner if indent > 0 else None
                out.append((m[2], "method" if owner else "function", n, owner, one_line(re.sub(":$", "", line))))
            continue
        if lang == "go":
            if m:
                out.append((m[2] or m[4], "function" if m[1] else "type", n, None, one_line(line)))
            continue
        if lang == "rs":
            if m:
                method = m[1] == "fn" and owner and raw.startswith("    ")
                owner = m[2] if m[1] == "impl" else owner if method or m[1] != "fn" else None
                out.append((m[2], "method" if method else m[1], n, owner if method else None, one_line(line)))
            continue
        if m:
            owner = m[m.lastindex]
            out.append((owner, spec.kind or m[1], n, None, one_line(line)))
            if spec.closes_after_member or spec.owner == "last":
                continue
        elif member and (owner or spec.free) and (f := member.match(line)):
            inside = owner and (spec.nested == "always" or spec.owner == "last" or (raw.startswith("    ") if spec.nested == "indent" else depth > 0))
            plain = not spec.free and (" new " in line or "return " in line or lang == "cs" and line.startswith("//"))
            if not plain and (inside or spec.free):
                out.append((f[1], "method" if inside else spec.free, n, owner if inside else None, one_line(line)))
            if spec.closes_after_member:
                continue
        if spec.owner == "braces":
            depth += opened
            if depth <= 0:
                owner, depth = None, 0
    return out


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind, line, parent, signature) of each declaration in files(path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *s) for p, lang, text in zip(b["path"], b["lang"], b["text"]) for s in scan(lang, text or "")]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "line", "parent", "signature"])

    return files.select("path", language(F.col("path")).alias("lang"), "text").mapInPandas(run, COLUMNS)


def with_snippets(found: DataFrame, files: DataFrame) -> DataFrame:
    """found with the first lines of each declaration."""
    return found.join(files.select("path", "text"), "path").withColumn("snippet", T.snippet(F.col("text"), F.col("line"))).drop("text")


def links(files: DataFrame) -> DataFrame:
    """(path, kind import or export, name) of what files take in and give out: by built-in functions, but for scripts, whose tokens are read."""
    line = files.select("path", language(F.col("path")).alias("lang"), F.posexplode(T.lines(F.col("text"))).alias("at", "raw"))
    strip = line.withColumn("line", T.strip(F.col("raw")))
    got = F.lit("")
    for lang, spec in LANGUAGES.items():
        if spec.imports and lang not in ("go", "py"):
            got = F.when(F.col("lang") == lang, F.regexp_extract("line", spec.imports, 1)).otherwise(got)
    py = F.coalesce(F.nullif(F.regexp_extract("line", LANGUAGES["py"].imports, 1), F.lit("")), F.regexp_extract("line", LANGUAGES["py"].imports, 2))
    got = F.when(F.col("lang") == "py", py).otherwise(got)
    imports = strip.where("lang not in ('go', 'js')").withColumn("name", got).where("name <> ''").select("path", F.lit("import").alias("kind"), "name")
    # in Go, a block of imports goes from its opening line to the first line that closes it
    lines = T.lines(F.col("text"))
    trimmed = F.transform(lines, lambda x: T.strip(x))
    go = files.where(language(F.col("path")) == "go").select("path", trimmed.alias("ls"))
    state = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        opens, closes = x.startswith("import ("), s["inside"] & (x == ")")
        name = F.when(~opens & ~closes & (s["inside"] | x.startswith('import "')), F.regexp_extract(x, '"([^"]+)"', 1)).otherwise(F.lit(""))
        return F.struct((opens | (s["inside"] & ~closes)).alias("inside"), F.when(name != "", F.concat(s["out"], F.array(name))).otherwise(s["out"]).alias("out"))

    go = go.select("path", F.lit("import").alias("kind"), F.explode(F.aggregate("ls", state, step, lambda s: s["out"])).alias("name"))
    def of_scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, kind, name) for p, text in zip(b["path"], b["text"]) for kind, name in Script(text or "").links()]
            yield pd.DataFrame(rows, columns=["path", "kind", "name"])

    scripts = files.where(language(F.col("path")) == "js").select("path", "text").mapInPandas(of_scripts, "path string, kind string, name string")
    return imports.union(go).union(scripts)


def indexable(files: DataFrame, found: DataFrame, linked: DataFrame) -> DataFrame:
    """Files with a symbol or an import: others aren't worth an entry."""
    some = found.select("path").union(linked.where("kind = 'import'").select("path")).distinct()
    return files.join(some, "path", "left_semi")
