"""SQL of the fixed rules, written out by themselves so that queries aren't held against their own constants, and source files for the outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: white space, stop words of turns and of tasks, words without signal, words of intents
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || chr(65279)"
_TURN = "the and for with that this from into when where what have will your about there their then than want need make does just each also todo done pero para como esta esto cuando donde quiero hacer sobre porque tengo vamos luego ahora puede puedo"
_TASK = "the a an in on at to for of with is are was were be been and or but not this that it how what where when why which who do does did has have had from by about into my our your can could will would should may might i we you all each every me us them its"
_LOW = "find show list get search locate lookup look check inspect review analyze analyse understand explore read open walk help need want please context preview recall stuff thing things happen happens handle handles handling wired declare declared defined owns owner existing exercise exercises before main shared related across split live lives surface public entry point path logic covers api apis flow flows file files onboarding app application load loads loaded"
_INTENTS = {
    "debug": "debug fix error bug crash fail broken issue trace", "tests": "test spec coverage assert mock jest vitest",
    "config": "config env setup deploy docker ci terraform yaml secret secrets settings database", "docs": "doc readme explain document guide",
    "implementation": "implement add create build feature refactor update modify",
}


def words(text: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"


TURN_STOP, TASK_OUT, INTENT_OUT = words(_TURN), words(f"{_TASK} {_LOW}"), words(" ".join(_INTENTS.values()))


def intent(x: str) -> str:
    n = {k: "(" + " + ".join(f"contains(lower({x}), '{w}')::int" for w in ws.split()) + ")" for k, ws in _INTENTS.items()}
    best = f"greatest({', '.join(n.values())})"
    return f"case when {best} = 0 then 'explore' " + " ".join(f"when {v} = {best} then '{k}'" for k, v in n.items()) + " end"


def greedy() -> str:
    less = "- case when c.dir = {0}.dir then case when c.r = 0 then 3 else 8 end else 0 end - case when c.r = {0}.r then case when c.r = 0 then 2 else 5 end else 0 end"
    pick = "(select * from (select *, row_number() over (partition by task order by g desc, r, rel) rn from {0}) where rn = 1)"
    return (
        "with c as (select lang task, source || '/' || doc_id rel, source dir, doc_id % 4 r, ([130, 85, 60, 50])[doc_id % 4 + 1] + least(n_chars, 2000) / 100 u from documents), "
        f"c1 as (select *, u g from c), a as {pick.format('c1')}, c2 as (select c.*, c.u {less.format('a')} g from c join a using (task) where c.rel <> a.rel), b as {pick.format('c2')}, "
        f"c3 as (select c.*, c.u {less.format('a')} {less.format('b')} g from c join a using (task) join b using (task) where c.rel not in (a.rel, b.rel) and not (c.r in (1, 3) and c.r = a.r and c.r = b.r)), d as {pick.format('c3')} "
        "select task, rel, (['primary', 'test', 'dependency', 'dependent'])[r + 1] \"role\", place, round(g, 6) gain from (select *, 1 place from a union all by name select *, 2 place from b union all by name select *, 3 place from d)"
    )


# ---- files made of the rows of parts ----------------------------------------------------------------------------------

#: by language: the lines of a file, # is the key of its part
FILES = {
    "py": ["import os", "from a.b import c#", "LIMIT_A = 1", "class A#(B):", "    def f#(self, x):", "        pass", "", "@wrap", "async def g#(a,", "        b) -> int:", "    return 1"],
    "go": ["package p#", "", "import (", '	"fmt"', '	x "a/b#"', ")", "func F#(x int) {", "}", "type T# struct {", "}", "func (t *T#) M#() {", "}", "const Z# = 1"],
    "rs": ["use std::io#;", "pub struct S# {", "}", "impl S# {", "    pub fn m#(&self) {", "    }", "}", "fn g#() {", "}"],
    "java": ["package a.b#;", "import c.D#;", "public class J# {", "    public void m#(int a) {", "    }", "}"],
    "cs": ["using A.B#;", "namespace N#", "public class C# {", "    public int M#(int a) {", "    }", "}"],
    "kt": ["package a.b#", "import c.d#", "data class K#(val a: Int) {", "    fun m#() {", "    }", "}", "fun g#() {", "}"],
    "php": ["namespace A\\B#;", "use C\\D#;", "class P# {", "    public function m#() {", "    }", "}", "function g#() {", "}"],
    "swift": ["import U#", "struct W# {", "    func m#() {", "    }", "}", "func g#() {", "}"],
    "js": ["import x from './x#.js';", "export class J# {", "  m#(a) {", "    useState#(1);", "  }", "}", "export function g#() {", "}", "const c# = 1;"],
    "toml": ["title = 1", "[sec#]", "key# = 2", "# no", "[[list#]]", "k = 3"],
    "yaml": ["top#:", "  below#: 1", "    deep: 2", "# no: 1", "top#:", "other: 3"],
    "dockerfile": ["# base", "FROM img# AS one", "RUN  make   a#", "COPY . .", "from two#"],
    "sql": ["-- x", "create table t# (a int);", "with a as (", "b# as (", "select 1 from t#", "drop table t#"],
    "sh": ["#!/bin/sh", "set -eu", "# no", "run#() {", "  make a#", "}", "export HOME#=1", "trap x EXIT", "run# now"],
    "tf": ["# no", 'resource "aws" "r#" {', "  size# = 1", "}", "locals {", 'provider "p#" {'],
}
_PATHS = {"dockerfile": "f/#/Dockerfile"}


def source_files(part: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """A file of one of the languages for each part: (key, path, text)."""
    names = languages or list(FILES)
    key = F.col("p_partkey").cast("string")
    text = F.element_at(F.array(*(F.lit("\n".join(FILES[n])) for n in names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    path = F.element_at(F.array(*(F.lit(_PATHS.get(n, f"f/#.{n}")) for n in names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    put = lambda c: _keyed(c, key)
    return part.select(F.col("p_partkey").alias("key"), put(path).alias("path"), put(text).alias("text"))


def _keyed(c: Column, key: Column) -> Column:
    """# behind a letter or a slash is the key; others are comments."""
    return F.regexp_replace(c, F.lit("([A-Za-z/])#"), F.concat(F.lit("$1"), key))


def paths_sql(languages: list[str] | None = None) -> str:
    names = languages or list(FILES)
    return f"case p_partkey % {len(names)} " + " ".join(f"when {i} then replace('{_PATHS.get(n, f'f/#.{n}')}', '#', p_partkey::varchar)" for i, n in enumerate(names)) + " end"


def symbols() -> str:
    """The declarations that the files hold: name, kind, line and owner of each."""
    found = {
        "py": [("A#", "class", 4, None), ("f#", "method", 5, "A#"), ("g#", "function", 9, None)],
        "go": [("F#", "function", 7, None), ("T#", "type", 9, None), ("M#", "function", 11, None)],
        "rs": [("S#", "struct", 2, None), ("S#", "impl", 4, None), ("m#", "method", 5, "S#"), ("g#", "fn", 8, None)],
        "java": [("J#", "class", 3, None), ("m#", "method", 4, "J#")],
        "cs": [("C#", "class", 3, None), ("M#", "method", 4, "C#")],
        "kt": [("K#", "class", 3, None), ("m#", "method", 4, "K#"), ("g#", "function", 7, None)],
        "php": [("P#", "class", 3, None), ("m#", "function", 4, None), ("g#", "function", 7, None)],
        "swift": [("W#", "struct", 2, None), ("m#", "function", 3, None), ("g#", "function", 6, None)],
        "js": [("J#", "class", 2, None), ("m#", "method", 3, "J#"), ("g#", "function", 7, None), ("c#", "const", 9, None)],
    }
    names = list(FILES)
    rows = ", ".join(f"({names.index(k)}, '{n}', '{kind}', {line}, {'null' if p is None else repr(p)})" for k, v in found.items() for n, kind, line, p in v)
    return f"select {paths_sql()} path, replace(n, '#', p_partkey::varchar) \"name\", kind, line::int line, replace(o, '#', p_partkey::varchar) parent from part join (values {rows}) v(l, n, kind, line, o) on p_partkey % {len(names)} = l"


def outlines(mode: str) -> str:
    """The outlines of the files, written out."""
    out = {
        "py": ["# Classes and methods", "class A#(B)", "  def f#(self, x)", "", "# Classes", "class A#(B)", "", "# Top-level definitions", "@decorated async def g#(a, b) -> int", "", "# Imports", "import os", "from a.b import c#", "", "# Constants", "const LIMIT_A"],
        "go": ["# Package", "package p#", "", "# Declarations", "func F#()", "type T# struct", "", "# Methods", "method M#(t *T#)", "", "# Imports", "fmt", "a/b#", "", "# Constants", "const Z#"],
        "rs": ["# Declarations", "struct S#", "fn g#()", "", "# Impl blocks", "impl S#", "", "# Methods", "S#::m#()", "", "# Uses", "use std::io#;"],
        "java": ["# Package", "package a.b#", "", "# Declarations", "class J#", "", "# Methods", "J#::m#(int a)", "", "# Imports", "c.D#"],
        "cs": ["# Namespaces", "namespace N#", "", "# Declarations", "class C#", "", "# Methods", "C#::M#", "", "# Usings", "A.B#"],
        "kt": ["# Package", "package a.b#", "", "# Declarations", "class K#", "", "# Functions", "K#::m#", "g#", "", "# Imports", "c.d#"],
        "php": ["# Namespace", "namespace A\\B#", "", "# Declarations", "class P#", "", "# Functions", "P#::m#", "g#", "", "# Uses", "C\\D#"],
        "swift": ["# Declarations", "struct W#", "", "# Functions", "W#::m#", "g#", "", "# Imports", "U#"],
        "js": ["# Outline", "import x from ''./x#.js''", "export class J#", "export function g#()", "const c#", "", "# Hooks", "useState#"],
        "toml": ["# TOML sections", "[sec#]", "[list#]", "", "# Keys", "root.title", "sec#.key#", "list#.k"],
        "yaml": ["# YAML top-level", "top#", "other", "", "# YAML nested", "  below#", "    deep"],
        "dockerfile": ["# Docker stages", "FROM img# as one", "FROM two#", "", "# Docker instructions", "RUN make a#", "COPY . ."],
        "sql": ["# SQL statements", "create table t# (a int);", "with a as (", "select 1 from t#", "drop table t#", "", "# CTEs", "cte b#"],
        "sh": ["# Shebang and options", "#!/bin/sh", "set -eu", "trap x EXIT", "", "# Functions", "function run#()", "", "# Exports", "export HOME#", "", "# Commands", "make", "run#"],
        "tf": ["# Terraform blocks", 'resource "aws" "r#"', "locals", 'provider "p#"', "", "# Assignments", "size#"],
    } if mode == "outline" else {
        "py": ["# Classes and methods", "class A#(B)", "  def f#(self, x)", "", "# Top-level definitions", "@decorated async def g#(a, b) -> int", "", "# Imports", "import os", "from a.b import c#"],
        "go": ["# Declarations", "func F#()", "type T# struct", "method M#(t *T#)", "", "# Imports", "fmt", "a/b#"],
        "rs": ["# Declarations", "struct S#", "fn g#()", "impl S#", "S#::m#()", "", "# Uses", "use std::io#;"],
        "java": ["# Declarations", "class J#", "J#::m#(int a)", "", "# Imports", "c.D#"],
        "cs": ["# Declarations", "class C#", "C#::M#", "", "# Usings", "A.B#"],
        "kt": ["# Declarations", "class K#", "K#::m#", "g#", "", "# Imports", "c.d#"],
        "php": ["# Declarations", "class P#", "P#::m#", "g#", "", "# Uses", "C\\D#"],
        "swift": ["# Declarations", "struct W#", "W#::m#", "g#", "", "# Imports", "U#"],
        "js": ["# Signatures", "import x from ''./x#.js''", "export class J#", "export function g#()", "const c#"],
        "toml": ["# TOML sections", "[sec#]", "[list#]"],
        "yaml": ["# YAML keys", "top#", "other"],
        "dockerfile": ["# Docker stages", "FROM img# as one", "FROM two#", "", "# Docker instructions", "RUN make a#", "COPY . ."],
        "sql": ["# SQL statements", "create table t# (a int);", "with a as (", "select 1 from t#", "drop table t#", "", "# CTEs", "cte b#"],
        "sh": ["# Shell entrypoints", "#!/bin/sh", "function run#()", "", "# Commands", "make", "run#", "", "# Exports", "export HOME#"],
        "tf": ["# Terraform blocks", 'resource "aws" "r#"', "locals", 'provider "p#"', "", "# Assignments", "size#"],
    }
    rows = " ".join(f"when {i} then '" + "' || chr(10) || '".join(out[n]) + "'" for i, n in enumerate(FILES))
    key = "regexp_replace(case p_partkey % {0} {1} end, '([A-Za-z])#', '\\1' || p_partkey, 'g')"
    once = key.format(len(FILES), rows)
    return f"select {paths_sql()} path, {once} as text from part"


def summaries() -> str:
    return "select user_id::varchar session_id, 'none' \"level\", 'goal ' || min(event_id) goal, max(event_id)::varchar why_blocked, '.../c/d/' || min(event_id) hot_file, (case when min(event_id) = max(event_id) then 1 else 2 end)::int n_completed, array_to_string(list_sort(list(distinct event_type))[-2:], ',') decisions from events group by user_id"
