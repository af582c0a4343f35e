"""Queries over the index: kept up to date, and of scripts in many forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..operators import graph, outline, planning, symbols
from ..sources import scratch
from .registry import _dealt, _t, query


def _versions(part):
    """Two states of a tree of scripts, one a part: a tenth of them is new in the second, a tenth gone, a tenth changed."""
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    test = k % 17 == 0
    path = F.when(test, F.concat(F.lit("m"), s(k % 40), F.lit("/f"), s(k - 40), F.lit(".test.js"))).otherwise(F.concat(F.lit("m"), s(k % 40), F.lit("/f"), s(k), F.lit(".js")))
    text = F.when(test, F.lit("import lib from 'lib';\ntest('x', () => {});")).otherwise(F.concat(F.lit("import a from './f"), s(k + 40), F.lit(".js';\nimport b from '../m"), s(k * 3 % 40), F.lit("/f"), s(k * 3), F.lit("';\nexport function g"), s(k), F.lit("() {\n}\n")))
    was = F.when(k % 10 == 2, F.concat(F.lit("import x from './f"), s(k + 80), F.lit("';\nfunction old() {\n}\n"))).otherwise(text)
    rows = part.select(k.alias("k"), path.alias("path"), text.alias("text"), was.alias("was"))
    first = rows.where("k % 10 <> 0").select("path", F.col("was").alias("text"), F.lit(1.0).alias("mtime"))
    second = rows.where("k % 10 <> 1").select("path", "text", F.when(F.col("k") % 10 == 2, 2.0).otherwise(1.0).alias("mtime"))
    return first, second


@query(
    "with f as (select p_partkey k, p_partkey % 17 = 0 t, 'm' || p_partkey % 40 || '/f' || case when p_partkey % 17 = 0 then (p_partkey - 40) || '.test.js' else p_partkey || '.js' end path from part where p_partkey % 10 <> 1), "
    "i as (select path, 'm' || k % 40 || '/f' || (k + 40) || '.js' other from f where not t union all select path, 'm' || k * 3 % 40 || '/f' || k * 3 || '.js' from f where not t) "
    "select 'import' kind, path, other from i where other in (select path from f) union all select 'testOf', path, replace(path, '.test', '') from f where t and replace(path, '.test', '') in (select path from f) "
    "union all select 'symbol', path, 'g' || k from f where not t union all select 'scanned', path, '' from f where k % 10 in (0, 2)"
)
def index_increment(spark, d):
    """An index brought up to date: symbols and edges as of a build from nothing, and the files that were read for it."""
    first, second = _versions(_dealt(spark, d, "part"))
    at = scratch.folder(spark, "index")
    now = api.build_index(second, api.build_index(first, folder=f"{at}/1"), f"{at}/2")
    edges = now.edges.select("kind", F.col("src").alias("path"), F.col("dst").alias("other"))
    return edges.union(now.symbols.select(F.lit("symbol"), "path", "name")).union(now.scanned.select(F.lit("scanned"), "path", F.lit("")))


#: by form: the lines of a script (# is the key of its part), the symbols it declares (name, kind, line, owner) and its links
FORMS = [
    (['const s# = "{";', "function after#() {}"], [("s#", "const", 1, None), ("after#", "function", 2, None)], []),
    (["// { not open", "/* {", " { */ class A# {", '  x# = "}";', "  m#() { return `{${ {a: `}`} }{`; }", "  n#() {}", "}"], [("A#", "class", 3, None), ("x#", "property", 4, "A#"), ("m#", "method", 5, "A#"), ("n#", "method", 6, "A#")], []),
    (["export const a# = 1, b# = 2,", "  { c } = f, g# = new Map<string, number>();", "let h#: Array<Map<a, b>> = 3"], [("a#", "const", 1, None), ("b#", "const", 1, None), ("g#", "const", 1, None), ("h#", "const", 3, None)], [("export", "a#"), ("export", "b#"), ("export", "g#")]),
    (["const r# = /[{/]\\{/g", "const q# = x / y / z", "if (r#) { const inner = 1 }", "async function last#() {}"], [("r#", "const", 1, None), ("q#", "const", 2, None), ("last#", "function", 4, None)], []),
    (["@Comp({ a: '{' })", "export class K#<T> extends B<T> {", "  private readonly b#?: Map<string, number> = new Map()", "  static async *gen#<U>(x: { a: 1 }): void { if (x) { y() } }", "  get v() { return 1 }", "  constructor() { this.q = 1 }", "  get() {}", "  #p = 1", "  arrow# = async () => {", "    call();", "  }", "}"], [("K#", "class", 1, None), ("b#", "property", 3, "K#"), ("gen#", "method", 4, "K#"), ("get", "method", 7, "K#"), ("arrow#", "property", 9, "K#")], [("export", "K#")]),
    (["export interface I# { a: string, f#(): void; c?: number", "  d }", "export type U# = { a: 1 } | 'x'", "enum E# { A, B }", "export const enum F# { A }"], [("I#", "interface", 1, None), ("a", "property", 1, "I#"), ("f#", "method", 1, "I#"), ("c", "property", 1, "I#"), ("d", "property", 2, "I#"), ("U#", "type", 3, None), ("E#", "enum", 4, None), ("F#", "enum", 5, None)], [("export", "I#"), ("export", "U#"), ("export", "F#")]),
    (["import d, { e as f, type G } from './o#'", "import './p#'", "import * as ns from 'q#'", "export { a as b#, c } from './m#'", "export * from './n#'", "export default function () {}", "import('./lazy')"], [], [("import", "./o#"), ("import", "./p#"), ("import", "q#"), ("import", "./m#"), ("export", "b#"), ("export", "c"), ("import", "./n#")]),
    (["#!/usr/bin/env node", "export default { on#() {} }", "const { x, ...rest } = require('y')", "var z# = a", "  .b()", "  .c(), w#", "for (;;) {}", "do { k() } while (0)", "function *gen#() {}"], [("z#", "const", 4, None), ("w#", "const", 4, None), ("gen#", "function", 9, None)], [("export", "default")]),
]


def _forms_sql(n: int, columns: str, names: str) -> str:
    at = "case when p_partkey % 2 = 0 then 's/' || p_partkey || '.ts' else 's/' || p_partkey || '.jsx' end"
    rows = ", ".join("(" + ", ".join([str(i), *("null" if x is None else repr(x) for x in row)]) + ")" for i, form in enumerate(FORMS) for row in form[n])
    return f"select {at} path, {columns} from part join (values {rows}) v(i, {names}) on p_partkey % {len(FORMS)} = i"


def _scripts(spark, d):
    key = F.col("p_partkey").cast("string")
    text = F.element_at(F.array(*(F.lit("\n".join(lines)) for lines, _, _ in FORMS)), (F.col("p_partkey") % len(FORMS) + 1).cast("int"))
    text = F.regexp_replace(text, F.lit("([A-Za-z])#"), F.concat(F.lit("$1"), key))
    path = F.concat(F.lit("s/"), key, F.when(F.col("p_partkey") % 2 == 0, ".ts").otherwise(".jsx"))
    return _dealt(spark, d, "part").select(path.alias("path"), text.alias("text"))


@query(_forms_sql(1, "replace(n, '#', p_partkey::varchar) \"name\", k kind, l::int line, replace(o, '#', p_partkey::varchar) parent", "n, k, l, o"))
def script_symbols(spark, d):
    """What scripts declare, with braces in strings, comments, templates and regular expressions, members and several names."""
    return symbols.symbols(_scripts(spark, d)).select("path", "name", "kind", "line", "parent")


@query(_forms_sql(2, "k kind, replace(n, '#', p_partkey::varchar) \"name\"", "k, n"))
def script_links(spark, d):
    """What scripts take in and give out, in all forms of import and export."""
    return symbols.links(_scripts(spark, d))


_TOP = "(select max(p_partkey) from part)"


@query(
    f"with d as (select p_partkey k, 't/' || p_partkey || '.py' path from part) "
    "select path, 'f' || k symbol, 'A' || k \"name\", case when k % 4 = 0 then path else 'd/' || k || '.py' end \"at\", 1 line from d "
    f"union all select path, 'f' || k, 'B' || (k + 1), 'd/' || (k + 1) || '.py', 22 from d where (k + 1) % 2 = 0 and k + 1 <= {_TOP} "
    f"union all select path, 'g' || k, 'C' || (k + 2), 'd/' || (k + 2) || '.py', 37 from d where (k + 2) % 5 <> 0 and k + 2 <= {_TOP} "
    "union all select path, 'g' || k, 'A' || k, case when k % 4 = 0 then path else 'd/' || k || '.py' end, 37 from d"
)
def symbol_types(spark, d):
    """Types that are named within thirty lines of a symbol, and where they are declared; those further on are not of it."""
    part = _dealt(spark, d, "part").select(F.col("p_partkey").alias("k"))
    s = F.col("k").cast("string")
    at = lambda n: (F.col("k") + n).cast("string")
    pad = lambda n: F.repeat(F.lit("    pass\n"), n)
    text = F.concat(F.lit("def f"), s, F.lit("(a: A"), s, F.lit("):\n"), pad(20), F.lit("    x: B"), at(1), F.lit("\n"), pad(12), F.lit("    y: C"), s, F.lit("\ndef g"), s, F.lit("():\n    return C"), at(2), F.lit(", A"), s)
    path = F.concat(F.lit("t/"), s, F.lit(".py"))
    files = part.select(path.alias("path"), text.alias("text"))
    found = part.select(path.alias("path"), F.explode(F.array(F.struct(F.concat(F.lit("f"), s).alias("name"), F.lit(1).alias("line")), F.struct(F.concat(F.lit("g"), s).alias("name"), F.lit(36).alias("line")))).alias("x")).select("path", "x.*")
    own = F.concat(F.lit("d/"), s, F.lit(".py"))
    declared = part.select(own.alias("path"), F.concat(F.lit("A"), s).alias("name")).union(part.where("k % 2 = 0").select(own, F.concat(F.lit("B"), s))).union(part.where("k % 5 <> 0").select(own, F.concat(F.lit("C"), s))).union(part.where("k % 4 = 0").select(path, F.concat(F.lit("A"), s)))
    return graph.types_near(found, files, declared.withColumn("line", F.lit(1)))


@query(
    "with recursive p as (select o_custkey task, row_number() over (partition by o_custkey order by o_orderkey) place, 5 + o_orderkey % 20 base, case when o_orderkey % 3 <> 0 then o_orderkey % 40 else 0 end cost from orders), "
    "b as (select *, sum(base) over (partition by task order by place) s from p), kept as (select * from b where s <= 100 or place = 1), "
    "f as (select task, 0::bigint place, sum(base)::bigint used, false given, 0::bigint base, 0::bigint cost from kept group by task "
    "union all select k.task, k.place, f.used + case when k.cost > 0 and (k.place = 1 or f.used + k.cost <= 100) then k.cost else 0 end, k.cost > 0 and (k.place = 1 or f.used + k.cost <= 100), k.base, k.cost from f join kept k on k.task = f.task and k.place = f.place + 1) "
    "select task, place, base + case when given then cost else 0 end tokens, given has_text from f where place > 0"
)
def plan_texts(spark, d):
    """Plans of all customers: entries while they fit a budget, then texts in order, skipping what would overflow."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("task"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("place"), k.cast("string").alias("rel"), (5 + k % 20).alias("base_tokens"), (k % 3 != 0).alias("read_text"), F.repeat(F.lit("w "), (k % 40).cast("int")).alias("text"))
    out = planning.with_texts(o.drop("text"), o.select("task", "rel", "text"), 100)
    return out.select("task", "place", "tokens", F.col("text").isNotNull().alias("has_text"))


#: by form: the ending, the lines (# behind a letter is the key of the part), and the symbols, with comments, strings, nesting and odd lines
CODE = [
    ("py", ["# comment with class X:", '"""doc def y("""', "class A#:", '    """text"""', "    LIMIT = 3", "", "    @property", "    def value(self) -> int:", "        def inner():", "            pass", "        return 1", "", "    async def load(", "        self,", "        path: str,", "    ) -> None:", "        pass", "", "class B#(A#, metaclass=M):", "    pass", "", "MAX# = 1", "@wrap", "def top#(a, *b):", "    pass"], [("A#", "class", 3, None), ("value", "method", 8, "A#"), ("inner", "method", 9, "A#"), ("load", "method", 13, "A#"), ("B#", "class", 19, None), ("top#", "function", 24, None)]),
    ("py", ["def first#(x): return x", 's = "class No:"', "if True:", "    def nested#():", "        pass", "class C#: pass", "async def last#(): ..."], [("first#", "function", 1, None), ("nested#", "function", 4, None), ("C#", "class", 6, None), ("last#", "function", 7, None)]),
    ("go", ["package p", "// func No() {", "func Plain#(a int) (int, error) {", "\tfunc() { run() }()", "}", "func (r *Recv#) Method#(x string) {", "}", "type (", "\tAlias# = int", ")", "type I# interface {", "}", 'var s = "func Not() {"'], [("Plain#", "function", 3, None), ("Method#", "function", 6, None), ("I#", "type", 11, None)]),
    ("rs", ["// fn no() {}", "pub(crate) fn hidden#() {}", "pub async fn go#() {", "}", "pub enum E# {", "}", "impl E# {", "    fn a#(&self) {", "    }", "    pub fn b#() {}", "}", "pub trait T# {}", "const K#: i32 = 1;", "fn free#() {}"], [("go#", "fn", 3, None), ("E#", "enum", 5, None), ("E#", "impl", 7, None), ("a#", "method", 8, "E#"), ("b#", "method", 10, "E#"), ("T#", "trait", 12, None), ("K#", "const", 13, None), ("free#", "fn", 14, None)]),
]
_PY = ["# Classes and methods", "class A#", "  @decorated def value(self) -> int", "  def inner()", "  async def load(self, path: str,) -> None", "class B#(A#, metaclass=M)", "", "# Classes", "class A#", "class B#(A#, metaclass=M)", "", "# Top-level definitions", "@decorated def top#(a, *b)", "", "# Constants", "const LIMIT", "const MAX#"]


def _code(spark, d):
    n = (F.col("p_partkey") % len(CODE) + 1).cast("int")
    key = F.col("p_partkey").cast("string")
    text = F.regexp_replace(F.element_at(F.array(*(F.lit("\n".join(lines)) for _, lines, _ in CODE)), n), F.lit("([A-Za-z])#"), F.concat(F.lit("$1"), key))
    path = F.concat(F.lit("c/"), key, F.lit("."), F.element_at(F.array(*(F.lit(e) for e, _, _ in CODE)), n))
    return _dealt(spark, d, "part").select(path.alias("path"), text.alias("text"))


def _code_sql() -> str:
    end = f"'c/' || p_partkey || '.' || ({[e for e, _, _ in CODE]})[p_partkey % {len(CODE)} + 1]"
    rows = ", ".join("(" + ", ".join([str(i), *("null" if x is None else repr(x) for x in row)]) + ")" for i, (_, _, found) in enumerate(CODE) for row in found)
    return f"select {end} path, replace(n, '#', p_partkey::varchar) \"name\", k kind, l::int line, replace(o, '#', p_partkey::varchar) parent from part join (values {rows}) v(i, n, k, l, o) on p_partkey % {len(CODE)} = i"


@query(_code_sql())
def code_symbols(spark, d):
    """What files of other languages declare, with comments, strings, nested and unfinished lines around it."""
    return symbols.symbols(_code(spark, d)).select("path", "name", "kind", "line", "parent")


@query("select 'c/' || p_partkey || '.py' path, regexp_replace('" + "' || chr(10) || '".join(_PY) + "', '([A-Za-z])#', '\\1' || p_partkey, 'g') as text from part")
def python_outlines(spark, d):
    """Outlines of Python files whose headers run over lines and whose definitions are nested, one a part."""
    key = F.col("p_partkey").cast("string")
    text = F.regexp_replace(F.lit("\n".join(CODE[0][1])), F.lit("([A-Za-z])#"), F.concat(F.lit("$1"), key))
    files = _dealt(spark, d, "part").select(F.concat(F.lit("c/"), key, F.lit(".py")).alias("path"), text.alias("text"))
    return outline.read(files, "outline").select("path", "text")
