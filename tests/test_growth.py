"""Folds of updates and the index as it grows, against step-by-step versions."""

import random

from lumenlake import api
from lumenlake.operators import outline, script, sessions, symbols

LISTS = [c for c in sessions.LISTS if c != "blockers"]
SCHEMA = "session_id string, at int, action string, goal string, status string, current_focus string, why_blocked string, next_step string, " + ", ".join(f"{c} array<string>" for c in sessions.LISTS)


def unique(*lists):
    return list(dict.fromkeys(x for xs in lists for x in xs or [] if x and x.strip()))


def step_by_step(old, updates):
    state = {}
    blank = lambda: {"goal": "Untitled session", "status": "in_progress", "current_focus": "", "why_blocked": "", "next_step": "", **{c: [] for c in sessions.LISTS}}

    def put(s, u):
        for c in ("goal", "current_focus", "why_blocked", "next_step"):
            s[c] = u.get(c) or s[c]
        s["status"] = u["status"] if u["status"] in sessions.STATUSES else s["status"]
        for c in LISTS:
            s[c] = unique(s[c], u[c])
        if u["blockers"] is not None:
            s["blockers"] = unique(u["blockers"])
        return s

    for u in old:
        state[u["session_id"]] = put(blank(), u)
    for u in sorted(updates, key=lambda u: u["at"]):
        k = u["session_id"]
        if u["action"] == "reset":
            state.pop(k, None)
        else:
            state[k] = put(blank() if u["action"] == "update" or k not in state else state[k], u)
    return state


def test_fold_against_single_steps(spark):
    r = random.Random(5)
    some = lambda n: [r.choice(["a", "b", "c", "d", " ", ""]) for _ in range(r.randrange(n))] if r.random() < 0.6 else None
    row = lambda k, at, action: {"session_id": k, "at": at, "action": action, "status": r.choice([None, "odd", "blocked", "completed"]), **{c: r.choice([None, "", f"{c}{at}"]) for c in ("goal", "current_focus", "why_blocked", "next_step")}, **{c: some(4) for c in sessions.LISTS}}
    updates = [row(f"s{r.randrange(40)}", at, r.choice(["append", "auto_append", "append", "update", "reset"][: r.choice([2, 4, 5])])) for at in range(400)]
    old = [row(f"s{k}", None, "stored") for k in range(0, 60, 2)]
    names = SCHEMA.split(", ")
    order = [n.split()[0] for n in names]
    frame = lambda rows: spark.createDataFrame([tuple(u[c] for c in order) for u in rows], SCHEMA)
    out = sessions.fold(frame(old).drop("at", "action"), frame(updates), ["at"]).collect()
    got = {x.session_id: {c: x[c] for c in (*sessions.SCALARS, "status", *sessions.LISTS)} for x in out}
    assert len(got) == len(out) and got == step_by_step(old, updates)
    assert all(x.completed_count == len(x.completed) for x in out)
    assert sessions.fold(frame([]).drop("at", "action"), frame([]), ["at"]).count() == 0


def test_updates_of_one_session_lose_and_double_nothing(spark):
    old = spark.createDataFrame([("s", ["a"])], "session_id string, completed array<string>")
    new = spark.createDataFrame([("s", ["b"], 1), ("s", ["c"], 2), ("new", ["x"], 1)], "session_id string, completed array<string>, at int")
    assert {x.session_id: x.completed for x in sessions.append(old, new, order=["at"]).collect()} == {"s": ["a", "b", "c"], "new": ["x"]}
    rows = spark.createDataFrame([("s", 1, "first", 5), ("s", 2, "last", 4), ("t", 3, "only", 1)], "session_id string, created int, v string, at int")
    was = spark.createDataFrame([("s", 0, "old", 0)], "session_id string, created int, v string, at int")
    assert {tuple(x) for x in sessions.upsert(was, rows, "session_id", "created", ["at"]).collect()} == {("s", 0, "first", 5), ("t", 3, "only", 1)}


def test_index_as_files_come_and_go(spark, tmp_path):
    """After each change the index is that of a build from nothing, and only what is new was read."""
    r = random.Random(9)
    name = lambda k: f"d{k % 3}/f{k}.test.js" if k % 5 == 0 else f"d{k % 3}/f{k}.js"
    files = {}

    def text(k):
        links = "\n".join(f"import x{i} from '{'./' if j % 3 == k % 3 else f'../d{j % 3}/'}f{j}{r.choice(['', '.js'])}';" for i, j in enumerate(r.sample(range(20), r.randrange(3))))
        return links + r.choice(["", f"\nfunction g{r.randrange(9)}() {{}}"])

    index, stamp = None, 0.0
    for turn in range(3):
        changed = set()
        for k in r.sample(range(20), 8 if turn else 14):
            stamp += 1
            if k in files and r.random() < 0.4:
                del files[k]
            else:
                files[k] = (name(k), text(k), stamp)
                changed.add(name(k))
        now = spark.createDataFrame(list(files.values()), "path string, text string, mtime double")
        index = api.build_index(now, index, f"{tmp_path}/{turn}")
        whole = api.build_index(now, folder=f"{tmp_path}/whole{turn}")
        for part in ("files", "symbols", "links", "edges", "seen"):
            a, b = ([tuple(x) for x in getattr(i, part).collect()] for i in (index, whole))
            assert sorted(a, key=str) == sorted(b, key=str), (turn, part)
        if turn:
            assert {x.path for x in index.scanned.collect()} == changed & {f[0] for f in files.values()}
    again = api.Index.read(spark, f"{tmp_path}/0")
    assert again.seen.count() == 14


def test_scripts_of_odd_forms():
    names = lambda t: [(n, k) for n, k, *_ in symbols.scan("js", t)]
    assert names('const s = "{";\nfunction after() {}') == [("s", "const"), ("after", "function")]
    assert names("// {\nfunction after() {}") == [("after", "function")] == names("/* { */ function after() {}")
    assert names("const t = `{${`{`}`;\nfunction after() {}") == [("t", "const"), ("after", "function")]
    assert names('class A { x = "}";\n m() {}\n n() {} }') == [("A", "class"), ("x", "property"), ("m", "method"), ("n", "method")]
    assert names("const a = 1, b = 2") == [("a", "const"), ("b", "const")]
    assert names("x = a / b; y = c / d\nlet z = /}/.test(q) ? 1 : 2, { p } = o, u") == [("z", "const"), ("u", "const")]
    assert names("") == names("}}}") == names("`${") == names("'") == []
    broken = "function a() { if (x) { \nfunction b() {}"
    assert names(broken)[0] == ("a", "function")
    assert script.Script("import d, { e as f, type G } from \"./o\"\nconst {a, b} = c\nfoo(\n1)").outline() == ['import d, { e as f, G } from "./o"', "const {a, b}", "foo("]
    source = "export class U {\n  make(e: string): string {\n    return e;\n  }\n\n  drop(id) {}\n}\nconst c = {\n  port() {\n    return 1;\n  },\n  host: 'h',\n};\ninterface R {\n  find(id: string): P<U>;\n}\nfunction g() { port(); make(2) }\n"
    told = {n: outline.symbol_lines("js", source, n).split("\n") for n in ("make", "port", "host", "find", "c", "g")}
    assert {n: (x[0].split("|")[0], x[-1].split("|")[0]) for n, x in told.items()} == {"make": ("2", "4"), "port": ("9", "11"), "host": ("12", "12"), "find": ("15", "15"), "c": ("8", "13"), "g": ("17", "17")}
    assert outline.symbol_lines("js", source, "nope") == "Symbol not found: nope"
    hooks = script.Script("function useOwn() { useState<string>(1); React.useMemo(); const x = useRef; `${useEffect(() => {})}` }").hooks()
    assert hooks == ["useEffect", "useState"]
