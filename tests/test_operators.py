"""Small known answers."""

from pyspark.sql import functions as F

from lumenlake.functions import tasks
from lumenlake.functions import text as T
from lumenlake.operators import compress, evaluate, graph, metrics, outline, patterns, planning, search, sessions, state, symbols, turns
from lumenlake.plans import registry
from lumenlake.sources import files, store


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_metrics_report_and_fallback(spark):
    names = "tool string, raw_tokens long, compressed_tokens long, final_tokens long, saved_tokens long"
    rows = spark.createDataFrame([("a", 300, 120, None, 180), ("a", 200, 100, None, 100), ("b", 80, 60, None, 20)], names)
    total = metrics.report(metrics.normalised(rows)).where("tool is null").first()
    assert (total.n, total.raw_tokens, total.compressed_tokens, total.saved_tokens) == (3, 580, 280, 300)
    rows = spark.createDataFrame([("a", 220, None, 140, None), (None, 180, None, 120, None)], names)
    total = metrics.report(metrics.normalised(rows)).where("tool is null").first()
    assert (total.raw_tokens, total.compressed_tokens, total.saved_tokens) == (400, 260, 140)


def test_text(spark):
    assert one(spark, T.unique_lines(F.col("t")), t="a\n\n a\nb\n\na") == "a\n\nb\n"
    assert one(spark, T.truncate(F.col("t"), 3), t="abcde") == "abc\n\n[truncated 2 chars]"
    assert one(spark, T.infer_intent(F.col("t")), t="fix the failing test") == "debug"
    assert one(spark, T.task_signature(F.col("t")), t="Fix the LOGIN-bug, now!") == "fix the login bug now"
    assert one(spark, T.session_id(F.col("g"), F.to_date(F.lit("2026-01-02"))), g="Add A login") == "2026-01-02-add-a-login"


def test_smart_case(spark):
    df = spark.createDataFrame([("Foo",), ("foo",)], "t string")
    assert df.where(T.smart_case_contains(F.col("t"), "foo")).count() == 2
    assert df.where(T.smart_case_contains(F.col("t"), "Foo")).count() == 1


def test_imports_resolve_by_rank(spark):
    known = spark.createDataFrame([("src/a/util.ts",), ("src/a/util/index.js",), ("src/b.js",)], "path string")
    imports = spark.createDataFrame([("src/a/main.js", "./util"), ("src/a/main.js", "../b"), ("src/a/main.js", "react")], "src string, spec string")
    assert {(r.spec, r.dst) for r in graph.resolve_imports(imports, known).collect()} == {("./util", "src/a/util.ts"), ("../b", "src/b.js")}


def test_symbols(spark):
    rows = spark.createDataFrame([("x.py", "class A:\n    def f(self):\n        pass\ndef g():\n    pass"), ("y.go", "func (t T) Run() {\n}")], "path string, text string")
    assert {(r.name, r.kind, r.line, r.parent) for r in symbols.symbols(rows).collect()} == {("A", "class", 1, None), ("f", "method", 2, "A"), ("g", "function", 4, None), ("Run", "function", 1, None)}


def test_budgets_and_greedy(spark):
    assert one(spark, planning.skip_budget(F.col("c"), 10), c=[20, 5, 4, 6, 1]) == [1]
    assert one(spark, planning.skip_budget(F.col("c"), 10), c=[4, 5, 4, 1]) == [1, 2, 4]
    rows = spark.createDataFrame([("t", "m/a", "primary", 140.0), ("t", "u/a", "dependency", 72.0), ("t", "u/b", "dependency", 72.0), ("t", "v/a", "dependency", 66.0)], "task string, rel string, role string, utility double")
    assert [r.rel for r in planning.greedy(rows, k=3).orderBy("place").collect()] == ["m/a", "u/a", "v/a"]


def test_upsert_and_append(spark):
    old = spark.createDataFrame([("s", 1, ["a"])], "session_id string, created int, completed array<string>")
    new = spark.createDataFrame([("s", 9, ["b"]), ("z", 9, ["c"])], old.schema)
    assert {(r.session_id, r.created, tuple(r.completed)) for r in sessions.upsert(old, new, "session_id", "created").collect()} == {("s", 1, ("b",)), ("z", 9, ("c",))}
    assert sessions.append(old, new.select("session_id", "completed")).first().completed == ["a", "b"]


LOG = "task string, intent string, accessed_at int, path string, position int, relevance double"


def predicted(spark, log, task, intent, k=8):
    p, f = patterns.learn(spark.createDataFrame(log, LOG))
    return [r.path for r in patterns.predict(p, f, spark.createDataFrame([(task, intent)], "task string, intent string"), k).orderBy("place").collect()]


def test_patterns(spark):
    one = [("fix login flow", "debug", 1, "src/auth.js", 0, 0.0)]
    assert predicted(spark, one, "fix login flow", "debug") == ["src/auth.js"]
    assert predicted(spark, one, "unrelated words here", "debug") == []
    shrinking = [("fix the login bug", "debug", t, f"src/{f}.js", i, 1.0 - i / 10) for t, fs in enumerate((["login", "session", "util"], ["login", "session"], ["login"])) for i, f in enumerate(fs)]
    assert predicted(spark, shrinking, "fix the login bug", "debug")[0] == "src/login.js"
    many = [("open many files now", "explore", t, f"f{i}", i, 0.0) for t in range(3) for i in range(15)]
    assert len(predicted(spark, many, "open many files now", "explore", 5)) == 5
    two = [("change the cache", "debug", 1, "a.js", 0, 0.0), ("change the cache", "tests", 1, "b.js", 0, 0.0)]
    assert predicted(spark, two, "change the cache", "tests") == ["b.js"]
    p, f = patterns.learn(spark.createDataFrame(one, LOG))
    day = lambda n: F.lit("2026-01-01").cast("timestamp") + F.expr(f"INTERVAL {n} DAYS")
    p = p.withColumn("last_seen", F.lit("2026-01-01").cast("timestamp"))
    asked = spark.createDataFrame([("fix login flow", "debug")], "task string, intent string")
    assert patterns.predict(p, f, asked, as_of=day(29)).count() == 1 and patterns.predict(p, f, asked, as_of=day(31)).count() == 0


def test_sources_and_store(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, body in {"src/a.py": b"def f(): pass", "src/b.py": b"x\x00y", "node_modules/c.js": b"1", "Dockerfile": b"FROM x"}.items():
        (tmp_path / name).write_bytes(body)
    assert {r.path for r in files.corpus(spark, str(tmp_path)).collect()} == {"src/a.py"}
    assert {r.path for r in files.searched(spark, str(tmp_path)).collect()} == {"src/a.py", "Dockerfile"}
    (tmp_path / "m.jsonl").write_text('{"tool":"a","rawTokens":3}\n\nnope\n{"tool":"b"}\n')
    entries, bad = files.metric_lines(spark, str(tmp_path / "m.jsonl"))
    assert entries.count() == 2 and [r.line_no for r in bad.collect()] == [2]
    root = str(tmp_path / "store")
    assert store.read(spark, root) is None
    store.write(spark.range(3).toDF("x"), root)
    store.write(spark.range(5).toDF("x"), root)
    assert store.read(spark, root).count() == 5 and store.read(spark, root, 1).count() == 3


def test_every_term_and_posting_is_indexed(spark, tmp_path):
    docs = [(1, "Été 42 cats and 7"), (2, "cats, and an internationalisation"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.QUERIES["inverted_index_postings"](spark, str(tmp_path)).collect()}
    assert got == {("été", 1, 1), ("42", 1, 1), ("cats", 1, 2), ("cats", 2, 2), ("and", 1, 2), ("and", 2, 2), ("7", 1, 1), ("an", 2, 1), ("internationalisation", 2, 1)}


def test_every_row_is_on_a_side(spark, tmp_path):
    events = [(1, 7, "2024-01-01 00:00:00"), (5, 8, "2024-01-05 00:00:00"), (7, 7, "2024-01-05 00:00:00"), (11, 9, None)]
    spark.createDataFrame(events, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert {tuple(r) for r in registry.QUERIES["session_upsert"](spark, str(tmp_path)).collect()} == {(7, 1, 7), (8, 5, 5), (9, 11, 11)}
    docs = [(20, "a", "abc", 3), (40, "b", "abcd", 4), (60, "c", "ab", 2), (80, "b", "abc", 3), (100, None, None, 0)]
    spark.createDataFrame(docs, "doc_id long, source string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in registry.QUERIES["index_freshness"](spark, str(tmp_path)).collect()} == {(20, "removed"), (60, "added"), (80, "changed")}


def test_greedy_of_many_near_equals(spark):
    import random

    r = random.Random(4)
    rows = [("t", f"{r.choice('abcdefgh')}/{i}", r.choice([*planning.ROLE_CAPS, "other"]), float(r.randint(990, 1000))) for i in range(400)]
    rows += [("u", f"m/{i}", "dependent", 1000.0) for i in range(50)] + [("u", "m/last", "primary", 960.0)]
    frame = spark.createDataFrame(rows, "task string, rel string, role string, utility double")
    for k in (5, 9):
        got = {(x.task, x.place): x.rel for x in planning.greedy(frame, k=k).collect()}
        for task in "tu":
            left, out = [x[1:] for x in rows if x[0] == task], []
            while len(out) < k:
                fits = [x for x in left if sum(o[1] == x[1] for o in out) < planning.ROLE_CAPS.get(x[1], 0)]
                if not fits:
                    break
                gain = lambda x: x[2] - sum((3 if x[1] == "primary" else 8) * (x[0].split("/")[0] == o[0].split("/")[0]) + (2 if x[1] == "primary" else 5) * (x[1] == o[1]) for o in out)  # noqa: B023, E731
                out.append(min(fits, key=lambda x: (-gain(x), planning.ROLES.index(x[1]), x[0])))
                left.remove(out[-1])
            assert [got.get((task, i + 1)) for i in range(k)] == [*(x[0] for x in out), *[None] * (k - len(out))]


def test_search_points_by_hand(spark):
    df = spark.createDataFrame([("src/auth/login.js", 3)], "path string, n int")
    # 3 matches 18, name 30, part 16, source 14, sample 8, three parts of the path -3; a leading folder brings the points of /src/
    assert df.select(search.score(F.col("n"), F.col("path"), "login", "implementation").alias("x")).first().x == 83
    df = spark.createDataFrame([("/p/src/auth/login.js", 3)], "path string, n int")
    assert df.select(search.score(F.col("n"), F.col("path"), "login", "implementation").alias("x")).first().x == 83 + 10 - 2
    line = search.parse_match(F.col("x"))
    got = [r.m for r in spark.createDataFrame([("a/b.js:12: x: y",), ("no match",)], "x string").select(line.alias("m")).collect()]
    assert (got[0].file, got[0].line_no, got[0].line) == ("a/b.js", 12, " x: y") and got[1] is None


def test_trimming_takes_all_white_space(spark):
    assert one(spark, T.unique_lines(F.col("t")), t="a\n\ta\na\r") == "a"
    assert one(spark, T.strip(F.col("t")), t="\u00a0 a b\ufeff\n") == "a b"


def _state(**kw):
    base = dict.fromkeys(["goal", "status", "current_focus", "why_blocked", "next_step", *sessions.LISTS])
    return tuple((base | kw).values())


def test_checkpoints(spark):
    fields = "goal string, status string, current_focus string, why_blocked string, next_step string, " + ", ".join(f"{c} array<string>" for c in sessions.LISTS)
    start = _state(goal="g", status="in_progress", completed=["a"])
    rows = [
        ("milestone", start, _state(goal="g", status="in_progress", completed=["a", "b", "c"], next_step="n"), False),
        ("read_only", start, _state(goal="new", status="in_progress", completed=["a"]), False),
        ("read_only", start, _state(goal="new", status="in_progress", completed=["a"]), True),
        ("file_change", start, _state(goal="g", status="in_progress", completed=["a"], touched_files=["x"]), False),
        ("file_change", start, _state(goal="g", status="in_progress", completed=["a"], touched_files=["x", "y", "z"]), False),
        ("task_complete", start, _state(goal="g", status="completed", completed=["a"]), False),
        ("manual", start, start, False),
        ("manual", None, start, False),
    ]
    df = spark.createDataFrame(rows, f"kind string, before struct<{fields.replace(' string', ':string').replace(' array', ':array')}>, after struct<{fields.replace(' string', ':string').replace(' array', ':array')}>, force boolean")
    got = [(r.c.score, r.c.persist, r.c.why) for r in df.select(sessions.checkpoint(F.col("kind"), "before", "after", F.col("force")).alias("c")).collect()]
    assert got == [(7, True, "kept"), (5, False, "silent"), (5, True, "forced"), (1, False, "one_file"), (3, True, "kept"), (6, True, "kept"), (0, False, "unchanged"), (0, False, "insignificant")]


def test_resume(spark):
    def how(rows, **kw):
        df = spark.createDataFrame([(i, s, t) for i, s, t in rows], "session_id string, status string, t string").withColumn("updated_at", F.col("t").cast("timestamp"))
        r = sessions.resume(df, **kw).first()
        return r.session_id, r.recommended, r.source, r.found, r.ambiguous

    assert how([]) == (None, None, None, False, False)
    assert how([("a", "completed", "2026-01-01")]) == ("a", "a", "latest_only", True, False)
    assert how([("a", "completed", "2026-01-02"), ("b", "blocked", "2026-01-01")]) == ("b", "b", "only_open_session", True, False)
    assert how([("a", "planning", "2026-01-02"), ("b", "blocked", "2026-01-01")]) == ("a", "a", "latest_by_recency", True, False)
    near = [("a", "completed", "2026-01-02 01:00:00"), ("b", "blocked", "2026-01-02 00:00:00"), ("c", "planning", "2026-01-01 23:00:00")]
    assert how(near) == (None, "b", None, False, True)
    assert how(near, force=True) == ("b", "b", "recommended_open_session", True, True)


def test_summaries_shrink_step_by_step(spark):
    done = [f"finished the part number {i} of the work" for i in range(20)]
    row = ("s", "a goal that is long enough to be cut in two or three steps", "blocked", "the focus of the moment is here", None, "do the next thing in the list of things", ["pinned context line"], ["why is that so?"], done, [f"decided {i} for good reasons" for i in range(10)], ["waiting for an answer"], [f"src/a/b/c/file{i}.js" for i in range(30)])
    df = spark.createDataFrame([row], "session_id string, goal string, status string, current_focus string, why_blocked string, next_step string, pinned_context array<string>, unresolved_questions array<string>, completed array<string>, decisions array<string>, blockers array<string>, touched_files array<string>")
    import json

    whole = json.loads(sessions.summary(df, 10_000).first().text)
    assert (len(whole["recent_completed"]), len(whole["key_decisions"]), len(whole["hot_files"]), whole["completed_count"], whole["touched_files_count"]) == (3, 2, 5, 20, 30)
    seen = []
    for budget in (300, 150, 110, 60, 20, 5):
        r = sessions.summary(df, budget).first()
        now = json.loads(r.text)
        seen.append(r.level)
        assert r.tokens <= budget or r.level == "status_only"
        assert now["status"] == "blocked" and set(r.omitted) == set(whole) - set(now)
    assert seen[0] in ("none", "trimmed") and seen[-1] == "status_only"
    # the files go first, to one, before anything else is touched
    now, level = sessions.shrunk(whole, sessions._tokens(whole) - 1)
    assert level == "trimmed" and len(now["hot_files"]) == 1 and now["key_decisions"] == whole["key_decisions"]


def test_plan_of_near_alike_files(spark):
    piece = lambda kind, rank=None, query=None, via=None: (kind, via, None, rank, query, None)
    rows = [
        ("t", "src/middleware.js", "primary", [piece("searchHit", 1, "auth")], ["requireAuth"]), ("t", "tests/auth.test.js", "test", [piece("testOf", via="src/middleware.js")], []),
        ("t", "src/utils/a.js", "dependency", [piece("dependencyOf", via="src/middleware.js")], ["hash"]), ("t", "src/utils/b.js", "dependency", [piece("dependencyOf", via="src/middleware.js")], ["hash"]),
    ]
    df = spark.createDataFrame(rows, "task string, rel string, role string, evidence " + planning.EVIDENCE + ", matched array<string>")
    via = F.array_distinct(F.filter(F.transform("evidence", lambda e: e["via"]), lambda v: v.isNotNull()))
    df = df.withColumns({"utility": planning.utility(F.col("role"), F.col("evidence"), F.col("matched"), F.lit("debug")).cast("double"), "via": via, "intent": F.lit("debug")})
    plan = planning.allocate(df, max_tokens=2400).orderBy("place").collect()
    assert plan[0].rel == "src/middleware.js" and "tests/auth.test.js" in [p.rel for p in plan] and len(plan) == 3
    assert [p.mode for p in plan] == ["signatures"] * 3
    assert df.where("rel like 'src/mid%'").first().utility == 130 + 70 + 24 + 10


def test_context_of_a_task(spark):
    text = "fix the error in requireAuth of the session api"
    job = spark.createDataFrame([(1, text)], "task int, text string")
    hits = spark.createDataFrame([(1, 0, "requireAuth", 1, "src/api/auth.js"), (1, 0, "requireAuth", 2, "src/util.js"), (1, 1, "session", 1, "src/util.js")], "task int, query_at int, query string, rank int, rel string")
    edges = spark.createDataFrame([("src/api/auth.js", "src/util.js", "import"), ("tests/auth.test.js", "src/api/auth.js", "testOf"), ("src/app.js", "src/api/auth.js", "import")], "src string, dst string, kind string")
    names = spark.createDataFrame([("src/api/auth.js", "requireAuth", "function", 1, "function requireAuth()", None), ("src/util.js", "hash", "const", 2, None, "const hash")], "path string, name string, kind string, line int, signature string, snippet string")
    got = {r.rel: r for r in planning.context(job, hits, edges, names).collect()}
    assert set(got) == {"src/api/auth.js", "src/util.js", "tests/auth.test.js", "src/app.js"}
    top = got["src/api/auth.js"]
    assert (top.role, top.place, top.reason, top.matched, top.mode) == ("primary", 1, "search: requireAuth", ["requireAuth"], "outline")
    assert got["src/util.js"].role == "dependency" and got["tests/auth.test.js"].reason == "test: src/api/auth.js" and got["src/app.js"].reason == "imports: src/api/auth.js"
    assert not top.read_text and [p.name for p in top.previews] == ["requireAuth"]
    assert one(spark, F.array_join(tasks.query_candidates(F.col("t")), "|"), t=text).split("|")[0] == "requireAuth"


def test_import_targets_of_tests(spark):
    known = spark.createDataFrame([("pkg/cache/lru.go",), ("pkg/cache/lru_test.go",), ("src/a.js",), ("tests/a.test.js",), ("tests/b.test.js",)], "path string")
    found = {(r.src, r.dst) for r in graph.infer_targets(known.where(T.is_test_path(F.col("path"))), known).collect()}
    assert found == {("tests/a.test.js", "src/a.js")}


def test_state_upkeep(spark):
    old = spark.createDataFrame([("k1", 1)], "key string, v int")
    new = spark.createDataFrame([("k1", 5), ("k2", 7), ("k2", 6)], "key string, v int")
    assert [tuple(r) for r in state.insert_new(new, old, "key").collect()] == [("k2", 6)]
    assert tuple(state.imported(new, old, "key").first()) == (1, 2)
    active = spark.createDataFrame([("s", "2026-01-02")], "session_id string, updated_at string")
    pointer = lambda i, t: spark.createDataFrame([(i, t)], "session_id string, updated_at string")
    got = [state.removable_pointer(pointer(*x), active).first().why for x in ((None, None), ("s", "2026-01-01"), ("s", "2026-01-03"), ("z", None))]
    assert got == ["orphaned", "matches", "differs", "differs"]
    bad = spark.createDataFrame([], "line string")
    e = new.withColumnRenamed("key", "legacy_key")
    assert state.removable_metrics(e, old.withColumnRenamed("key", "legacy_key"), bad).first().why == "missing_entries"
    assert state.removable_metrics(e, e, bad).first().eligible


def test_sources_of_sessions_and_logs(spark, tmp_path):
    folder = tmp_path / "sessions"
    folder.mkdir()
    (folder / "one.json").write_text('{"goal": "g", "completed": ["x"], "updatedAt": "2026-01-01T00:00:00Z"}')
    (folder / "two.json").write_text('{"sessionId": "second"}')
    (folder / "bad.json").write_text("{")
    (folder / "active.json").write_text('{"sessionId": "second"}')
    got = {r.session_id: r.goal for r in files.session_files(spark, str(folder)).collect()}
    assert got == {"one": "g", "second": None}
    lines = spark.createDataFrame([(i, "x" * 99) for i in range(2000)], "at int, line string")
    assert {r.at for r in files.rotated(lines, "at", most=1024).collect()} == set(range(1500, 2000)) and files.rotated(lines, "at").count() == 2000
    assert files.inside("a/../b", "/r") == "/r/b"
    import pytest

    with pytest.raises(ValueError):
        files.inside("../x", "/r")
    assert files.safe_ref("HEAD~2") and not files.safe_ref("HEAD; ls")
    root = str(tmp_path / "meta")
    store.set_meta(spark, root, a="1", b="2")
    store.set_meta(spark, root, b="3")
    assert (store.get_meta(spark, root, "a"), store.get_meta(spark, root, "b"), store.get_meta(spark, root, "c")) == ("1", "3", None) and store.versions(spark, root) == [1, 2]


def test_turn_machine(spark, tmp_path):
    from lumenlake.streaming import streams

    src = tmp_path / "turns"
    rows = [("s", "prompt", None), ("s", "write", "a"), ("s", "stop", None), ("s", "prompt", None), ("s", "write", "b"), ("s", "checkpoint", None), ("s", "stop", None), ("z", "stop", None)]
    spark.createDataFrame(rows, "session_id string, kind string, path string").coalesce(1).write.parquet(str(src))
    out = streams.drain(streams.turns(spark.readStream.schema("session_id string, kind string, path string").parquet(str(src))), spark, "turns", "append", once=True)
    assert [tuple(r) for r in out.collect()] == [("s", 1, True), ("s", 1, False)]
    events = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:00:01"), (2, "2026-01-01 00:00:00")], "id int, t string").select("id", F.col("t").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "ev"))
    once = streams.once(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), ["id"])
    assert streams.drain(once, spark, "once", "append", once=True).count() == 2


def test_a_callers_columns_stay(spark):
    rows = spark.createDataFrame([("g", 1, 3, 9, 9)], "g string, o int, cost int, used int, rn int")
    assert tuple(planning.prefix_budget(rows, "g", [F.col("o")], "cost", 5).first()) == ("g", 1, 3, 9, 9)
    groups = spark.createDataFrame([("a", 1, 5, True, False)], "path string, n_matches int, score int, is_hit boolean, is_related boolean")
    r = search.boosted(groups, groups.select("path"), groups.select("path").limit(0), "path").first()
    assert (r.is_hit, r.is_related, r.score, r.boost_source) == (True, False, 55, "index")


def test_texts_that_hold_texts(spark):
    texts = spark.createDataFrame([(1, "xx one two three four five six yy"), (2, "one  two"), (3, None), (4, "a b")], "item int, text string")
    want = spark.createDataFrame([(1, "x one two three four five si"), (2, "one two three four"), (3, "b"), (4, "zz"), (5, "")], "task int, want string")
    assert {(r.task, r.item) for r in evaluate.containing(texts, want).collect()} == {(1, 1), (2, 1), (3, 4)}


def test_symbol_mode(spark):
    text = "\n".join(["x"] * 5 + ["the needle is here"] + ["y"] * 40)
    got = outline.symbol_lines("md", text, "needle").split("\n")
    assert got[0] == "4|x" and got[2] == "6|the needle is here" and len(got) == 32
    assert outline.symbol_lines("md", text, "needle", 20).startswith("18|y") and outline.symbol_lines("md", text, "no") == "Symbol not found: no"
    parts = "--- a ---\n1|a\n\n--- b ---\nSymbol not found: b"
    assert one(spark, outline.only_found(F.col("t")), t=parts) == "--- a ---\n1|a"
    assert one(spark, compress.shell_output(F.col("t"), F.lit(True)), t="ok\nIt Failed\nok") == "It Failed"
    assert one(spark, turns.context_lines(F.lit(" "), F.col("t")), t="x" * 500) == "x" * 420


def test_tools(spark):
    from lumenlake import api

    rows = [
        ("src/api/auth.js", "import { hash } from '../util.js';\nexport function requireAuth(req) {\n  return hash(req);\n}\n"), ("src/util.js", "export const hash = (x) => x;\n"),
        ("tests/auth.test.js", "import { requireAuth } from '../src/api/auth.js';\ntest('requireAuth', () => {});\n"), ("src/app.js", "import './api/auth.js';\nrequireAuth();\n"), ("notes.md", "nothing of use\n"),
    ]
    files_ = spark.createDataFrame(rows, "path string, text string")
    index = api.build_index(files_)
    assert tuple(api.index_counts(index).first()) == (4, 2)
    kinds = {(r.src, r.dst, r.kind) for r in index.edges.collect()}
    assert {("src/api/auth.js", "src/util.js", "import"), ("src/app.js", "src/api/auth.js", "import"), ("tests/auth.test.js", "src/api/auth.js", "testOf")} <= kinds
    best = api.find(files_, "requireAuth", "debug", index).collect()
    assert [r.boost_source for r in best if r.path == "src/api/auth.js"] == ["index"] and {r.path for r in best if r.boost_source == "graph"} == {"tests/auth.test.js", "src/app.js"}
    assert api.read_symbols(files_.where("path like '%auth.js' and path like 'src%'"), ["requireAuth"]).first().found.split("\n")[0] == "2|export function requireAuth(req) {"
    assert {r.path: r.text for r in api.read_lines(files_, 2, 2).collect()}["src/app.js"] == "2|requireAuth();"
    plan = {r.rel: r.role for r in api.context(files_, index, "fix the error in requireAuth", changed=files_.where("path = 'src/api/auth.js'")).collect()}
    assert plan == {"src/api/auth.js": "primary", "src/util.js": "dependency", "tests/auth.test.js": "test", "src/app.js": "dependent"}
    prompts = spark.createDataFrame([(1, "fix the login session cache bug in the auth module", "s"), (2, "write a poem about rivers and mountains today", "s"), (3, "short", "z")], "turn int, prompt string, session_id string")
    found = spark.createDataFrame([("s", "goal: login session cache", False)], "session_id string, summary string, ambiguous boolean")
    got = {r.turn: (r.state, r.reuse, r.goal is not None) for r in api.turn_start(prompts, found).collect()}
    assert got == {1: ("aligned", True, False), 2: ("mismatch", False, True), 3: ("cold_start", False, False)}
