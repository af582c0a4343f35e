"""Faults that the review of round 3 found in queries."""

import random
import re
from concurrent.futures import ThreadPoolExecutor

import duckdb
from pyspark.sql import functions as F

from lumenlake.functions import text as T
from lumenlake.operators import compress, graph, outline, script
from lumenlake.plans import registry as R
from lumenlake.sources import store


def both(spark, folder, name, table, rows, schema):
    """The rows of a query over one table, and those of its SQL."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    out = R.QUERIES[name](spark, str(folder))
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = c.sql(R.ORACLES[name])
    at = [want.columns.index(x) for x in out.columns]
    return sorted(map(tuple, out.collect()), key=repr), sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_ranges_of_long_lines_are_whole(spark, tmp_path):
    rows = [(1, "a\n" + "x" * 13_000 + "\nb\nc\nd", "s"), (2, None, "s"), (3, "", "s"), (4, "one", "s"), (5, "a\n\nb", "s")]
    got, want = both(spark, tmp_path, "read_range", "documents", rows, "doc_id long, text string, source string")
    assert got == want and len(got[0][1]) > 13_000


def test_range_join_counts_and_pairs_nothing(spark, tmp_path):
    r = random.Random(2)
    rows = [(k, r.choice([1, 2, None]), r.choice([None, 0.0, 1.0, 0.5, 2.0, 5.0, -1.0, -0.25, round(r.random() * 9, 2), r.random() * 3])) for k in range(500)] + [(7, 1, 1.0), (None, 1, 1.5)]
    got, want = both(spark, tmp_path, "rel_range_join", "part", rows, "p_partkey long, p_size int, p_retailprice double")
    assert got == want and len(got) > 200
    plan = R.QUERIES["rel_range_join"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join.*p_retailprice#\d+ >= |Join.*other", plan)


def test_parts_in_one_file_are_dealt_out(spark):
    """A table in one small file is no single task, where each of its rows is dear."""
    d = "/root/testdata/sf0.001"
    assert R._dealt(spark, d, "part").rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    for name in ("task_candidates", "script_symbols", "script_links", "python_outlines", "read_symbol"):
        assert "RepartitionByExpression" in R.QUERIES[name](spark, d)._jdf.queryExecution().analyzed().toString(), name


def test_hints_of_a_task_are_worked_out_once(spark):
    plan = R.QUERIES["seed_points"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(lower(task") == 1


def _strip(x):
    return x.strip(T.BLANK)


def _marked(text):
    kept = "\n".join(x for x in text.split("\n") if _strip(x).startswith(tuple(outline.OPENS)) or any(m in _strip(x) for m in outline.MARKS))
    return kept or text


def test_marked_lines_are_those_of_trimmed_lines(spark):
    ends = ["", " ", "\r", " ", " x", " x", "\t{"]
    texts = [f"plain\n{lead}{mark}{end}" for lead in ("", " \t", "　", "x ", "x ") for mark in [*outline.OPENS, *outline.MARKS, "return", "import"] for end in ends] + ["", "\n", "none here"]
    df = spark.createDataFrame([(x,) for x in texts], "text string").withColumn("got", outline.marked(F.col("text")))
    assert all(r.got == _marked(r.text) for r in df.collect())


def test_files_of_all_formats_are_read_in_one_pass(spark):
    d = "/root/testdata/sf0.001"
    for name in ("read_budget", "read_outlines", "read_signatures", "python_outlines"):
        plan = R.QUERIES[name](spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == 1 and "Union" not in plan, name
    rows = [("a.sh", "run"), ("a.zsh", "run"), ("b.hcl", "a = 1"), ("Dockerfile.x", "FROM a"), ("c.py", None), ("d.yml", "k: 1"), ("e.json", '{"k": 1}'), ("f", "x"), (None, "x"), ("g.mjs", "const a = 1"), ("h.txt", None), ("i.PY", "A = 1\nBC = 2")]
    got = {r.path: r.text for r in outline.read(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a.sh": "# Commands\nrun", "a.zsh": "# Commands\nrun", "b.hcl": "# Assignments\na", "Dockerfile.x": "# Docker stages\nFROM a", "c.py": "", "d.yml": "# YAML top-level\nk", "e.json": "# JSON outline\nk: 1", "f": "x", None: "x", "g.mjs": "# Outline\nconst a", "h.txt": None, "i.PY": "# Constants\nconst BC"}


def test_cascade_works_out_each_form_once(spark):
    plan = R.QUERIES["compress_cascade"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") <= 2
    r = random.Random(5)
    n = lambda x: len(re.findall(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]", x, re.ASCII))
    line = lambda: r.choice(["const a = 1", "  class B", "x" * r.randint(1, 400), "", "a.b, c!", "def f(x)"])
    texts = ["\n".join(line() for _ in range(r.randint(0, k))) for k in (2, 5, 12, 40, 900) for _ in range(20)]
    marker = "[truncated to fit 20 token budget]"

    def want(text):
        kept = _marked(text)
        forms = [text, *(kept if len(kept) <= c else f"{kept[:c]}\n\n[truncated {len(kept) - c} chars]" for c in (5000, 4000))]
        fit = next((f for f in forms if n(f) <= 20), None)
        if fit is None:
            lines, used, out = forms[-1].split("\n"), 0, []
            for x in lines:
                used += n(x)
                if used > 20 - n(marker):
                    break
                out.append(x)
            fit = "\n".join([*out, "\n" + marker])
        return fit

    df = spark.createDataFrame([(x,) for x in texts], "text string").withColumn("got", compress.cascade(F.col("text"), 20))
    assert all(x.got == want(x.text) for x in df.collect())


def test_postings_travel_once_and_stay_distinct(spark, tmp_path):
    r = random.Random(6)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(3000)] + ["Été", "I", "x_y", "7"]
    rows = [(r.choice([None, 1, 2, 3]) if k % 9 == 0 else k, r.choice([None, "", " ,"]) if k % 17 == 0 else " ".join(r.choices(words, k=r.randint(1, 30)))) for k in range(400)]
    got, want = both(spark, tmp_path, "inverted_index_postings", "documents", rows, "doc_id long, text string")
    assert got == want and len(got) > 2000
    # postings meet in one shuffle, of lists; there is no other
    plan = R.QUERIES["inverted_index_postings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lists_of_postings_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(graph, "GATHERED", 5)
    df = spark.createDataFrame([(k, ["a", f"b{k}", None, "a"]) for k in range(20)], "path long, names array<string>").coalesce(1)
    assert sorted(map(tuple, graph.inverted_index(df).collect())) == sorted([("a", k, 20) for k in range(20)] + [(f"b{k}", k, 1) for k in range(20)])


def test_patterns_of_tokens_are_tried_where_they_may_stand(monkeypatch):
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.n = pattern, 0

        def match(self, *at):
            self.n += 1
            return self.pattern.match(*at)

    tried = {k: Counted(getattr(script, k)) for k in ("_SPACE", "_STRING", "_WORD")}
    for k, v in tried.items():
        monkeypatch.setattr(script, k, v)
    s = script.Script("const a = 'b';\nf(a, 2) // c\n/x/.test(y)")
    assert s.text == ["const", "a", "=", "'b'", ";", "f", "(", "a", ",", "2", ")", "/", "x", "/", ".", "test", "(", "y", ")"] or "/x/" in s.text
    assert tried["_STRING"].n == 1 and tried["_WORD"].n <= 9 and tried["_SPACE"].n <= 9


def test_types_of_many_files_meet_no_pairs(spark):
    r = random.Random(7)
    text = [(f"p{r.randint(0, 60)}", " ".join(f"T{r.randint(0, 9)}" for _ in range(5))) for _ in range(80)]
    index = [(f"T{r.randint(0, 7)}", f"p{r.randint(0, 60)}", k) for k in range(90)]
    df = graph.type_references(spark.createDataFrame(text, "path string, text string"), spark.createDataFrame(index, "name string, path string, line int"))
    there = {}
    for name, path, _ in index:
        there.setdefault(name, set()).add(path)
    want = {(p, n, p if p in there[n] else min(there[n])) for p, t in text for n in t.split() if n in there}
    got = list(map(tuple, df.collect()))
    assert len(got) == len(want) and set(got) == want
    # what a name alone is joined with has one row a name
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[name#\d+\], \[name#\d+, min\(path#\d+\)", plan)


def test_a_version_is_claimed_by_one_writer(spark, tmp_path):
    fs, _ = store._fs(spark, f"file://{tmp_path}/a b")
    marks = [spark._jvm.org.apache.hadoop.fs.Path(f"file://{tmp_path}/a b/v{k}") for k in range(100)]
    fs.mkdirs(marks[0].getParent())
    with ThreadPoolExecutor(8) as pool:
        for mark in marks:
            assert sum(pool.map(lambda _, m=mark: store._claim(fs, m), range(8))) == 1
