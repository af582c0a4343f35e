"""Ranks by refinement, types near symbols, texts under a budget and writers at the same time, against plain versions."""

import math
import random
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from lumenlake.operators import evaluate, graph, planning, ranks, sessions
from lumenlake.sources import store


def test_percentiles_by_ranges(spark, monkeypatch):
    r = random.Random(1)
    rows = [("hot", float(r.choice([1, 2, 3]))) for _ in range(300)] + [("wide", r.choice([-1, 1]) * 10.0 ** r.uniform(-30, 30)) for _ in range(100)] + [("one", 7.5), ("none", None), (None, 3.0), (None, 4.0), ("ends", float("inf")), ("ends", float("-inf")), ("ends", float("nan")), ("ends", 0.0), ("ends", 5.0)] + [("tied", 1.0)] * 9
    d = spark.createDataFrame(rows, "g string, v double")
    key = lambda v: (math.isnan(v), v if v == v else 0)
    for bins in (1024, 16):
        monkeypatch.setattr(ranks, "BINS", bins)
        got = {x.g: (x.a, x.b, x.c) for x in ranks.percentiles(d, "v", ["g"], {"a": 0.5, "b": 0.95, "c": 0.0}).collect()}
        want = {}
        for g in {g for g, _ in rows}:
            vs = sorted((v for h, v in rows if h == g and v is not None), key=key)
            if vs:
                want[g] = tuple(vs[max(1, math.ceil(round(p * len(vs), 9))) - 1] for p in (0.5, 0.95, 0))
        assert repr(sorted(got.items(), key=str)) == repr(sorted(want.items(), key=str))
    assert ranks.percentiles(d.limit(0), "v", ["g"], {"a": 0.5}).count() == 0


def test_greatest_rows(spark):
    r = random.Random(2)
    rows = list({(r.randrange(5), r.randrange(40)) for _ in range(120)})
    d = spark.createDataFrame([(*x, "y") for x in rows], "a int, b int, c string")
    for k in (1, 7, len(rows) - 1, len(rows), 10_000):
        assert sorted((x.a, x.b) for x in ranks.greatest(d, k, F.col("a"), F.col("b")).collect()) == sorted(rows)[-min(k, len(rows)) :]
    assert ranks.greatest(d.limit(0), 3, F.col("a"), F.col("b")).count() == 0
    events = d.select((F.col("a") * 100 + F.col("b")).alias("id"), F.timestamp_seconds(F.col("a")).alias("ts"))
    assert sessions.retained_overall(events, "ts", "id", 5, F.lit("2030-01-01").cast("timestamp")).count() == 5
    assert sessions.retained_overall(events, "ts", "id", 1, F.lit("1970-01-01 00:00:03").cast("timestamp")).count() == sum(a >= 3 for a, _ in rows)


def test_types_near_symbols(spark):
    r = random.Random(3)
    files = {f"f{i}": [" ".join(r.choice(["Alpha", "Beta", "Gamma_2", "xAlpha", "low", "Other"]) for _ in range(r.randrange(3))) for _ in range(150)] for i in range(3)}
    symbols = [(p, f"s{k}", r.randrange(1, 150)) for p in files for k in range(12)] + [("f0", "Alpha", 5)]
    index = [("f1", "Alpha", 1), ("a", "Alpha", 2), ("z", "Beta", 1), ("y", "Beta", 1), ("y", "Gamma_2", 3), ("y", "low", 1)]
    where = lambda t, p: p if (p, t) in {(x, n) for x, n, _ in index} else min(x for x, n, _ in index if n == t)
    want = set()
    for p, s, line in symbols:
        for t in ("Alpha", "Beta", "Gamma_2"):
            at = [n for n in range(line, line + 30) if n <= 150 and re.search(rf"(?<!\w){t}(?!\w)", files[p][n - 1])]
            if at and t != s:
                want.add((p, s, t, where(t, p), at[0]))
    # one name may stand for several symbols of a file: the first mention counts
    first = {}
    for p, s, t, a, n in want:
        first[p, s, t, a] = min(n, first.get((p, s, t, a), n))
    got = graph.types_near(spark.createDataFrame(symbols, "path string, name string, line int"), spark.createDataFrame([(p, "\n".join(x)) for p, x in files.items()], "path string, text string"), spark.createDataFrame(index, "path string, name string, line int")).collect()
    assert len(got) == len(first) and {(x.path, x.symbol, x.name, x["at"]): x.line for x in got} == first


def test_texts_under_a_budget(spark):
    r = random.Random(4)
    plan = [(t, k, f"{t}/{k}", r.randrange(1, 15), r.random() < 0.7) for t in range(30) for k in range(1, 1 + r.randrange(1, 10))]
    texts = [(t, rel, "w " * r.randrange(40)) for t, k, rel, _, _ in plan if r.random() < 0.9]
    said = {(t, rel): x for t, rel, x in texts}
    want = {}
    for t in range(30):
        mine = sorted(x for x in plan if x[0] == t)
        used, kept = 0, []
        for x in mine:
            if kept and used + x[3] > 60:
                break
            kept.append(x)
            used += x[3]
        for x in kept:
            n = len(said.get((t, x[2]), "").split())
            give = x[4] and n > 0 and (x[1] == 1 or used + n <= 60)
            used += n * give
            want[t, x[1]] = x[3] + n * give
    d = spark.createDataFrame(plan, "task int, place int, rel string, base_tokens long, read_text boolean")
    out = planning.with_texts(d, spark.createDataFrame(texts, "task int, rel string, text string"), 60).collect()
    assert {(x.task, x.place): x.tokens for x in out} == want and len(out) == len(want)


def test_ends_of_paths(spark):
    r = random.Random(5)
    names = ["a.js", "aa.js", "b.js", "x/a.js", "x/b.js", "/y/x/a.js", "js", ""]
    expected = list({(r.randrange(4), r.choice(names[:-1])) for _ in range(25)})
    got = [(t, p, k + 1) for t in range(4) for k, p in enumerate(r.sample(["/q/" + n for n in names] + names, 9))]
    want = {(t, e): min((k for u, p, k in got if u == t and p.endswith(e)), default=None) for t, e in expected}
    out = evaluate.matched(spark.createDataFrame(expected, "task int, path string"), spark.createDataFrame(got, "task int, path string, rank int")).collect()
    assert {(x.task, x.expected): x.rank for x in out} == want


def test_two_writers_keep_both_keys(spark, tmp_path):
    root = f"{tmp_path}/meta"
    store.set_meta(spark, root, a="0")
    with ThreadPoolExecutor(3) as pool:
        done = [pool.submit(store.set_meta, spark, root, **{k: "1"}) for k in "bcd"]
        assert sorted(x.result() for x in done) == [2, 3, 4]
    assert {k: store.get_meta(spark, root, k) for k in "abcd"} == {"a": "0", "b": "1", "c": "1", "d": "1"}


def test_files_passed_over_and_single_ones(spark, tmp_path):
    import pytest

    from lumenlake.operators import search
    from lumenlake.sources import files

    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, body in (("src/a.py", b"x = 1\n"), ("src/b.py", b"x\x00y"), ("src/c.md", b"y" * 2000), ("src/d.bin", b"\x00"), ("node_modules/e.js", b"\x00"), ("yarn.lock", b"z")):
        (tmp_path / name).write_bytes(body)
    over = files.passed_over(spark, str(tmp_path), most=1000)
    assert {(r.reason, r.n) for r in over.collect()} == {("binary", 1), ("too large", 1)}
    assert tuple(search.confidence(over).first()) == ("low", 2) and tuple(search.confidence(over.limit(0)).first()) == ("medium", 0) and search.confidence(over, whole=True).first().confidence == "high"
    assert files.one_file(spark, str(tmp_path), "src/../src/a.py").first().text == "x = 1\n"
    with pytest.raises(ValueError):
        files.one_file(spark, str(tmp_path), "../a.py")


def test_full_report(spark):
    import datetime as dt

    from lumenlake import api

    day = lambda n: dt.datetime(2026, 1, n)
    rows = [("read", 100, 20, 0, day(9), 1), ("read", 50, 60, 5, day(8), 2), ("find", 0, 0, 7, day(9), 3), (None, 10, None, 0, day(1), 4)]
    e = spark.createDataFrame(rows, "tool string, raw_tokens long, final_tokens long, overhead_tokens long, created_at timestamp, metric_id int").withColumns({"compressed_tokens": F.lit(None).cast("long"), "saved_tokens": F.lit(None).cast("long"), "session_id": F.lit("s")})
    totals, costs, latest = api.full_report(e, F.lit(day(10)), "7d", 2)
    assert {(r.tool, r.n, r.saved_tokens) for r in totals.collect()} == {("read", 2, 80), ("find", 1, 0), (None, 3, 80)}
    assert {(r.tool, r.overhead_tokens, r.overhead_pct) for r in costs.collect()} == {("read", 5, 3.33), ("find", 7, 4.67)}
    assert [r.metric_id for r in latest.collect()] == [3, 1]
