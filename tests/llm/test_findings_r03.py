"""Faults that the review of round 3 found in the training-data operators."""

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenlake.llm import common, hnsw, jaccard, katz, token_ids


def test_hits_of_large_groups_come_in_parts(monkeypatch):
    """A group far wider than the beam is followed link by link, found whole, and never held at once."""
    r = np.random.default_rng(3)
    x = r.standard_normal((5000, 32))
    x[:2000] = x[0] + 0.02 * r.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = pickle.loads(pickle.dumps(hnsw.Graph(x)))
    beam, recall = hnsw.audit(g, 0.95)
    assert beam < 200 and recall >= hnsw.AUDIT
    monkeypatch.setattr(hnsw, "HITS", 10_000)
    q = np.concatenate([x[:100], x[2000:2100]])
    parts = list(g.hits(q, 0.95, beam))
    assert max(len(row) for row, _ in parts) < 10_000 + 256 * beam
    got = np.bincount(np.concatenate([row for row, _ in parts]), minlength=200)
    want = (q @ x.T >= 0.95).sum(1)
    assert (got <= want).all() and got[:100].sum() >= 0.999 * want[:100].sum() and got[100:].sum() >= 0.99 * want[100:].sum()


def test_answers_of_all_orders_meet_blocks_in_one_join(spark, monkeypatch):
    """A task groups, sorts and joins one table of answers, whatever the order; and a task that sorts requests holds few partitions."""
    plans = {}
    write = katz.materialise
    monkeypatch.setattr(katz, "materialise", lambda df, name: plans.setdefault(name, df) and write(df, name))
    docs = spark.createDataFrame([(k, f"a b c {k % 3} a b") for k in range(12)], "doc_id long, text string")
    got = katz.katz(docs, F.col("doc_id") == 5, 3).collect()
    assert len(got) == 12 and {r.n_tokens for r in got} == {7}
    plan = plans["scores"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 1
    asked = spark.createDataFrame([], katz._ASK)
    assert katz._met(asked, 7)._jdf.queryExecution().analyzed().toString().count("], 32") == 1


def test_a_task_takes_one_python_worker(spark, monkeypatch):
    """Two steps of Python on end would take two workers a core, and these keep their memory."""
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(64)], "doc_id long, text string")
    plans, collect = [], type(docs).collect
    with monkeypatch.context() as m:
        m.setattr(type(docs), "collect", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or collect(df))
        encoded = common.materialise(token_ids.encode(docs.select("doc_id", "text", F.col("doc_id").alias("file"), F.col("doc_id").alias("place"))), "ids")
        assert len(token_ids.ranking(encoded))
        need = common.materialise(spark.range(100).select(F.xxhash64("id").alias("cls")), "need")
        got = jaccard._bits(need, 12)
    assert [p.count("MapInArrow") for p in plans] == [1, 1]
    want = np.zeros(1 << 12, bool)
    want[[(r.cls & (1 << 64) - 1) >> 52 for r in need.collect()]] = True
    assert (got == want).all()


def test_small_tables_of_the_driver_need_no_python_worker(spark):
    df = common.held(spark, a=pa.array(["x", None], pa.string()), n=pa.array([1, 2], pa.int64()), b=pa.array([b"\0\1", b""], pa.binary()))
    assert df.schema.simpleString() == "struct<a:string,n:bigint,b:binary>" and [tuple(r) for r in df.collect()] == [("x", 1, b"\0\1"), (None, 2, b"")]
    assert common.held(spark, a=pa.array([], pa.string())).count() == 0
    assert "Python" not in df._jdf.queryExecution().toRdd().toDebugString() and "Python" in spark.createDataFrame([(1,)], "n long")._jdf.queryExecution().toRdd().toDebugString()
