"""Turns with state that ends, and imports that break off, come twice or come late."""

import datetime as dt

from pyspark.sql import functions as F

from lumenlake.sources import scratch
from lumenlake.streaming import imports, machine, streams

EVENTS = "key string, seq long, ts timestamp, event string, session_id string, state string, prompt string, answer string, tool string, phase string, action string, told string, paths array<string>, again boolean"
T0 = dt.datetime(2026, 1, 1)


def event(key, seq, hours, kind, prompt=None, tool=None, paths=None, answer=None, again=False, state="aligned"):
    return (key, seq, T0 + dt.timedelta(hours=hours), kind, f"p{key}", state, prompt, answer, tool, "end", None, "milestone", paths, again)


def run(spark, folder, batches, initial=None):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/b*")
    out = streams.drain(machine.machine(stream, initial), spark, "turns", "append", conf=machine.CONF)
    return {(r.key, r.seq): r for r in out.collect()}


ASK = "please repair the parser of numbers"


def test_turns_end_after_48_hours_of_event_time(spark, tmp_path):
    first = [event("a", 1, 0, "UserPromptSubmit", ASK), event("a", 2, 1, "PostToolUse", tool="Edit", paths=["x", "x", "y"]), event("b", 1, 0, "UserPromptSubmit", ASK), event("b", 2, 1, "PostToolUse", tool="Edit", paths=["x"]), event("c", 1, 0, "UserPromptSubmit", "go on"), event("c", 2, 1, "PostToolUse", tool="Edit", paths=["x"])]
    second = [event("a", 3, 48, "Stop", answer="ok"), event("b", 3, 50, "Stop", answer="ok"), event("c", 3, 48, "Stop", answer="ok"), event("a", 4, 48.5, "Stop", answer="Next step: look at all of it", again=True), event("a", 5, 48.6, "Stop", answer="ok")]
    third = [event("d", 1, 200, "UserPromptSubmit", ASK), event("a", 6, 201, "UserPromptSubmit", ASK), event("a", 7, 202, "UserPromptSubmit", ASK)]
    got = run(spark, tmp_path / "s", [first, second, third])
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("a", 3), ("a", 4), ("d", 1), ("a", 6), ("a", 7)}
    assert got["a", 3].blocked and not got["a", 3].carried and got["a", 4].carried and not got["a", 4].blocked
    assert (got["a", 4].touched, got["a", 4].focus, got["a", 4].next_step) == (["x", "y"], ASK, "look at all of it")
    assert got["a", 3].started == T0 and got["c", 1].started is None
    assert got["a", 6].started == got["a", 7].started == T0 + dt.timedelta(hours=201)


def test_turns_begin_from_a_table(spark, tmp_path):
    us = lambda h: int((T0 + dt.timedelta(hours=h) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    stored = spark.createDataFrame([("a", "pa", "aligned", "old focus", us(-5), us(-1), 1, False, None, ["f"])], f"key string, {machine.TURN}, touched array<string>")
    got = run(spark, tmp_path / "s", [[event("a", 1, 1, "Stop", answer="ok", again=True), event("b", 1, 1, "Stop", answer="ok")]], stored)
    assert set(got) == {("a", 1)} and got["a", 1].carried and got["a", 1].touched == ["f"] and got["a", 1].focus == "old focus" and got["a", 1].started == T0 - dt.timedelta(hours=5)


def test_state_goes_when_its_time_is_over(spark, tmp_path):
    """A timer clears what no event comes for: the watermark passes 48 hours, and the state has no turn left."""
    rows = [[event("a", 1, 0, "UserPromptSubmit", ASK)], [event("b", 1, 60, "SessionStart")], [event("b", 2, 61, "SessionStart")]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/s/b{i}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s/b*")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", machine.CONF["spark.sql.streaming.stateStore.providerClass"])
    try:
        at = scratch.folder(spark, "state")
        q = machine.machine(stream).writeStream.outputMode("append").foreachBatch(lambda b, i: b.count()).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.read.format("statestore").option("path", at).option("stateVarName", "turn").load().count() == 0
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_imports_count_once(spark, tmp_path):
    root, kinds = f"{tmp_path}/store", "kind string, payload string, ts timestamp"
    at = lambda h: T0 + dt.timedelta(hours=h)
    rows = spark.createDataFrame([("session", '{"sessionId": "s", "updatedAt": "2026-01-01 00:00:00", "goal": "old"}', at(0)), ("session", "no json", at(0)), ("metric", '{"a": 1}', at(0)), ("metric", '{"a": 1}', at(1)), ("metric", None, at(1)), ("active", '{"sessionId": "s"}', at(1)), ("active", '{"sessionId": "gone"}', at(2))], kinds)
    # a batch that broke off left rows and no line in the ledger: nobody sees them, and they are written over
    rows.limit(0).selectExpr("payload session_id", "ts updated_at", "payload").union(spark.createDataFrame([("ghost", at(0), "{}")], "a string, b timestamp, c string")).write.parquet(f"{root}/sessions/batch=x-0")
    assert imports.sessions(spark, root).count() == 0 and imports.active(spark, root).first().session_id is None
    assert imports.import_batch(rows, "x-0", root) and not imports.import_batch(rows, "x-0", root)
    ledger = lambda: {(r.batch, r.kind): (r.imported, r.skipped, r.late) for r in imports.stored(spark, root, "ledger").collect()}
    assert ledger() == {("x-0", "session"): (1, 1, 0), ("x-0", "metric"): (1, 2, 0), ("x-0", "active"): (1, 1, 0)}
    assert [r.session_id for r in imports.sessions(spark, root).collect()] == ["s"] and imports.active(spark, root).first().session_id == "s"
    more = spark.createDataFrame([("session", '{"sessionId": "s", "updatedAt": "2026-01-02 00:00:00", "goal": "new"}', at(9)), ("metric", '{"a": 1}', at(-9)), ("metric", '{"a": 2}', at(-9)), ("active", '{"sessionId": "s"}', at(9))], kinds)
    assert imports.import_batch(more, "x-1", root)
    assert ledger()["x-1", "metric"] == (1, 1, 2) and imports.metrics(spark, root).count() == 2
    assert imports.sessions(spark, root).select(F.get_json_object("payload", "$.goal")).first()[0] == "new"
    assert imports.import_batch(rows.limit(0), "x-2", root) and ledger()["x-2", "metric"] == (0, 0, 0)
