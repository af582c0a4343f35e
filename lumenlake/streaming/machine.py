"""The state machine of turns: what a session's start, prompts, tool calls and stops leave behind.

A prompt that says enough opens a turn; tool calls note files and checkpoints; a stop is let through, blocked until the turn is saved, or, if it
comes again, lets the turn's rest be carried over. All that a row says by itself is worked out by column expressions before the machine,
which only keeps what must be remembered: a value (the turn) and a map (its files) for each key. A turn that nothing has
touched for TTL_HOURS is forgotten: by event time for what comes after it, by a timer so that its state goes too."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..operators import turns

TTL_HOURS = 48
_TTL_US = TTL_HOURS * 3_600_000_000
#: what Spark needs for this kind of state
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
TURN = "session_id string, state string, focus string, started long, updated long, writes int, checkpointed boolean, checkpoint string"
OUT = "key string, seq long, action string, session_id string, blocked boolean, carried boolean, state string, started long, focus string, touched array<string>, next_step string"
_OUT = [x.split()[0] for x in OUT.split(", ")]


def prepared(events: DataFrame) -> DataFrame:
    """events(key, seq, ts, event, session_id, state, prompt, answer, tool, phase, action, told, paths, again) with what each row says.

    event: SessionStart, UserPromptSubmit, PostToolUse or Stop; told: the kind of checkpoint that a call names; paths: files that
    a call names; again: whether a stop comes after one that was blocked."""
    answer = F.coalesce("answer", F.lit(""))
    wrote = F.when(F.col("tool").isin(turns.WRITE_TOOLS), T.merge_unique(F.coalesce("paths", F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))
    return events.select(
        F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event",
        F.col("session_id").cast("string").alias("session_id"), "state", (F.col("session_id").isNotNull() & turns.meaningful_prompt(F.col("prompt"))).alias("tracks"), T.shorten(T.collapse(F.coalesce("prompt", F.lit(""))), turns.FOCUS).alias("focus"),
        turns.checkpoint_use(F.col("tool"), F.col("phase"), F.col("action"), F.col("told")).alias("checkpoint"), wrote.alias("wrote"), T.next_step(answer).alias("next_step"), (F.length(T.collapse(answer)) >= turns.LONG_ANSWER).alias("long"),
        F.coalesce("again", F.lit(False)).alias("again"),
    )


class Turns(StatefulProcessor):
    """Rows of a key are taken in order of time and number; a batch holds those of one trigger."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", TURN)
        self.files = handle.getMapState("files", "path string", "place int")

    def _load(self) -> tuple[dict | None, list[str]]:
        if not self.turn.exists():
            return None, []
        names = [x.split()[0] for x in TURN.split(", ")]
        files = sorted((place[0], path[0]) for path, place in self.files.iterator()) if self.files.exists() else []
        return dict(zip(names, self.turn.get())), [p for _, p in files]

    def _save(self, now: dict | None, files: list[str]) -> None:
        self.turn.clear()
        self.files.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if now is not None:
            self.turn.update(tuple(now.values()))
            for i, p in enumerate(files):
                self.files.updateValue((p,), (i,))
            self.handle.registerTimer((now["updated"] + _TTL_US) // 1000 + 1)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        """A stored turn: (key, the columns of TURN, touched)."""
        row = initialState.iloc[0]
        now = {n: None if row[n] is None or row[n] != row[n] else row[n] for n in (x.split()[0] for x in TURN.split(", "))}
        now |= {"started": int(now["started"]), "updated": int(now["updated"]), "writes": int(now["writes"] or 0), "checkpointed": bool(now["checkpointed"])}
        self._save(now, list(row["touched"]) if row["touched"] is not None else [])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now, files = self._load()
        out: list[tuple] = []
        batch = pd.concat(list(rows)).sort_values(["us", "seq"], kind="stable")

        def told(r, action: str, turn: dict | None, blocked: bool = False, carried: bool = False) -> None:
            t = turn or {}
            out.append((key[0], r.seq, action, t.get("session_id") if turn else r.session_id, blocked, carried, t.get("state") if turn else r.state, t.get("started"), t.get("focus") if carried else None, list(files) if carried else None, (r.next_step or None) if carried else None))

        for r in batch.itertuples(index=False):
            if now and r.us - now["updated"] > _TTL_US:
                now, files = None, []
            if r.event == "SessionStart":
                told(r, r.event, None)
            elif r.event == "UserPromptSubmit":
                started = now["started"] if now else r.us
                now, files = ({"session_id": r.session_id, "state": r.state, "focus": r.focus, "started": int(started), "updated": int(r.us), "writes": 0, "checkpointed": False, "checkpoint": None} if r.tracks else None), []
                told(r, r.event, now)
            elif now and r.event == "PostToolUse":
                wrote = list(r.wrote) if r.wrote is not None else []
                files = list(dict.fromkeys([*files, *wrote]))
                now["writes"] += len(wrote)
                now["updated"] = int(r.us)
                if r.checkpoint is not None:
                    now |= {"checkpointed": True, "checkpoint": r.checkpoint}
                if wrote or r.checkpoint is not None:
                    told(r, r.event, now)
            elif now and r.event == "Stop":
                points = 3 * (now["writes"] > 0) + (len(files) > 0) + 2 * (r.next_step != "") + bool(r.long) + (now["state"] in ("task_switch", "possible_shift"))
                block = points >= turns.BLOCK_FROM and not now["checkpointed"]
                told(r, r.event, now, block and not r.again, bool(block and r.again))
                if not block or r.again:
                    now, files = None, []
        self._save(now, files)
        yield pd.DataFrame(out, columns=_OUT)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now, _ = self._load()
        if now is None or now["updated"] + _TTL_US <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self._save(None, [])
        yield pd.DataFrame([], columns=_OUT)

    def close(self) -> None:
        pass


def machine(events: DataFrame, initial: DataFrame | None = None, late: str = "1 hour") -> DataFrame:
    """(key, seq, action, session_id, blocked, carried, state, started, focus, touched, next_step): what the machine notes of a stream of events.

    A stop is blocked, or lets its turn's focus, files and next step be carried over (carried); started stays over the prompts of
    a turn that goes on. initial: stored turns (key, the columns of TURN, touched), one row a key. The query needs CONF."""
    rows = prepared(events).withWatermark("ts", late)
    stored = initial.groupBy("key") if initial is not None else None
    out = rows.groupBy("key").transformWithStateInPandas(Turns(), OUT, "Append", "EventTime", stored)
    return out.withColumn("started", F.timestamp_micros("started"))
