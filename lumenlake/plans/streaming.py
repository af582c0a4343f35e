"""Queries over streams that keep state: turns, and imports that come twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import scratch
from ..streaming import imports, machine, streams
from .registry import _stream, query

_LONG = "'We looked into it and found that ' || repeat('the parts of it work as they should ', 4)"
_STOP = "case event_id % 3 when 0 then 'Done. Next step: look at ' || event_id || ' again' when 1 then 'ok' else " + _LONG + " end"


def _turn_events(spark, d):
    """Events of users as events of turns, a user a key."""
    i = F.col("event_id")
    s = i.cast("string")
    kind = F.when(i % 11 == 0, "SessionStart").when(i % 11 < 4, "UserPromptSubmit").when(i % 11 < 8, "PostToolUse").otherwise("Stop")
    prompt = F.when(i % 5 == 0, "go on").otherwise(F.concat(F.lit("please repair the parser of "), "event_type", F.lit(" number "), s))
    answer = F.when(i % 3 == 0, F.concat(F.lit("Done. Next step: look at "), s, F.lit(" again"))).when(i % 3 == 1, "ok").otherwise(F.concat(F.lit("We looked into it and found that "), F.repeat(F.lit("the parts of it work as they should "), 4)))
    tool = F.when(i % 4 < 2, "Edit").when(i % 16 == 2, "mcp__x__smart_turn").otherwise("Read")
    return _stream(spark, d).select(
        F.col("user_id").alias("key"), i.alias("seq"), "ts", kind.alias("event"), F.when(i % 13 > 0, F.concat(F.lit("p"), F.col("user_id").cast("string"))).alias("session_id"),
        F.when(i % 2 == 0, "aligned").otherwise("possible_shift").alias("state"), prompt.alias("prompt"), answer.alias("answer"), tool.alias("tool"), F.lit("end").alias("phase"), F.lit(None).cast("string").alias("action"),
        F.lit("milestone").alias("told"), F.array(F.concat(F.lit("f"), (i % 7).cast("string")), F.when(i % 8 == 0, "g")).alias("paths"), (i % 6 == 0).alias("again"),
    )


@query(
    "with e as (select user_id k, event_id i, ts, case when event_id % 11 = 0 then 'SessionStart' when event_id % 11 < 4 then 'UserPromptSubmit' when event_id % 11 < 8 then 'PostToolUse' else 'Stop' end ev, case when event_id % 13 > 0 then 'p' || user_id end sid, case when event_id % 2 = 0 then 'aligned' else 'possible_shift' end st, event_id % 5 <> 0 and event_id % 13 > 0 tracks, "
    "case when event_id % 4 < 2 then case when event_id % 8 = 0 then ['f' || event_id % 7, 'g'] else ['f' || event_id % 7] end else [] end wrote, event_id % 16 = 2 chk, case when event_id % 3 = 0 then 'look at ' || event_id || ' again' else '' end nxt, event_id % 3 = 2 long, event_id % 6 = 0 again, 'please repair the parser of ' || event_type || ' number ' || event_id focus from events), "
    "a as (select *, count(*) filter (where ev = 'UserPromptSubmit') over (partition by k order by ts, i) seg, max(case when ev in ('UserPromptSubmit', 'PostToolUse') then ts end) over (partition by k order by ts, i rows between unbounded preceding and 1 preceding) upd from e), "
    # of a segment: its prompt, and from where on it is too old
    "p as (select k, seg, sid psid, st pst, tracks ptracks, focus pfocus, ts pts, i pi, upd pupd from a where ev = 'UserPromptSubmit'), "
    "b as (select a.*, psid, pst, ptracks, pfocus, max((a.ev <> 'UserPromptSubmit' and a.ts - a.upd > interval 48 hours)::int) over (partition by a.k, a.seg order by a.ts, a.i) old, sum(case when a.ev = 'PostToolUse' then len(wrote) else 0 end) over (partition by a.k, a.seg order by a.ts, a.i) writes, max(case when a.ev = 'PostToolUse' then chk::int else 0 end) over (partition by a.k, a.seg order by a.ts, a.i) saved from a left join p using (k, seg)), "
    "c as (select *, case when ev = 'Stop' then case when 4 * (writes > 0)::int + 2 * (nxt <> '')::int + long::int + (pst = 'possible_shift')::int >= 3 and saved = 0 then case when again then 'carried' else 'blocked' end else 'through' end end fate from b), "
    "f as (select *, coalesce(max((fate in ('carried', 'through') and old = 0)::int) over (partition by k, seg order by ts, i rows between unbounded preceding and 1 preceding), 0) over_ from c), "
    # a prompt goes on with the turn before it if that is still there
    "z as (select k, seg, max(over_ + (coalesce(fate in ('carried', 'through'), false) and old = 0)::int) ended, max(old) old from f group by 1, 2), "
    "q as (select p.*, ptracks and coalesce(lag(ptracks) over w, false) and lag(z.ended) over w = 0 and lag(z.old) over w = 0 and pts - pupd <= interval 48 hours goes from p join z using (k, seg) window w as (partition by k order by seg)), "
    "h as (select *, count(*) filter (where not goes) over (partition by k order by seg) isl from q), j as (select k, seg, min(pts) over (partition by k, isl) started from h), "
    "live as (select f.*, j.started from f left join j using (k, seg) where ptracks and old = 0 and over_ = 0), "
    "w as (select l.k, l.i, (select string_agg(x, ',' order by o) from (select x, min(m.i * 4 + n) o, min((m.ts, m.i, n)) from live m, range(1, 3) r(n), lateral (select m.wrote[n] x) where m.k = l.k and m.seg = l.seg and m.ev = 'PostToolUse' and (m.ts, m.i) < (l.ts, l.i) and n <= len(m.wrote) group by x)) fs from live l where l.ev = 'Stop' and l.fate = 'carried') "
    "select k::varchar \"key\", i seq, 'SessionStart' \"action\", sid session_id, false blocked, false carried, st state, null::timestamp started, null focus, null n_touched, null next_step from e where ev = 'SessionStart' "
    "union all select p.k::varchar, pi, 'UserPromptSubmit', psid, false, false, pst, case when ptracks then j.started end, null, null, null from p join j using (k, seg) "
    "union all select k::varchar, i, ev, psid, false, false, pst, started, null, null, null from live where ev = 'PostToolUse' and (len(wrote) > 0 or chk) "
    "union all select l.k::varchar, l.i, ev, psid, fate = 'blocked', fate = 'carried', pst, started, case when fate = 'carried' then pfocus end, case when fate = 'carried' then len(string_split(coalesce(w.fs, ''), ',')) - (w.fs is null)::int end::int, case when fate = 'carried' and nxt <> '' then nxt end from live l left join w on w.k = l.k and w.i = l.i where ev = 'Stop'"
)
def turn_machine(spark, d):
    """All events of all users through the machine of turns."""
    out = streams.drain(machine.machine(_turn_events(spark, d)), spark, "turn_machine", "append", once=True, conf=machine.CONF)
    return out.select("key", "seq", "action", "session_id", "blocked", "carried", "state", F.col("started").cast("timestamp_ntz").alias("started"), "focus", F.size("touched").alias("n_touched"), "next_step")


_IMP = "(select event_id i, ts, case event_id % 4 when 0 then 'session' when 3 then 'active' else 'metric' end kind, case when event_id % 20 = 0 then 'oops' when event_id % 4 = 0 then 's' || user_id when event_id % 4 = 3 then 's' || (user_id + event_id % 3 * 1000) else event_type || '/' || user_id end p from events)"


@query(
    f"with r as {_IMP}, s as (select distinct p from r where kind = 'session' and p <> 'oops'), "
    "n as (select kind, count(*) n, max(ts) newest, case kind when 'metric' then count(distinct p) when 'session' then count(*) filter (where p <> 'oops') else count(*) filter (where p in (select p from s)) end got from r group by kind), "
    "l as (select kind, count(*) filter (where ts < (select max(ts) from events) - interval 1 hour) late from r group by kind) "
    "select 'a-0' batch, kind, got imported, n - got skipped, 0 late from n union all select 'b-0', kind, case when kind = 'metric' then 0 else got end, n - case when kind = 'metric' then 0 else got end, late from n join l using (kind) "
    "union all select 'stored', 'session', (select count(*) from s), 0, 0 union all select 'stored', 'metric', (select count(distinct p) from r where kind = 'metric'), 0, 0 "
    "union all select 'stored', 'active', (select arg_max(substr(p, 2)::bigint, (ts, p)) from r where kind = 'active' and p in (select p from s)), 0, 0"
)
def stream_import(spark, d):
    """An import that is run, run again from its start, and sent once more under another name: the ledger and what is stored."""
    i, user = F.col("event_id"), F.col("user_id")
    kind = F.when(i % 4 == 0, "session").when(i % 4 == 3, "active").otherwise("metric")
    id_ = F.concat(F.lit("s"), F.when(i % 4 == 3, user + i % 3 * 1000).otherwise(user).cast("string"))
    payload = F.when(i % 20 == 0, "oops").when(kind == "metric", F.to_json(F.struct("event_type", "user_id"))).otherwise(F.to_json(F.struct(id_.alias("sessionId"), F.col("ts").cast("string").alias("updatedAt"))))
    rows = _stream(spark, d).select(kind.alias("kind"), payload.alias("payload"), "ts")
    root = scratch.folder(spark, "imported")
    for source in ("a", "a", "b"):
        imports.import_stream(rows, root, source).awaitTermination()
    ledger = imports.stored(spark, root, "ledger").select("batch", "kind", "imported", "skipped", "late")
    zero = F.lit(0).cast("long")
    total = lambda df, kind, n: df.agg(F.lit("stored").alias("batch"), F.lit(kind).alias("kind"), n.alias("imported"), zero.alias("skipped"), zero.alias("late"))
    return ledger.union(total(imports.sessions(spark, root), "session", F.count("*"))).union(total(imports.metrics(spark, root), "metric", F.count("*"))).union(total(imports.active(spark, root), "active", F.max(F.substring("session_id", 2, 20).cast("long"))))
