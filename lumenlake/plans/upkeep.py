"""Queries over sessions, turns, checkpoints and the upkeep of state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics, planning, search, sessions, state, turns
from ..sources import files
from . import fixed as X
from .registry import _log, _signature_sql, _t, query
from ..operators import patterns

_STATES = "['in_progress', 'blocked', 'completed', 'planning', 'odd']"


def _pairs(spark, d):
    """For each event the state of a session before and after it; every seventh is a new session."""
    e = _t(spark, d, "events")
    i = F.col("event_id")
    status = F.element_at(F.array(*(F.lit(s) for s in ["in_progress", "blocked", "completed", "planning", "odd"])), (i % 5 + 1).cast("int"))
    later = F.element_at(F.array(*(F.lit(s) for s in ["in_progress", "blocked", "completed", "planning", "odd"])), ((i / 5).cast("int") % 5 + 1).cast("int"))
    text = lambda x: x.cast("string")
    items = lambda n: F.transform(F.sequence(F.lit(0), n.cast("int")), lambda x: F.concat(F.lit("x"), x.cast("string")))
    bare = F.array().cast("array<string>")
    state_ = lambda goal, st, done, files_, step, blockers: F.struct(goal.alias("goal"), st.alias("status"), F.lit("").alias("current_focus"), F.lit(None).cast("string").alias("why_blocked"), step.alias("next_step"), bare.alias("pinned_context"), bare.alias("unresolved_questions"), done.alias("completed"), bare.alias("decisions"), blockers.alias("blockers"), files_.alias("touched_files"))
    before = state_(text(i % 2), status, items(i % 3), items(i % 2), F.lit("go"), F.array(text(i % 3)))
    after = state_(text(i % 4 % 2 * (i % 4)), later, items(i % 6), items(i % 5), F.when(i % 4 == 0, "stop").otherwise("go"), F.array(text(i % 6)))
    kinds = F.element_at(F.array(*(F.lit(k) for k in [" Milestone ", "decision", "blocker", "status_change", "file_change", "task_switch", "task_complete", "session_end", "read_only", "heartbeat", "manual", "never heard"])), (i % 12 + 1).cast("int"))
    return e.select("event_id", F.when(i % 7 > 0, before).alias("before"), after.alias("after"), kinds.alias("kind"), (i % 31 == 0).alias("force"))


_CHECK = (
    "with e as (select event_id i from events), s as (select i, i % 7 = 0 fresh, (%s)[i %% 5 + 1] s1, (%s)[i // 5 %% 5 + 1] s2, i %% 2 g1, i %% 4 %% 2 * (i %% 4) g2, i %% 3 d1, i %% 6 d2, i %% 2 f1, i %% 5 f2, i %% 4 = 0 step, i %% 3 b1, i %% 6 b2 from e), "
    "n as (select *, case when s1 = 'odd' then 'in_progress' else s1 end z1, case when s2 = 'odd' then 'in_progress' else s2 end z2 from s), "
    "p as (select *, case when g1 <> g2 then 5 else 0 end pg, case when z1 <> z2 then 4 + case when s2 in ('blocked', 'completed') or s1 = 'blocked' then 2 else 0 end else 0 end ps, case when d2 > d1 then 2 + least(2, d2 - d1 - 1) else 0 end pd, case when f2 - f1 >= 3 then 3 when f2 > f1 then 1 else 0 end pf, case when step then 4 else 0 end pn, case when b1 <> b2 then 4 else 0 end pb from n), "
    "c as (select *, pg + ps + pd + pf + pn + pb total, (['milestone', 'decision', 'blocker', 'status_change', 'file_change', 'task_switch', 'task_complete', 'session_end', 'read_only', 'heartbeat', 'manual', 'manual'])[i %% 12 + 1] kind, list_filter([case when pg > 0 then 'goal' end, case when ps > 0 then 'status' end, case when pn > 0 then 'next_step' end, case when pd > 0 then 'completed' end, case when pb > 0 then 'blockers' end, case when pf > 0 then 'touched_files' end], lambda x: x is not null) ch from p), "
    "k as (select *, case kind when 'milestone' then ['completed', 'decisions', 'next_step', 'touched_files', 'current_focus', 'pinned_context'] when 'decision' then ['decisions', 'pinned_context', 'next_step'] when 'blocker' then ['status', 'blockers', 'why_blocked', 'next_step'] when 'status_change' then ['status', 'next_step', 'why_blocked'] when 'file_change' then ['touched_files', 'completed', 'next_step'] when 'task_switch' then ['goal', 'current_focus', 'next_step', 'pinned_context'] when 'task_complete' then ['status', 'completed', 'decisions', 'next_step'] when 'session_end' then ['next_step', 'status', 'completed', 'decisions', 'touched_files'] else [] end need, case kind when 'manual' then 1 when 'status_change' then 3 when 'file_change' then 3 when 'session_end' then 3 when 'task_complete' then 5 else 4 end least_ from c) "
    "select i event_id, kind, case when fresh then 0 else total end::int score, case when i %% 31 = 0 then 'forced' when kind in ('read_only', 'heartbeat') then 'silent' when not fresh and len(ch) = 0 then 'unchanged' when len(need) > 0 and (fresh or len(list_intersect(need, ch)) = 0) then 'irrelevant' when not fresh and kind = 'file_change' and ch = ['touched_files'] and f2 - f1 < 2 then 'one_file' when kind = 'task_complete' and z2 <> 'completed' and (fresh or not list_contains(ch, 'completed')) then 'unfinished' when case when fresh then 0 else total end < least_ then 'insignificant' else 'kept' end why from k"
)


@query(_CHECK.replace("i % 7", "i %% 7") % (_STATES, _STATES))
def checkpoint_gate(spark, d):
    """Whether an update is worth a checkpoint: points of what it changes against the policy of its kind."""
    c = sessions.checkpoint(F.col("kind"), "before", "after", F.col("force"))
    return _pairs(spark, d).withColumn("c", c).select("event_id", F.col("c.event").alias("kind"), F.col("c.score").cast("int").alias("score"), F.col("c.why").alias("why"))


@query("select event_id session_id, 'g' || event_id goal, case event_id % 3 when 0 then 'blocked' when 1 then 'completed' else 'in_progress' end status, 'a,b' || case when event_id % 2 = 0 then ',c' else '' end completed, case when event_id % 4 = 0 then 'new' else 'old' end blockers from events")
def session_append(spark, d):
    """Updates merged into sessions: lists unite, what is given replaces."""
    e = _t(spark, d, "events")
    i = F.col("event_id")
    arr = lambda *x: F.array(*(F.lit(v) for v in x))
    old = e.select(i.alias("session_id"), F.concat(F.lit("g"), i.cast("string")).alias("goal"), F.when(i % 3 == 0, "blocked").otherwise("odd").alias("status"), arr("a", "b", "a").alias("completed"), arr("old").alias("blockers"))
    new = e.select(i.alias("session_id"), F.lit("").alias("goal"), F.when(i % 3 == 1, "completed").otherwise("nope").alias("status"), F.when(i % 2 == 0, arr("c", "a", " ")).alias("completed"), F.when(i % 4 == 0, arr("new", "new")).alias("blockers"))
    out = sessions.append(old, new)
    return out.select("session_id", "goal", "status", F.array_join("completed", ",").alias("completed"), F.array_join("blockers", ",").alias("blockers"))


@query("select event_id session_id, case when event_id % 2 = 0 then 'Untitled session' else 'g' end goal, 'in_progress' status, 2::int completed_count, 0::int decisions_count from events")
def session_replace(spark, d):
    e = _t(spark, d, "events")
    i = F.col("event_id")
    none = F.lit(None).cast("array<string>")
    update = e.select(i.alias("session_id"), F.when(i % 2 == 0, "").otherwise("g").alias("goal"), F.lit("no").alias("status"), *(F.lit(None).cast("string").alias(c) for c in ("current_focus", "why_blocked", "next_step")), *(none.alias(c) for c in sessions.LISTS if c != "completed"), F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.lit(" ")).alias("completed"))
    return sessions.replaced(update).select("session_id", "goal", "status", "completed_count", "decisions_count")


@query("select event_id session_id, event_type goal, case event_id % 2 when 0 then 'blocked' else 'planning' end status, 'p,q,r' pinned, 'x,y' completed, 9::int completed_count from events")
def session_hydrate(spark, d):
    """Sessions from their stored rows and snapshots."""
    e = _t(spark, d, "events")
    i = F.col("event_id")
    snap = F.concat(F.lit('{"goal": "other", "status": "planning", "completed": ["x", "y", "x"], "pinned_context": ["r", "p"], "decisions": []}'))
    rows = e.select(i.alias("session_id"), F.col("event_type").alias("goal"), F.when(i % 2 == 0, "blocked").otherwise("bad").alias("status"), *(F.lit(None).cast("string").alias(c) for c in ("current_focus", "why_blocked", "next_step")), F.lit('["p", "q", ""]').alias("pinned_context_json"), F.lit("not json").alias("blockers_json"), F.lit(None).cast("string").alias("unresolved_questions_json"), snap.alias("snapshot_json"), F.lit(9).alias("completed_count"), F.lit(None).cast("int").alias("decisions_count"), F.lit(None).cast("int").alias("touched_files_count"))
    out = sessions.hydrated(rows)
    return out.select("session_id", "goal", "status", F.array_join("pinned_context", ",").alias("pinned"), F.array_join("completed", ",").alias("completed"), "completed_count")


_S = "(select user_id session_id, max(ts) u, arg_max(event_type, ts) t from events group by 1)"


def _sessions(spark, d):
    return _t(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("updated_at"), F.max_by("event_type", "ts").alias("kind"))


@query(f"select session_id, epoch_us((select max(u) from {_S}) - u) / 1000000.0 age_s, u < (select max(u) from {_S}) - interval 30 days is_stale from {_S} order by date_trunc('second', u) desc, session_id limit 5")
def session_list(spark, d):
    """The sessions written last, with their age."""
    s = _sessions(spark, d)
    as_of = s.agg(F.max("updated_at").alias("as_of"))
    return sessions.listed(s.crossJoin(F.broadcast(as_of)), F.col("as_of")).select("session_id", "age_s", "is_stale")


@query(f"with m as (select max(u) mx, arg_max(session_id, (u, session_id)) a from {_S}) select session_id from {_S}, m where u >= mx - interval 2 days or session_id = 3")
def session_cleanup(spark, d):
    """Sessions of the last two days, and the active one whatever its age."""
    s = _sessions(spark, d)
    as_of = s.agg(F.max("updated_at").alias("as_of"))
    active = spark.createDataFrame([(3,)], "session_id long")
    return sessions.fresh(s.crossJoin(F.broadcast(as_of)), F.col("as_of"), active, 2).select("session_id")


@query(f"select arg_max(session_id, (u, session_id)) session_id, max(u) updated_at from {_S}")
def session_active(spark, d):
    return sessions.active(_sessions(spark, d))


@query("select event_id, user_id from events where user_id not in (select user_id from events where event_type = 'error' group by 1 having count(*) >= 20)")
def session_reset(spark, d):
    """Events without those of the sessions that are reset."""
    e = _t(spark, d, "events")
    gone = e.where("event_type = 'error'").groupBy("user_id").count().where("count >= 20")
    return sessions.without(e.select("event_id", "user_id"), gone, "user_id")


@query("with s as (select user_id, count(*) n from events group by 1), k as (select user_id from s where n % 2 = 0), ke as (select event_id, user_id from events where value > 30) select 'sessions' part, (select count(*) from s) before, (select count(*) from s) - (select count(*) from k) deleted, (select count(*) from k) after union all select 'events', (select count(*) from events), (select count(*) from events) - (select count(*) from ke join k using (user_id)), (select count(*) from ke join k using (user_id))")
def state_compact(spark, d):
    """Rows before and after a clean-up: events go with their sessions."""
    e = _t(spark, d, "events")
    s = e.groupBy("user_id").agg(F.count("*").alias("n"))
    return state.compacted(s, e, s.where("n % 2 = 0"), e.where("value > 30"), "user_id")


@query(f"with l as (select {_signature_sql('text')} s, role i, turn tt, 'c/' || (conv_id % 20) path from conversations), p as (select s, i, max(tt) last from l group by 1, 2), k as (select s, i from p where timestamp '2026-01-01' + last * interval 1 day >= timestamp '2026-01-04') select (select count(*) from k) n_patterns, count(*) n_files from (select distinct s, i, path from l join k using (s, i))")
def pattern_cleanup(spark, d):
    """Patterns that were seen lately enough, and the files of those."""
    day = lambda c: F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(F.col(c))
    p, f = patterns.learn(_log(spark, d))
    kept, of = state.stale_patterns(p.withColumn("last_seen", day("last_seen")), f, F.lit("2026-02-03").cast("timestamp"))
    return kept.agg(F.count("*").alias("n_patterns")).crossJoin(of.agg(F.count("*").alias("n_files")))


@query("select event_id, case when event_id % 5 = 0 then 'invalid_json' when event_id % 3 = 0 then 'missing_in_store' when event_id % 2 = 0 then 'imported_and_not_newer' else 'file_is_newer' end why from events")
def state_removable(spark, d):
    """Which old session files may go."""
    e = _t(spark, d, "events")
    i = F.col("event_id")
    f = e.select("event_id", F.when(i % 5 > 0, i).alias("session_id"), F.when(i % 2 == 1, F.col("ts")).alias("updated_at"))
    rows = e.where("event_id % 3 > 0").select(i.alias("session_id"), (F.col("ts") - F.expr("INTERVAL 1 SECOND")).alias("updated_at"))
    return state.removable_sessions(f, rows).select("event_id", "why")


@query("with k as (select distinct 'metric:' || sha1(event_type || ':' || user_id) k from events), o as (select distinct 'metric:' || sha1(event_type || ':' || user_id) k from events where user_id < 50) select (select count(*) from k where k not in (select k from o)) imported, (select count(*) from events) - (select count(*) from k where k not in (select k from o)) skipped")
def state_import(spark, d):
    """Entries imported once each by the hash of what they say, whoever sent them before."""
    key = state.legacy_key("metric", F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"))).alias("key")
    e = _t(spark, d, "events")
    return state.imported(e.select(key), e.where("user_id < 50").select(key), "key")


@query("select event_id from (select event_id, octet_length(encode(event_type || props)) + 1 n, row_number() over (order by event_id desc) rn, sum(octet_length(encode(event_type || props)) + 1) over () total from events) where total <= 4000 or rn <= 500")
def log_rotate(spark, d):
    """The last 500 lines of a log that is over its size."""
    e = _t(spark, d, "events").select("event_id", F.concat("event_type", "props").alias("line"))
    return files.rotated(e, "event_id", most=4000).select("event_id")


@query("select event_id from events where (event_type = 'click' or value > 60) and event_type <> 'error'")
def changed_paths(spark, d):
    """Changed files that are there: listed ones and untracked ones, which overlap in part, each once."""
    e = _t(spark, d, "events").withColumn("path", F.col("event_id").cast("string"))
    there, _ = files.changed_files(e.where("event_type in ('click', 'error')").select("path"), e.where("value > 60").select("path"), e.where("event_type <> 'error'").select("path"))
    return there.select(F.col("path").cast("long").alias("event_id"))


@query("select event_id, event_id % 4 <> 1 says from events")
def update_input(spark, d):
    """Whether updates say anything."""
    i = F.col("event_id")
    u = _t(spark, d, "events").select("event_id", F.when(i % 4 == 0, "planning").alias("status"), F.when(i % 4 == 2, "go").otherwise(" ").alias("next_step"), F.when(i % 4 == 3, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("completed"))
    return u.select("event_id", sessions.says_something(u).alias("says"))


@query("select event_id, greatest(floor(value)::bigint - (props::json->>'k')::bigint, 0) saved_tokens, case when floor(value) > 0 then round(greatest(floor(value)::bigint - (props::json->>'k')::bigint, 0) / floor(value) * 100, 2) else 0 end savings_pct from events where user_id = 7")
def session_savings(spark, d):
    """What each entry of one session saved."""
    e = _t(spark, d, "events").withColumnRenamed("user_id", "session_id")
    m = metrics.of_texts(F.floor("value").cast("long"), F.get_json_object("props", "$.k").cast("long"))
    return sessions.by_id(e, 7).withColumn("m", m).select("event_id", "m.saved_tokens", "m.savings_pct")


# ---- turns ----------------------------------------------------------------------------------------------------------------------

_COLL = f"trim(regexp_replace({{0}}, '[' || {X.BLANK} || ']+', ' ', 'g'))"
_C = _COLL.format("text")


@query(f"select conv_id, turn, length({_C}) >= 20 and len(list_filter(regexp_split_to_array({_C}, '[^A-Za-z0-9_.-]+'), lambda t: length(t) >= 3)) >= 4 said_much, length({_C}) >= 20 and len(list_distinct(list_filter(regexp_split_to_array(lower({_C}), '[^a-z0-9_.-]+'), lambda t: length(t) >= 3 and not list_contains({X.TURN_STOP}, t)))) >= 4 said_much_of_its_own from conversations")
def prompt_weight(spark, d):
    """Whether prompts say enough to go by, by both counts of terms."""
    c = _t(spark, d, "conversations")
    return c.select("conv_id", "turn", turns.meaningful_prompt(F.col("text")).alias("said_much"), turns.meaningful_prompt(F.col("text"), True).alias("said_much_of_its_own"))


_MSG = "('Done. ' || case event_id % 4 when 0 then 'Next step: ' || repeat('run ', 3) || event_id || ' again. More' when 1 then 'Siguiente paso - probar ' || event_type || event_id || '; luego' when 2 then 'next step: short.' else repeat('and so on ', 15) end)"


@query(f"with m as (select *, {_MSG} m from events), n as (select *, case event_id % 4 when 0 then repeat('run ', 3) || event_id || ' again' when 1 then 'probar ' || event_type || event_id else '' end step from m) select event_id, step next_step, (case when event_id % 5 > 2 then 3 else 0 end + case when event_id % 3 = 0 then 1 else 0 end + case when step <> '' then 2 else 0 end + case when length(trim(m)) >= 140 then 1 else 0 end + case when user_id % 2 = 0 then 1 else 0 end)::int points from n")
def turn_stop(spark, d):
    """What an answer says comes next, and points that say the turn should have saved its state."""
    e = _t(spark, d, "events")
    i = F.col("event_id")
    s = i.cast("string")
    said = F.when(i % 4 == 0, F.concat(F.lit("Next step: run run run "), s, F.lit(" again. More"))).when(i % 4 == 1, F.concat(F.lit("Siguiente paso - probar "), "event_type", s, F.lit("; luego"))).when(i % 4 == 2, F.lit("next step: short.")).otherwise(F.repeat(F.lit("and so on "), 15))
    said = F.concat(F.lit("Done. "), said)
    files_ = F.when(i % 3 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    state_ = F.when(F.col("user_id") % 2 == 0, "possible_shift").otherwise("aligned")
    return e.select("event_id", T.next_step(said).alias("next_step"), turns.stop_points(F.greatest(i % 5 - 2, F.lit(0)), files_, said, state_).cast("int").alias("points"))


@query("select event_id, case event_id % 6 when 0 then 'end' when 1 then null when 2 then 'checkpoint' when 3 then 'append' when 4 then null else 'manual' end event, case when event_id % 2 = 0 then 1 else 0 end::int n_files from events")
def turn_events(spark, d):
    """Tool calls that save state, and files that writing ones touch."""
    e = _t(spark, d, "events")
    k = F.col("event_id") % 6
    tool = F.when(k < 2, "mcp__x__smart_turn").when(k == 4, "Read").otherwise("MCP__y__smart_summary")
    phase, action = F.when(k == 0, "end").otherwise("start"), F.when(k == 3, "append").otherwise("checkpoint")
    event = F.when(k == 0, "end").when(k == 2, "checkpoint")
    wrote = turns.touched(F.when(F.col("event_id") % 2 == 0, "Edit").otherwise("Read"), F.lit("a.py"), F.lit("a.py"), F.lit(None).cast("string"))
    return e.select("event_id", turns.checkpoint_use(tool, phase, action, event).alias("event"), F.size(wrote).alias("n_files"))


@query(f"with p as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) before from conversations), q as (select *, list_distinct(list_filter(regexp_split_to_array(lower({_C}), '[^a-z0-9_.-]+'), lambda w: length(w) >= 3 and not list_contains({X.TURN_STOP}, w))) t, list_distinct(list_filter(regexp_split_to_array(lower({_COLL.format('before')}), '[^a-z0-9_.-]+'), lambda w: length(w) >= 3 and not list_contains({X.TURN_STOP}, w))) u from p), r as (select *, len(list_intersect(t, u)) n, case when len(t) > 0 then round(len(list_intersect(t, u)) / len(t), 2) else 0 end sh from q) select conv_id, turn, case when before is null then case when conv_id % 2 = 0 then 'ambiguous_resume' else 'cold_start' end when len(t) = 0 then 'resume' when n >= 3 or sh >= 0.35 then 'aligned' when n >= 1 or sh >= 0.15 then 'possible_shift' else 'mismatch' end state from r")
def turn_states(spark, d):
    """The state that each turn begins in, by the turn before it."""
    from pyspark.sql import Window

    c = _t(spark, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", sessions.turn_state(F.col("before").isNotNull(), F.col("conv_id") % 2 == 0, F.col("text"), F.col("before")).alias("state"))


@query("select event_id, 'fix ' || event_id current_focus, 'Uncheckpointed turn: fix ' || event_id pinned, case when event_id % 2 = 0 then 'a' end touched, 'goal: ' || event_type || chr(10) || 'next: ' || event_id shown from events")
def turn_carryover(spark, d):
    """What an unsaved turn leaves, and the lines put before the next prompt."""
    e = _t(spark, d, "events")
    s = F.col("event_id").cast("string")
    c = turns.carryover(F.concat(F.lit(" fix \n "), s), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")), F.lit("ok"))
    shown = turns.context_lines(F.concat(F.lit("goal: "), "event_type"), F.lit(" "), F.lit(None).cast("string"), F.concat(F.lit("next: "), s))
    return e.withColumn("c", c).select("event_id", "c.current_focus", F.get("c.pinned_context", F.lit(0)).alias("pinned"), F.get("c.touched_files", F.lit(0)).alias("touched"), shown.alias("shown"))


@query("select tool, count(*) n, sum(overhead)::bigint overhead_tokens, round(100.0 * sum(overhead) / (select sum(floor(value)::bigint) from events), 2) overhead_pct from (select 'hook' tool, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]')) overhead from conversations) where overhead > 0 group by 1")
def turn_overhead(spark, d):
    """Tokens of what was put before prompts, and their share of all raw tokens."""
    over = turns.overhead(_t(spark, d, "conversations").select("text"))
    raw = _t(spark, d, "events").agg(F.sum(F.floor("value").cast("long")).alias("raw"))
    return over.groupBy("tool").agg(F.count("*").alias("n"), F.sum("overhead_tokens").alias("overhead_tokens")).crossJoin(raw).select("tool", "n", "overhead_tokens", F.round(F.lit(100.0) * F.col("overhead_tokens") / F.col("raw"), 2).alias("overhead_pct"))


# ---- folds --------------------------------------------------------------------------------------------------------------------

_UPD = "select user_id s, event_id i, case when event_id % 13 = 5 then 'reset' when event_id % 7 = 0 then 'update' when event_id % 2 = 0 then 'append' else 'auto_append' end a, case when event_id % 5 = 0 then 'g' || event_id else '' end goal, case event_id % 4 when 0 then 'blocked' when 1 then 'nope' when 2 then null else 'completed' end status, case when event_id % 3 = 0 then 'n' || event_id end step, case when event_id % 8 > 2 then ['c' || event_id % 9, event_type, ' ', event_type] end done, case when event_id % 6 = 0 then ['b' || event_id, ''] end blockers from events"
_OLD = "select distinct user_id, -1, 'stored', 'old goal', 'planning', 'old step', ['x', 'c1', 'x'], ['old'] from events where user_id % 3 = 0"


@query(
    f"with r as ({_UPD} union all {_OLD}), m as (select s, max(i) filter (where a in ('update', 'reset')) m, max((a = 'reset')::int) gone from r group by s), v as (select r.*, gone from r join m using (s) where m is null or i > m or (i = m and a = 'update')), "
    "c as (select s, coalesce(arg_max(goal, i) filter (where goal <> ''), 'Untitled session') goal, coalesce(arg_max(status, i) filter (where status in ('planning', 'in_progress', 'blocked', 'completed')), 'in_progress') status, coalesce(arg_max(step, i) filter (where step <> ''), '') next_step, coalesce(array_to_string(list_filter(arg_max(blockers, i) filter (where blockers is not null), lambda x: x <> ''), ','), '') blockers, max(gone) gone from v group by s), "
    "e as (select s, done[p] x, min(i * 10 + p) f from v, range(1, 5) t(p) where p <= len(done) and trim(done[p]) <> '' group by 1, 2), l as (select s, string_agg(x, ',' order by f) completed, count(*)::int n from e group by s) "
    "select s session_id, goal, status, next_step, blockers, coalesce(completed, '') completed, coalesce(n, 0) completed_count, case when gone = 0 and s % 3 = 0 then 'at ' || s end created from c left join l using (s)"
)
def session_fold(spark, d):
    """All updates of all sessions, of every kind and in their order, over the stored ones and for new ones."""
    e = _t(spark, d, "events")
    i = F.col("event_id")
    text = lambda head: F.concat(F.lit(head), i.cast("string"))
    action = F.when(i % 13 == 5, "reset").when(i % 7 == 0, "update").when(i % 2 == 0, "append").otherwise("auto_append")
    done = F.when(i % 8 > 2, F.array(F.concat(F.lit("c"), (i % 9).cast("string")), F.col("event_type"), F.lit(" "), F.col("event_type")))
    status = F.when(i % 4 == 0, "blocked").when(i % 4 == 1, "nope").when(i % 4 == 3, "completed")
    new = e.select(F.col("user_id").alias("session_id"), i.alias("at"), action.alias("action"), F.when(i % 5 == 0, text("g")).otherwise("").alias("goal"), status.alias("status"), F.when(i % 3 == 0, text("n")).alias("next_step"), done.alias("completed"), F.when(i % 6 == 0, F.array(text("b"), F.lit(""))).alias("blockers"))
    lit = lambda *x: F.array(*(F.lit(v) for v in x))
    old = e.where("user_id % 3 = 0").select(F.col("user_id").alias("session_id")).distinct().select("session_id", F.lit("old goal").alias("goal"), F.lit("planning").alias("status"), F.lit("old step").alias("next_step"), lit("x", "c1", "x").alias("completed"), lit("old").alias("blockers"), F.concat(F.lit("at "), F.col("session_id").cast("string")).alias("created"))
    out = sessions.fold(old, new, ["at"], kept=("created",))
    return out.select("session_id", "goal", "status", "next_step", F.array_join("blockers", ",").alias("blockers"), F.array_join("completed", ",").alias("completed"), "completed_count", "created")


# ---- summaries that must shrink -------------------------------------------------------------------------------------------------


def _tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]'))"


@query(
    # of the JSON of a summary 34 tokens are left without those of its goal, 27 without the goal at all, 9 of the status alone
    "with recursive s as (select event_id k, case when event_id % 3 = 0 then repeat('word ', (event_id % 80 + 1)::int) else event_type || ' of a goal with ' || event_id || ' words' end g from events), "
    f"r as (select k, g, 0 step from s union all select k, g[1 : greatest(4, floor(length(g) * 0.6)::int) - 3] || '...', step + 1 from r where {_tokens('g')} + 34 > 60 and length(g) > 12), "
    f"f as (select k, arg_max(g, step) g, max(step) n, arg_max({_tokens('g')}, step) t from r group by k) "
    "select k::varchar session_id, 60 budget, case when n = 0 then 'none' else 'trimmed' end \"level\", t + 34 tokens, g goal, '' omitted from f "
    "union all select k::varchar, 30, 'reduced', 27, null, 'goal' from s union all select k::varchar, 20, 'status_only', 9, null, 'completed_count,decisions_count,goal,touched_files_count' from s"
)
def summary_levels(spark, d):
    """Summaries of goals of many lengths under three budgets: as they are, shortened step by step, without a goal, and the status alone."""
    i = F.col("event_id")
    goal = F.when(i % 3 == 0, F.repeat(F.lit("word "), (i % 80 + 1).cast("int"))).otherwise(F.concat("event_type", F.lit(" of a goal with "), i.cast("string"), F.lit(" words")))
    none = F.array().cast("array<string>")
    s = _t(spark, d, "events").select(i.cast("string").alias("session_id"), F.lit("planning").alias("status"), goal.alias("goal"), *(F.lit("").alias(c) for c in ("current_focus", "why_blocked", "next_step")), *(none.alias(c) for c in sessions.LISTS))
    out = None
    for budget in (60, 30, 20):
        got = sessions.summary(s, budget).select("session_id", F.lit(budget).alias("budget"), "level", F.col("tokens").cast("long").alias("tokens"), F.get_json_object("text", "$.goal").alias("goal"), F.array_join("omitted", ",").alias("omitted"))
        out = got if out is None else out.union(got)
    return out


# ---- single rules ------------------------------------------------------------------------------------------------------------------


@query(f"with s as (select *, (['planning', 'odd', 'blocked', 'completed'])[session_id % 4 + 1] st from {_S}), a as (select case st when 'odd' then 'in_progress' else st end st, u < (select max(u) from s) - interval 2 days stale from s) select st status, count(*) n, count(*) filter (stale) n_stale from a group by 1 union all select null, count(*), count(*) filter (stale) from a")
def session_totals(spark, d):
    """Sessions by status and of all, and how many of them are stale (two days here stand for the rule's thirty)."""
    s = _sessions(spark, d).withColumn("status", F.element_at(F.array(*(F.lit(x) for x in ("planning", "odd", "blocked", "completed"))), (F.col("session_id") % 4 + 1).cast("int")))
    as_of = s.agg((F.max("updated_at") + F.expr("INTERVAL 28 DAYS")).alias("as_of"))
    return sessions.totals(s.crossJoin(F.broadcast(as_of)), F.col("as_of"))


@query("select doc_id, '2026-02-03-' || left(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), 30) session_id from documents")
def session_ids(spark, d):
    """Ids of sessions made from their goals."""
    goal = F.coalesce("text", F.lit(""))
    return _t(spark, d, "documents").select("doc_id", T.session_id(goal, F.lit("2026-02-03").cast("date")).alias("session_id"))


@query("select event_id, case when event_id % 2 = 0 then 'blocked' else 'in_progress' end || ' next ' || event_id || ' pin ' || event_type || '  ' || case when event_id % 2 = 0 then ' stuck' else ' ' end || ' goal done1 done2 done3  .../x/y/z' said from events")
def summary_text(spark, d):
    """All that a summary says, as one text."""
    i = F.col("event_id")
    s = i.cast("string")
    none = F.array().cast("array<string>")
    rows = _t(spark, d, "events").select("event_id", F.when(i % 2 == 0, "blocked").otherwise("odd").alias("status"), F.concat(F.lit("next "), s).alias("next_step"), F.array(F.concat(F.lit("pin "), "event_type"), F.lit(" ")).alias("pinned_context"), none.alias("unresolved_questions"), F.lit(" ").alias("current_focus"), F.lit("stuck").alias("why_blocked"), F.lit("goal").alias("goal"), F.array(*(F.lit(f"done{k}") for k in range(4))).alias("completed"), none.alias("decisions"), none.alias("blockers"), F.array(F.lit("a/long/path/w/x/y/z")).alias("touched_files"))
    return rows.withColumn("f", sessions.summary_fields()).select("event_id", sessions.said(F.col("f")).alias("said"))


@query("with n as (select event_type || '/' || user_id k, event_id from events where value > 20), o as (select event_type || '/' || user_id k from events where user_id % 3 = 0) select k \"key\", min(event_id) event_id from n where k not in (select k from o) group by 1")
def insert_once(spark, d):
    """Entries whose key isn't there yet, each key once."""
    k = F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("key")
    e = _t(spark, d, "events")
    return state.insert_new(e.where("value > 20").select(k, "event_id"), e.where("user_id % 3 = 0").select(k), "key")


@query("select event_id, coalesce(floor(value)::bigint * (event_id % 3 > 0)::int, 0) raw_tokens, case when event_id % 3 > 0 and floor(value) > 0 then round(greatest(floor(value)::bigint - (props::json->>'k')::bigint, 0) / floor(value)::bigint * 100, 2) when event_id % 2 = 0 then 12.5 else 0 end savings_pct, event_type kind, case when event_id % 4 = 0 then 'kept' end note from events")
def metrics_stored(spark, d):
    """Entries as they are kept: the percentage that was given where there are no raw tokens, other columns as metadata."""
    i = F.col("event_id")
    raw = F.when(i % 3 > 0, F.floor("value").cast("long"))
    e = _t(spark, d, "events").select("event_id", F.lit(None).cast("string").alias("tool"), raw.alias("raw_tokens"), F.get_json_object("props", "$.k").cast("long").alias("compressed_tokens"), F.lit(None).cast("long").alias("final_tokens"), F.lit(None).cast("long").alias("saved_tokens"), F.when(i % 2 == 0, 12.5).alias("savings_pct"), F.col("event_type").alias("kind"), F.when(i % 4 == 0, '{"note": "kept", "kind": "old"}').alias("metadata"))
    m = lambda k: F.get_json_object("metadata", f"$.{k}")
    return metrics.stored(e.withColumnRenamed("event_id", "metric_id")).select(F.col("metric_id").alias("event_id"), "raw_tokens", "savings_pct", m("kind").alias("kind"), m("note").alias("note"))


@query("select event_id, case event_id % 3 when 0 then ts when 1 then timestamp '1970-01-01' else timestamp '2026-02-03' end as \"at\" from events")
def time_fallbacks(spark, d):
    """Times read from texts; the epoch or a given now where a text says none."""
    i = F.col("event_id")
    said = F.when(i % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(i % 3 == 1, "no time")
    other = F.when(i % 3 == 1, F.lit("1970-01-01").cast("timestamp")).otherwise(F.lit("2026-02-03").cast("timestamp"))
    return _t(spark, d, "events").select("event_id", T.to_time(said, other).cast("timestamp_ntz").alias("at"))


@query("with k as (select user_id, event_id, floor(value)::bigint t from events), n as (select event_id, case when event_type = 'error' and event_id % 4 = 0 then floor(value)::bigint + 1 else floor(value)::bigint end t from events where event_type <> 'view') select k.user_id, case when bool_or(n.t <> k.t) then 'stale' when count(n.t) > 0 then 'fresh' else 'unavailable' end freshness from k left join n using (event_id) group by 1")
def index_times(spark, d):
    """Whether what an index knows of each user's files is as old as they are."""
    e = _t(spark, d, "events")
    known = e.select("user_id", F.col("event_id").alias("path"), F.floor("value").alias("mtime"))
    moved = F.when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0), 1).otherwise(0)
    disk = e.where("event_type <> 'view'").select(F.col("event_id").alias("path"), (F.floor("value") + moved + 0.25).alias("mtime"))
    return planning.index_freshness(known, disk, "user_id")


@query("select user_id task, event_type query, event_id rel, rank from (select *, row_number() over (partition by user_id, event_type order by value desc, event_id)::int rank from events) where rank <= 5")
def query_ranks(spark, d):
    """The five best hits of each query of each task."""
    hits = _t(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("query"), F.col("event_id").alias("rel"), "value")
    return search.best_of_queries(hits, ["task", "query"], [F.desc("value"), F.col("rel")]).drop("value")


@query("select user_id task, event_id rel from (select *, row_number() over (partition by user_id order by floor(value / 10) desc, event_id) rn from events) where rn <= 5")
def seed_rerank(spark, d):
    """The five seeds of most points of each task, ties by path."""
    seeds = _t(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("rel"), F.floor(F.col("value") / 10).alias("points"))
    return planning.best_seeds(seeds).drop("points")
