"""Queries over the driver's tables by name, each with the SQL that gives the same rows.

Stand-ins: a document is a file (its source the folder), an event a metric entry or session event (its type the tool,
its user the session, its value the tokens), a conversation turn a task, a label a relevance judgement.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compress, evaluate, graph, metrics, outline, patterns, planning, ranks, search, sessions, state, symbols
from ..streaming import streams
from . import fixed as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _dealt(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table in a small file, dealt out over all cores: few bytes of it make texts that take long to read, and would lie in few tasks."""
    rows = _t(spark, d, name)
    n = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *rows.columns[:1])


def _entries(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, d, "events").select(F.col("event_id").alias("metric_id"), F.col("event_type").alias("tool"), F.col("user_id").alias("session_id"), F.floor("value").cast("long").alias("raw_tokens"), k.alias("compressed_tokens"), F.lit(None).cast("long").alias("final_tokens"), F.lit(None).cast("long").alias("saved_tokens"), F.col("ts").alias("created_at"))


_E = "(select event_id metric_id, event_type tool, user_id session_id, floor(value)::bigint raw_tokens, (props::json->>'k')::bigint compressed_tokens, greatest(floor(value)::bigint - (props::json->>'k')::bigint, 0) saved_tokens, ts created_at from events)"
_M = "count(*) n, sum(raw_tokens)::bigint raw_tokens, sum(compressed_tokens)::bigint compressed_tokens, sum(saved_tokens)::bigint saved_tokens, case when sum(raw_tokens) > 0 then round(sum(saved_tokens)::double / sum(raw_tokens)::double * 100, 2) else 0 end savings_pct"
_LINES = "(select doc_id, source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no from documents)"

# ---- search -----------------------------------------------------------------------------------------------------------


@query(f"select doc_id, count(*) n_matches, min(line_no)::int first_line from (select distinct doc_id, line_no, trim(line, {X.BLANK}) from {_LINES} where contains(lower(line), 'the')) group by 1 order by 2 desc, 1 limit 10")
def search_literal_topk(spark, d):
    found = search.grouped(search.match_lines(_t(spark, d, "documents"), "doc_id", "text", "the"), "doc_id")
    return found.orderBy(F.desc("n_matches"), "doc_id").limit(10)


def _paths(spark, d) -> DataFrame:
    """The documents as files of several kinds and folders."""
    id_ = F.col("doc_id").cast("string")
    kinds = ["/app/src/%s/%s.py", "/packages/%s/%s.yaml", "/tests/fixtures/%s/%s.json", "/docs/%s/readme_%s.md", "/lib/tion/%s-%s.js", "/ops/%s/Dockerfile.%s", "/lib/%s/tion-%s.test.ts"]
    path = F.element_at(F.array(*(F.concat_ws("", F.lit(k.split("%s")[0]), "source", F.lit(k.split("%s")[1]), id_, F.lit(k.split("%s")[2])) for k in kinds)), (F.col("doc_id") % 7 + 1).cast("int"))
    return _t(spark, d, "documents").select(path.alias("path"), "text")


_PATHS = "(select doc_id, text, case doc_id % 7 when 0 then '/app/src/' || source || '/' || doc_id || '.py' when 1 then '/packages/' || source || '/' || doc_id || '.yaml' when 2 then '/tests/fixtures/' || source || '/' || doc_id || '.json' when 3 then '/docs/' || source || '/readme_' || doc_id || '.md' when 4 then '/lib/tion/' || source || '-' || doc_id || '.js' when 5 then '/ops/' || source || '/Dockerfile.' || doc_id else '/lib/' || source || '/tion-' || doc_id || '.test.ts' end path from documents)"
_HITS = f"(select path, doc_id, count(*) n from (select path, doc_id, unnest(string_split(text, chr(10))) line from {_PATHS}) where contains(lower(line), 'tion') group by 1, 2)"
_POINTS = "least(n, 12) * 6 + 8 - 5 + case doc_id % 7 when 0 then w_src + w_source when 1 then 8 + w_config when 2 then w_config + w_test when 3 then w_low when 4 then 16 + w_source when 5 then w_source else 30 + 16 + w_source + w_test end"
_WEIGHTS = "(values ('implementation', 10, 14, 4, -35, -15), ('debug', 10, 14, 4, -35, -15), ('tests', 5, 10, 0, -35, 10), ('config', 0, 0, 14, -20, -15), ('docs', 0, 4, 4, -10, -15), ('explore', 10, 14, 4, -35, -15)) w(intent, w_src, w_source, w_config, w_low, w_test)"


@query(f"select intent, path, n n_matches, {_POINTS} + case when path like '/app/src/%' then 0 else 1 end * case doc_id % 7 when 1 then 1 when 2 then 0 when 3 then 1 when 4 then 1 when 5 then 1 when 6 then 1 else 0 end as score from {_HITS}, {_WEIGHTS}")
def search_scores(spark, d):
    """Points of every file that holds the literal, for every intent."""
    found = search.grouped(search.match_lines(_paths(spark, d), "path", "text", "tion"), "path")
    each = found.withColumn("intent", F.explode(F.array(*(F.lit(i) for i in T.INTENTS))))
    return each.select("intent", "path", "n_matches", search.score(F.col("n_matches"), F.col("path"), "tion", F.col("intent")).cast("long").alias("score"))


@query(f"select path, n n_matches, {_POINTS} + case when path like '/app/src/%' then 0 else 1 end * case doc_id % 7 when 1 then 1 when 2 then 0 when 3 then 1 when 4 then 1 when 5 then 1 when 6 then 1 else 0 end as score from {_HITS}, {_WEIGHTS} where intent = 'tests' order by 3 desc, 2 desc, 1 limit 10")
def search_scored_intent(spark, d):
    return search.search(_paths(spark, d), "tion", "tests").select("path", "n_matches", F.col("score").cast("long").alias("score"))


@query(f"with g as (select doc_id, count(*) n from {_LINES} where contains(lower(line), 'tion') group by 1), l as (select doc_id, max(toxic) t, max(quality) q from labels group by 1), b as (select case when t = 1 then 'index' when q = 1 then 'graph' else 'text' end src, n + case when t = 1 then 50 when q = 1 then 25 else 0 end score, n, doc_id from g left join l using (doc_id)), top as (select * from b order by score desc, n desc, doc_id limit 10) select count(*) filter (src = 'text') text_match, count(*) filter (src = 'index') index_boost, count(*) filter (src = 'graph') graph_boost from top")
def search_source_breakdown(spark, d):
    groups = search.match_lines(_t(spark, d, "documents"), "doc_id", "text", "tion").groupBy("doc_id").agg(F.count("*").alias("n_matches")).withColumn("score", F.col("n_matches"))
    marks = _t(spark, d, "labels")
    return search.breakdown(search.ranked(search.boosted(groups, marks.where("toxic = 1"), marks.where("quality = 1"), "doc_id"), "doc_id"))


@query(f"with m as (select path, line_no, line from (select path, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no from {_PATHS}) where contains(lower(line), 'tion')), f as (select path, n, {_POINTS} + case when path like '/app/src/%' then 0 else 1 end * case doc_id % 7 when 1 then 1 when 2 then 0 when 3 then 1 when 4 then 1 when 5 then 1 when 6 then 1 else 0 end as score from {_HITS}, {_WEIGHTS} where intent = 'explore'), r as (select *, row_number() over (order by score desc, n desc, path) place from f), s as (select place, m.path, line_no, line, row_number() over (partition by m.path order by line_no) rn from m join r using (path) where place <= 5), t as (select 'query: tion' || chr(10) || 'root: /' || chr(10) || 'total matches: ' || (select sum(n) from f) || chr(10) || 'matched files: ' || (select count(*) from f) || chr(10) || chr(10) || '# Top files' || chr(10) || (select string_agg(n || ' match(es), score ' || score || ' :: ' || path, chr(10) order by place) from r where place <= 10) || chr(10) || chr(10) || '# Sample matches' || chr(10) || (select string_agg(path || ':' || line_no || ':' || line, chr(10) order by place, line_no) from s where rn <= 3) x) select case when length(x) > 5000 then left(x, 5000) || chr(10) || chr(10) || '[truncated ' || (length(x) - 5000) || ' chars]' else x end as text from t")
def search_compact(spark, d):
    """What a search prints of many matches."""
    matches = search.match_lines(_paths(spark, d), "path", "text", "tion")
    groups = search.grouped(matches, "path")
    groups = groups.withColumn("score", search.score(F.col("n_matches"), F.col("path"), "tion", "explore"))
    return search.compact(matches, groups, "tion", "/")


# ---- metrics ----------------------------------------------------------------------------------------------------------


@query(f"select tool, {_M} from {_E} group by 1")
def metrics_by_tool(spark, d):
    return metrics.by_tool(metrics.normalised(_entries(spark, d)))


@query(f"select tool, {_M} from {_E} group by rollup (tool)")
def metrics_rollup(spark, d):
    return metrics.report(metrics.normalised(_entries(spark, d)))


@query(f"select tool, {_M} from {_E} where created_at >= (select max(ts) from events) - interval 7 days group by 1")
def metrics_window_7d(spark, d):
    e = metrics.normalised(_entries(spark, d))
    as_of = e.agg(F.max("created_at").alias("as_of"))
    return metrics.by_tool(metrics.within(e.crossJoin(F.broadcast(as_of)), "7d", F.col("as_of")))  # one row


@query("select event_id metric_id, event_type tool, user_id session_id from events order by date_trunc('second', ts) desc, event_id desc limit 20")
def metrics_latest_n(spark, d):
    return metrics.latest(_entries(spark, d), 20).select("metric_id", "tool", "session_id")


@query("select event_type tool, count(*) n, sum((props::json->>'k')::bigint)::bigint overhead_tokens, round(sum((props::json->>'k')::bigint) / (select sum(floor(value)::bigint) from events) * 100, 2) overhead_pct from events where (props::json->>'k')::bigint > 0 group by 1")
def metrics_overhead(spark, d):
    return metrics.overhead(_entries(spark, d), "compressed_tokens")


@query("select event_type tool, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.95) p95 from events group by 1")
def latency_percentiles(spark, d):
    """Exact percentiles by counts of ranges."""
    return ranks.percentiles(_t(spark, d, "events").withColumnRenamed("event_type", "tool"), "value", ["tool"], {"p50": 0.5, "p95": 0.95})


@query(f"select tool, {_M} from {_E} where session_id = 7 group by 1 order by saved_tokens desc, n desc, tool limit 3")
def metrics_session_top3(spark, d):
    return metrics.by_tool(metrics.normalised(_entries(spark, d)).where("session_id = 7")).orderBy(F.desc("saved_tokens"), F.desc("n"), "tool").limit(3)


# ---- sessions ---------------------------------------------------------------------------------------------------------

_RET = "select *, row_number() over (partition by user_id order by date_trunc('second', ts) desc, event_id desc) rn, (select max(ts) from events) - interval 3 days cutoff from events"


@query(f"select event_id, user_id from ({_RET}) where rn <= 5 or ts >= cutoff")
def retention_keep(spark, d):
    e = _t(spark, d, "events")
    as_of = e.agg((F.max("ts") - F.expr("INTERVAL 3 DAYS")).alias("cutoff"))
    return sessions.retained(e.crossJoin(F.broadcast(as_of)), "user_id", "ts", "event_id", 5, F.col("cutoff")).select("event_id", "user_id")


@query(f"select count(*) n_before, count(*) filter (rn <= 5 or ts >= cutoff) n_after, count(*) filter (not (rn <= 5 or ts >= cutoff)) n_deleted from ({_RET})")
def retention_counts(spark, d):
    before = _t(spark, d, "events").agg(F.count("*").alias("n_before"))
    after = retention_keep(spark, d).agg(F.count("*").alias("n_after"))
    return before.crossJoin(after).withColumn("n_deleted", F.col("n_before") - F.col("n_after"))


@query("select event_id from (select event_id, ts, row_number() over (order by date_trunc('second', ts) desc, event_id desc) rn from events) where rn <= 100 or ts >= (select max(ts) from events) - interval 1 day")
def retention_overall(spark, d):
    e = _t(spark, d, "events")
    as_of = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("cutoff"))
    return sessions.retained_overall(e.crossJoin(F.broadcast(as_of)), "ts", "event_id", 100, F.col("cutoff")).select("event_id")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1")
def session_latest(spark, d):
    return sessions.latest_by_key(_t(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("with e as (select *, coalesce(ts >= (select max(ts) from events) - interval 1 day, false) late from events), f as (select user_id, min(event_id) created, max(event_id) last from e where not late group by 1), g as (select user_id, min(event_id) created, max(event_id) last from e where late group by 1) select coalesce(f.user_id, g.user_id) user_id, coalesce(f.created, g.created) created, coalesce(g.last, f.last) as last from f full join g on f.user_id = g.user_id")
def session_upsert(spark, d):
    """The sessions as they were a day before the last event, and those of that day over them: each event is on one side."""
    e = _t(spark, d, "events")
    cutoff = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("cutoff"))
    e = e.crossJoin(F.broadcast(cutoff)).withColumn("late", F.coalesce(F.col("ts") >= F.col("cutoff"), F.lit(False)))
    part = lambda late: e.where(F.col("late") == late).groupBy("user_id").agg(F.min("event_id").alias("created"), F.max("event_id").alias("last"))
    return sessions.upsert(part(False), part(True), "user_id", "created")


@query("with s as (select user_id session_id, max(ts) u, arg_max(event_type, ts) status from events group by 1), r as (select *, row_number() over (order by date_trunc('second', u) desc, session_id) rn, lead(u) over (order by date_trunc('second', u) desc, session_id) nx, count(*) over () n from s) select session_id recommended, least(n, 5) candidates, n = 1 or u - nx >= interval 12 hours found, not (n = 1 or u - nx >= interval 12 hours) ambiguous from r where rn = 1")
def session_resume_gap(spark, d):
    s = _t(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("updated_at"))
    return sessions.resume(s).select("recommended", "candidates", "found", "ambiguous")


_STOP = X.TURN_STOP


def _terms_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9_.-]+'), lambda w: length(w) >= 3 and not list_contains({_STOP}, w)))"


@query(f"with p as (select conv_id, turn, {_terms_sql('text')} t, lag({_terms_sql('text')}) over (partition by conv_id order by turn) u from conversations), q as (select conv_id, turn, len(list_intersect(t, u)) shared, len(t) n from p where u is not null) select conv_id, turn, shared, case when shared >= 3 or (n > 0 and shared / n >= 0.35) then 'aligned' when shared >= 1 or (n > 0 and shared / n >= 0.15) then 'possible_shift' else 'mismatch' end state from q")
def session_terms_overlap(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _t(spark, d, "conversations").withColumn("t", T.terms(F.col("text"))).withColumn("u", F.lag("t").over(w)).where("u is not null")
    shared = F.size(F.array_intersect("t", "u")).cast("long")
    return t.select("conv_id", "turn", shared.alias("shared"), sessions.continuity(shared, F.size("t")).alias("state"))


# ---- text -------------------------------------------------------------------------------------------------------------


def _signature_sql(x: str) -> str:
    return f"array_to_string(list_slice(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9 \\t\\n]', ' ', 'g'), '[ \\t\\n]+'), lambda w: length(w) > 2), 1, 8), ' ')"


@query(f"select conv_id, turn, {_signature_sql('text')} signature from conversations")
def task_signature(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.task_signature(F.col("text")).alias("signature"))


@query(f"select conv_id, turn, {X.intent('text')} intent from conversations")
def intent_infer(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.infer_intent(F.col("text")).alias("intent"))


@query(f"select word, count(*) n from (select unnest({_terms_sql('text')}) word from documents) group by 1 order by 2 desc, 1 limit 50")
def keyword_extract(spark, d):
    # words are told apart by text first; what is filtered then is rows, in generated code
    word = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9_.-]+"))).alias("word")
    words = _t(spark, d, "documents").select(word).where((F.length("word") >= 3) & ~F.col("word").isin(T.STOP_WORDS))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query(f"with l as (select doc_id, line, line_no, trim(line, {X.BLANK}) k from {_LINES}), f as (select *, row_number() over (partition by doc_id, k order by line_no) rn from l) select doc_id, string_agg(line, chr(10) order by line_no) as text from f where rn = 1 or k = '' group by 1")
def unique_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.unique_lines(F.col("text")).alias("text"))


@query("select doc_id, case when length(text) > 400 then left(text, 400) || chr(10) || chr(10) || '[truncated ' || (length(text) - 400) || ' chars]' else text end as text from documents")
def truncate_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 400).alias("text"))


@query(f"select d.doc_id, coalesce(string_agg(l.line, chr(10) order by l.line_no), '') as text from documents d left join {_LINES} l on l.doc_id = d.doc_id and (contains(lower(l.line), 'error') or contains(lower(l.line), 'tion')) group by 1")
def relevant_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.relevant_lines(F.col("text"), ["error", "tion"]).alias("text"))


@query("select conv_id, turn, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]'))::int tokens from conversations")
def token_count(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.token_count(F.col("text")).alias("tokens"))


@query("select conv_id, turn from (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) used, row_number() over (partition by conv_id order by turn) rn from conversations) where used <= 600 or rn = 1")
def budget_prefix(spark, d):
    items = _t(spark, d, "conversations").withColumn("cost", F.length("text"))
    return planning.prefix_budget(items, "conv_id", [F.col("turn")], "cost", 600).select("conv_id", "turn")


@query("select doc_id, len(regexp_extract_all(text, '\\|'))::int n_bars, upper(lang) lang, case when length(text) > 230 then left(text, 227) || '...' else text end head from documents")
def shorten_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\|")).alias("n_bars"), F.upper("lang").alias("lang"), T.shorten(F.col("text"), 230).alias("head"))


@query("with p as (select page_id, url, list_filter(string_split(url, '/'), lambda x: x <> '') a from pages union all select doc_id, source || '/' || lang, [source, lang] from documents) select page_id, case when len(a) <= 3 and length(url) <= 60 then url else '.../' || array_to_string(a[-3:], '/') end path from p")
def compact_paths(spark, d):
    p = _t(spark, d, "pages").select("page_id", "url").union(_t(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang")))
    return p.select("page_id", T.compact_path(F.col("url")).alias("path"))


# ---- patterns ---------------------------------------------------------------------------------------------------------


def _log(spark, d):
    return _t(spark, d, "conversations").select(F.col("text").alias("task"), F.col("role").alias("intent"), F.col("turn").alias("accessed_at"), F.concat(F.lit("c/"), (F.col("conv_id") % 20).cast("string")).alias("path"), F.col("turn").alias("position"), F.lit(0.0).alias("relevance"))


@query(f"select signature, intent, count(distinct turn) occurrences, max(turn) last_seen from (select {_signature_sql('text')} signature, role intent, turn from conversations) group by 1, 2")
def pattern_stats(spark, d):
    return patterns.learn(_log(spark, d))[0]


@query("with w as (select item_id k, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) w from benchmark) select a.k, b.k k2, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) similarity from w a join w b on a.k < b.k where len(list_intersect(a.w, b.w)) >= 0.2 * len(list_distinct(list_concat(a.w, b.w)))")
def pattern_similarity(spark, d):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    return patterns.similar_pairs(_t(spark, d, "benchmark"), "item_id", words, 0.2).select("k", "k2", F.round("similarity", 6).alias("similarity"))


_TASKS = "(select distinct text task, role intent from conversations where turn = 0)"


@query(f"with l as (select {_signature_sql('text')} s, role i, turn tt, 'c/' || (conv_id % 20) path, conv_id from conversations), p as (select s, i, count(distinct tt) occ from l group by 1, 2 order by occ desc, s, i limit 20), f as (select s, i, path, count(*) n, min(tt * 1000000 + tt) ord from l group by 1, 2, 3), t as (select task, intent, {_signature_sql('task')} sig from {_TASKS}), m as (select t.*, p.s, p.i, p.occ, len(list_intersect(string_split(sig, ' '), string_split(p.s, ' ')))::double / len(list_distinct(list_concat(string_split(sig, ' '), string_split(p.s, ' ')))) + case when occ >= 3 then 0.1 else 0 end sc from t join p on t.intent = p.i where sig <> ''), b as (select *, row_number() over (partition by task, intent order by sc desc, occ desc, s) rn from m where sc >= 0.6), o as (select task, intent, round(sc, 6) score, path, n access_count, row_number() over (partition by task, intent order by n desc, ord, path)::int place from b join f on b.s = f.s and b.i = f.i where rn = 1) select * from o where place <= 8")
def pattern_predict(spark, d):
    """The files that the first turn of each conversation is likely to need, by what like turns needed."""
    p, f = patterns.learn(_log(spark, d))
    tasks = _t(spark, d, "conversations").where("turn = 0").select(F.col("text").alias("task"), F.col("role").alias("intent")).distinct()
    return patterns.predict(p, f, tasks).select("task", "intent", F.round("score", 6).alias("score"), "path", "access_count", "place")


# ---- index and graph --------------------------------------------------------------------------------------------------


@query(r"select name, doc_id path, count(*) over (partition by name) n from (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as name from documents) where name <> ''")
def inverted_index_postings(spark, d):
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.filter(words, lambda x: x != "").alias("names"))
    return graph.inverted_index(docs)


_SRC = "(select doc_id, 'src/m' || (doc_id % 40) || '/f' || doc_id || '.js' path from documents union all select doc_id, 'src/m' || (doc_id % 40) || '/f' || doc_id || '.test.js' from documents where doc_id % 3 = 0)"


def _sources(spark, d) -> DataFrame:
    """Each document as a file that imports the next one of its folder; every third has a test."""
    docs = _t(spark, d, "documents").select("doc_id")
    path = F.concat(F.lit("src/m"), (F.col("doc_id") % 40).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", F.concat(path, F.lit(".js")).alias("path")).union(docs.where("doc_id % 3 = 0").select("doc_id", F.concat(path, F.lit(".test.js"))))


def _edges(spark, d) -> DataFrame:
    files = _sources(spark, d)
    spec = F.concat(F.lit("./f"), (F.col("doc_id") + 40).cast("string"))
    imports = files.where(~T.is_test_path(F.col("path"))).select(F.col("path").alias("src"), spec.alias("spec"))
    return graph.edges(imports, files.select("path"))


@query(f"select s.path src, t.path dst, 'import' kind from {_SRC} s join {_SRC} t on t.doc_id = s.doc_id + 40 and t.path not like '%.test.js' where s.path not like '%.test.js' union all select s.path, t.path, 'testOf' from {_SRC} s join {_SRC} t using (doc_id) where s.path like '%.test.js' and t.path not like '%.test.js'")
def graph_edges(spark, d):
    """Imports resolved by rank, and tests held against the names beside them."""
    return _edges(spark, d)


@query(f"with one as (select 'src/m3/f' || 43 || '.js' p) select path, relation from (select 'src/m3/f83.js' path, 'imports' relation union all select 'src/m3/f3.js', 'importedBy' union all select path, 'neighbors' from {_SRC}, one where path like 'src/m3/%' and path <> p) x, one where path in (select path from {_SRC})")
def graph_related(spark, d):
    return graph.related(_edges(spark, d), "src/m3/f43.js", _sources(spark, d))


@query(f"select path, count(*) - 1 n from (select a.path, b.path other from {_SRC} a join {_SRC} b on regexp_replace(a.path, '/[^/]*$', '') = regexp_replace(b.path, '/[^/]*$', '')) group by 1")
def graph_neighbors(spark, d):
    """How many files stand beside each: counts of folders, no pairs."""
    files = _sources(spark, d).select("path", T.dirname(F.col("path")).alias("dir"))
    return files.join(files.groupBy("dir").agg(F.count("*").alias("n")), "dir").select("path", (F.col("n") - 1).alias("n"))


@query("select event_type \"name\", user_id path, min(event_id) line from events where lower(event_type) in ('click', 'error', 'view') group by 1, 2")
def index_lookup(spark, d):
    index = _t(spark, d, "events").groupBy(F.col("event_type").alias("name"), F.col("user_id").alias("path")).agg(F.min("event_id").alias("line")).withColumn("kind", F.lit("event"))
    return graph.lookup(index, spark.createDataFrame([("CLICK",), ("Error",), ("view",)], "name string")).select("name", "path", "line")


@query("with o as (select distinct 'metric:' || sha1(event_type || ':' || event_id) k from events where event_id % 2 = 0), n as (select 'metric:' || sha1(event_type || ':' || event_id) k from events) select count(*) filter (k not in (select k from o)) imported, count(*) filter (k in (select k from o)) skipped from n")
def idempotent_import(spark, d):
    k = F.concat(F.lit("metric:"), F.sha1(F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")))).alias("k")
    e = _t(spark, d, "events")
    old = e.where("event_id % 2 = 0").select(k).distinct().withColumn("old", F.lit(True))
    return e.select(k).join(old, "k", "left").agg(F.count_if(F.col("old").isNull()).alias("imported"), F.count_if(F.col("old")).alias("skipped"))


@query("with d as (select doc_id path, n_chars, coalesce(length(text), 0) size, coalesce(source = max(source) over () and source > min(source) over (), false) fresh, coalesce(source = min(source) over () and source < max(source) over (), false) gone from documents), o as (select path, n_chars mtime from d where not fresh), n as (select path, n_chars + (size % 2) mtime from d where not gone) select coalesce(o.path, n.path) path, case when n.path is null then 'removed' when o.path is null then 'added' else 'changed' end state from o full join n on o.path = n.path where o.path is null or n.path is null or o.mtime <> n.mtime")
def index_freshness(spark, d):
    """The folder that is last by name came after the index was made, the first went away, texts of odd length changed: each document is on a side."""
    docs = _t(spark, d, "documents")
    ends = docs.agg(F.min("source").alias("low"), F.max("source").alias("high"))
    docs = docs.crossJoin(F.broadcast(ends))
    at = lambda end: F.coalesce((F.col("source") == F.col(end)) & (F.col("low") < F.col("high")), F.lit(False))
    old = docs.where(~at("high")).select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime"))
    new = docs.where(~at("low")).select(F.col("doc_id").alias("path"), (F.col("n_chars") + F.coalesce(F.length("text"), F.lit(0)) % 2).alias("mtime"))
    return graph.stale(old, new)


# ---- evaluation -------------------------------------------------------------------------------------------------------


@query("with x as (select b.item_id task, d.doc_id item from benchmark b join documents d on contains(d.text, b.text)), r as (select task, item, row_number() over (partition by task order by item) rank from x) select task, count(*) n_expected, count(*) filter (rank <= 1) / count(*) recall1, count(*) filter (rank <= 5) / count(*) recall5 from r group by 1")
def eval_recall_at_k(spark, d):
    found = evaluate.containing(_t(spark, d, "documents").select(F.col("doc_id").alias("item"), "text"), _t(spark, d, "benchmark").select(F.col("item_id").alias("task"), F.col("text").alias("want"))).select("task", "item")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy("item")))
    return evaluate.recall_of_ranks(ranked, (1, 5))


@query("select count(*) n, round(count(*) filter (quality = 1 and toxic = 0) / count(*), 4) high_pass, round(count(*) filter (quality = 1 and toxic = 1) / count(*), 4) high_fail, round(count(*) filter (quality = 0 and toxic = 0) / count(*), 4) low_pass, round(count(*) filter (quality = 0 and toxic = 1) / count(*), 4) low_fail from labels")
def eval_calibration(spark, d):
    return evaluate.calibration(_t(spark, d, "labels").select((F.col("quality") == 1).alias("high"), (F.col("toxic") == 0).alias("passed")))


@query("select event_type, count(*) n, round(avg(value / 100), 4) recall, round(avg((value > 50)::int), 4) pass_rate, quantile_disc((event_id % 1000)::double, 0.5) p50, quantile_disc((event_id % 1000)::double, 0.95) p95 from events group by 1")
def eval_summary(spark, d):
    e = _t(spark, d, "events").select("event_type", (F.col("value") / 100).alias("recall"), (F.col("value") > 50).alias("passed"), (F.col("event_id") % 1000).alias("latency_ms"))
    return evaluate.summary(e, "event_type")


@query(X.greedy())
def greedy_plan(spark, d):
    """Three files for each language, of documents in folders by source: worth less what resembles those chosen before."""
    role = F.element_at(F.array(*(F.lit(x) for x in planning.ROLES)), (F.col("doc_id") % 4 + 1).cast("int"))
    points = F.element_at(F.array(F.lit(130), F.lit(85), F.lit(60), F.lit(50)), (F.col("doc_id") % 4 + 1).cast("int"))
    c = _t(spark, d, "documents").select(F.col("lang").alias("task"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("rel"), role.alias("role"), (points + F.least(F.col("n_chars"), F.lit(2000)) / 100).cast("double").alias("utility"))
    return planning.greedy(c, k=3).select("task", "rel", "role", "place", F.round("gain", 6).alias("gain"))


# ---- Spark's own relational breadth over the star schema ------------------------------------------------------------

_REL = {
    "rel_pricing_summary": "select l_returnflag, l_linestatus, sum(l_quantity) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    "rel_top_orders": "select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10",
    "rel_left_anti": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)",
    "rel_left_semi": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)",
    "rel_full_outer": "select coalesce(a.k, b.k) k, a.n n1, b.n n2 from (select c_nationkey k, count(*) n from customer group by 1) a full join (select s_nationkey k, count(*) n from supplier group by 1) b on a.k = b.k",
    "rel_cube": "select o_orderstatus, o_orderpriority, count(*) n from orders group by cube (o_orderstatus, o_orderpriority)",
    "rel_grouping_sets": "select l_returnflag, l_linestatus, count(*) n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())",
    "rel_window_rank": "select o_custkey, o_orderkey, r from (select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) r from orders) where r <= 2",
    "rel_window_frame": "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) s from orders",
    "rel_range_join": "select a.p_partkey, count(*) n from part a join part b on a.p_size = b.p_size and b.p_retailprice between a.p_retailprice - 1 and a.p_retailprice + 1 group by 1",
    "rel_setops": "select c_nationkey k from customer intersect select s_nationkey from supplier except select n_nationkey from nation where n_regionkey = 0",
    "rel_scalar_subquery": "select count(*) n from lineitem where l_quantity > (select avg(l_quantity) from lineitem)",
}


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    names = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem") if t in text.split() or f"{t} " in text]

    def run(spark: SparkSession, d: str) -> DataFrame:
        for n in names:
            _t(spark, d, n).createOrReplaceTempView(n)
        return spark.sql(text.replace("timestamp '", "timestamp_ntz '"))

    return run


for _k, _v in _REL.items():
    QUERIES[_k], ORACLES[_k] = _sql(_v), _v


def rel_range_join(spark, d):
    """Parts of one size within a price of each other, counted and not paired: how many have a price up to the upper bound, less those below the lower one.

    A size's prices go in steps of one, each alike price once; running numbers within a step and of the steps before add up to the rank of a bound."""
    p = _t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    price = F.col("p_retailprice")
    sums = p.where("p_size is not null and p_retailprice is not null").groupBy("p_size", "p_retailprice").agg(F.count("*").alias("c"))
    # a lower bound comes before the prices that equal it, an upper one behind them
    point = lambda at, order, c: F.struct(at.alias("at"), F.lit(order).alias("order"), c.alias("c"))
    points = sums.select("p_size", price.alias("of"), F.explode(F.array(point(price - 1, 0, F.lit(0).cast("long")), point(price, 1, F.col("c")), point(price + 1, 2, F.lit(0).cast("long")))).alias("x")).select("p_size", "of", "x.*").withColumn("step", F.floor("at"))
    within = points.withColumn("n", F.sum("c").over(Window.partitionBy("p_size", "step").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    steps = points.groupBy("p_size", "step").agg(F.sum("c").alias("c")).withColumn("before", F.sum("c").over(Window.partitionBy("p_size").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c"))
    rank = F.col("n") + F.col("before")
    met = within.where("order <> 1").join(steps.drop("c"), ["p_size", "step"]).groupBy("p_size", F.col("of").alias("p_retailprice")).agg(F.sum(F.when(F.col("order") == 2, rank).otherwise(-rank)).alias("n"))
    return p.join(met, ["p_size", "p_retailprice"]).groupBy("p_partkey").agg(F.sum("n").alias("n"))


QUERIES["rel_range_join"] = rel_range_join

# ---- compression and symbols -----------------------------------------------------------------------------------------

_MARKED = "(starts_with(t, 'import ') or starts_with(t, 'export ') or contains(t, 'function ') or contains(t, 'const ') or contains(t, 'return (') or contains(t, 'class ') or contains(t, 'def ') or contains(t, 'resource ') or contains(t, 'FROM ') or contains(t, 'fn '))"
_CODE = "(select doc_id, 'const a' || doc_id || ' = 1' || chr(10) || coalesce(text, '') || chr(10) || chr(9) || 'class K' || (doc_id % 9) || ' ' text from documents)"
_CUT = "case when length(x) > {0} then left(x, {0}) || chr(10) || chr(10) || '[truncated ' || (length(x) - {0}) || ' chars]' else x end"


def _code(spark, d) -> DataFrame:
    id_ = F.col("doc_id").cast("string")
    return _t(spark, d, "documents").select("doc_id", F.concat(F.lit("const a"), id_, F.lit(" = 1\n"), F.coalesce("text", F.lit("")), F.lit("\n\tclass K"), (F.col("doc_id") % 9).cast("string"), F.lit(" ")).alias("text"))


@query(f"with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) no from {_CODE}), m as (select doc_id, no, line, trim(line, {X.BLANK}) t from l), a as (select doc_id, string_agg(line, chr(10) order by no) x from m where {_MARKED} group by 1) select doc_id, {_CUT.format(5000)} as text from a")
def compress_fallback(spark, d):
    return _code(spark, d).select("doc_id", outline.fallback(F.col("text")).alias("text"))


_TOK = "len(regexp_extract_all({0}, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]'))"


@query(f"with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) no from {_CODE}), m as (select doc_id, no, line, trim(line, {X.BLANK}) t from l), a as (select doc_id, string_agg(line, chr(10) order by no) x from m where {_MARKED} group by 1), o as (select doc_id, {_CUT.format(5000)} o, {_CUT.format(4000)} g from a), c as (select d.doc_id, d.text, o, g, string_split(g, chr(10)) gl from {_CODE} d join o using (doc_id)), r as (select doc_id, gl, list_filter(range(0, len(gl) + 1), lambda i: list_sum(list_transform(list_slice(gl, 1, i), lambda z: {_TOK.format('z')})) <= 60 - 9 or i = 0) fits from c) select c.doc_id, case when {_TOK.format('c.text')} <= 60 then c.text when {_TOK.format('o')} <= 60 then o when {_TOK.format('g')} <= 60 then g else array_to_string(list_append(list_slice(c.gl, 1, list_max(fits)), chr(10) || '[truncated to fit 60 token budget]'), chr(10)) end as text from c join r using (doc_id)")
def compress_cascade(spark, d):
    return _code(spark, d).select("doc_id", compress.cascade(F.col("text"), 60).alias("text"))


@query(X.symbols())
def symbol_index(spark, d):
    """The declarations of files in nine languages that are made of the names of parts."""
    return symbols.symbols(X.source_files(_dealt(spark, d, "part"))).select("path", "name", "kind", "line", "parent")


@query(X.summaries())
def summary_compress(spark, d):
    """Summaries of one session a user that fit without being shortened; shorter ones are held against brute force in tests."""
    e = _t(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.array_sort(F.collect_set("event_type")).alias("decisions"), F.min("event_id").alias("a"), F.max("event_id").alias("z"))
    none, text = F.array().cast("array<string>"), lambda c: F.col(c).cast("string")
    s = e.select("session_id", F.lit("blocked").alias("status"), F.concat(F.lit("goal "), text("a")).alias("goal"), F.lit("").alias("current_focus"), F.lit(" ").alias("why_blocked"), F.lit(None).cast("string").alias("next_step"), none.alias("pinned_context"), none.alias("unresolved_questions"), F.array(text("a"), text("z"), text("a")).alias("completed"), "decisions", F.array(F.lit(""), text("z")).alias("blockers"), F.array(F.concat(F.lit("a/b/c/d/"), text("a"))).alias("touched_files"))
    return sessions.summary(s, 500).select("session_id", "level", F.get_json_object("text", "$.goal").alias("goal"), F.get_json_object("text", "$.why_blocked").alias("why_blocked"), F.get_json_object("text", "$.hot_files[0]").alias("hot_file"), F.get_json_object("text", "$.completed_count").cast("int").alias("n_completed"), F.array_join(F.from_json(F.get_json_object("text", "$.key_decisions"), "array<string>"), ",").alias("decisions"))


# ---- streams, run to their end -----------------------------------------------------------------------------------------


def _stream(spark, d):
    """A folder that holds the events file alone, as file streams read folders."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("select date_trunc('day', ts)::timestamp as start, event_type, count(*) n from events group by 1, 2")
def stream_tumbling(spark, d):
    return streams.drain(streams.tumbling(_stream(spark, d)), spark, "stream_tumbling").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select s as start, count(*) n from (select unnest([date_trunc('day', ts)::timestamp, date_trunc('day', ts)::timestamp - interval 1 day]) s from events) where true group by 1")
def stream_sliding(spark, d):
    return streams.drain(streams.sliding(_stream(spark, d)), spark, "stream_sliding").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("with g as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hours, true)::int b from events), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from g) select min(ts) as start, user_id, count(*) n from s group by user_id, k")
def stream_sessions(spark, d):
    return streams.drain(streams.by_session(_stream(spark, d)), spark, "stream_sessions").withColumn("start", F.col("start").cast("timestamp_ntz"))


from . import indexing, reading, streaming, tasking, upkeep  # noqa: E402, F401  they register their queries
