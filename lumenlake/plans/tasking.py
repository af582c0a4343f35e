"""Queries over tasks: query rewriting, seeds, graph expansion, roles, plans, predictions, evaluation of what was retrieved."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tasks
from ..functions import text as T
from ..operators import evaluate, patterns, planning, symbols
from . import fixed as X
from .registry import _SRC, _dealt, _edges, _sources, _t, query

# tasks: what parts are named after, put into sentences
_NAMES = ["fix the jwt secret in getUserName", "create user for the api routes", "please find parse_config and loadYAML", "why does the docker image deploy fail", "add tests for order totals 42", "HTTPServer session cache", "refactor the invoice exporter application", "explain nothing", "user-creation and jwt-secret jwt"]
_TASK = "(select p_partkey k, replace(([" + ", ".join(f"'{n}'" for n in _NAMES) + f"])[p_partkey % {len(_NAMES)} + 1], 'order', 'order' || p_partkey) task from part)"


def _tasks(spark, d):
    names = F.array(*(F.lit(n) for n in _NAMES))
    key = F.col("p_partkey")
    return _dealt(spark, d, "part").select(key.alias("k"), F.replace(F.element_at(names, (key % len(_NAMES) + 1).cast("int")), F.lit("order"), F.concat(F.lit("order"), key.cast("string"))).alias("task"))


_WORDS = "(select k, task, lower(w) w from (select k, task, unnest(regexp_extract_all(task, '[a-zA-Z0-9_]+')) w from " + _TASK + "))"


def _keywords_sql(out: str) -> str:
    points = "least(length(w), 8) + greatest(0, 16 - (strpos(lower(task), w) - 1)) + (length(w) >= 12)::int"
    jwt = "not (w = 'jwt' and regexp_matches(lower(task), '\\bjwt[-\\s]+secret\\b'))"
    return f"(select k, w, row_number() over (partition by k order by {points} desc, strpos(lower(task), w), length(w) desc, w) rn from (select distinct k, task, w from {_WORDS}) where length(w) > 2 and not regexp_matches(w, '^[0-9]+$') and not list_contains({out}, w) and {jwt})"


@query(f"select k, coalesce(string_agg(w, ' ' order by rn), '') as words from {_TASK} t left join {_keywords_sql(f'list_concat({X.TASK_OUT}, {X.INTENT_OUT})')} using (k) group by 1")
def task_keywords(spark, d):
    """The words of each task worth a search, the most telling first."""
    return _tasks(spark, d).select("k", F.array_join(tasks.keywords(F.col("task")), " ").alias("words"))


_COMPOUND = "select k, 0 o, 0 rn, 'createUser' q from " + _TASK + " where regexp_matches(lower(task), '\\b(create[-\\s]+user|user[-\\s]+creation)\\b') union all select k, 0, 1, 'jwtSecret' from " + _TASK + " where regexp_matches(lower(task), '\\bjwt[-\\s]+secret\\b')"
_NAMED = "select k, 1 o, min(rn) rn, q from (select k, unnest(l) q, generate_subscripts(l, 1) rn from (select k, regexp_extract_all(task, '\\b[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\\b|\\b[A-Z][a-zA-Z0-9]{2,}\\b|\\b[a-z]{2,}_[a-z_]+\\b') l from " + _TASK + ")) where lower(q) <> 'jwt' group by k, q"


@query(f"select k, coalesce(string_agg(q, ' ' order by o, rn), '') as names from {_TASK} left join ({_COMPOUND} union all {_NAMED}) using (k) group by 1")
def task_symbols(spark, d):
    """Names in each task: of phrases, and whatever is written like one."""
    return _tasks(spark, d).select("k", F.array_join(tasks.symbols(F.col("task")), " ").alias("names"))


def _search_sql() -> str:
    named = f"select k, o, rn, q from ({_COMPOUND} union all {_NAMED}) where regexp_matches(q, '_|[0-9]|[a-z][A-Z]|[A-Z]{{2,}}') and not list_contains({X.TASK_OUT}, lower(q))"
    words = f"select k, 2 o, rn, w q from {_keywords_sql(f'list_concat({X.TASK_OUT}, {X.INTENT_OUT})')}"
    first = f"select k, o, rn, q from (select *, row_number() over (partition by k, lower(q) order by o, rn) again from ({named} union all {words})) where again = 1"
    return f"(select k, q, place from (select k, q, row_number() over (partition by k order by o, rn) place from ({first})) where place <= 3)"


@query(f"select k, coalesce(string_agg(q, ' ' order by place), '') as queries from {_TASK} left join {_search_sql()} using (k) group by 1")
def task_queries(spark, d):
    """The three queries of each task."""
    return _tasks(spark, d).select("k", F.array_join(tasks.search_queries(F.col("task")), " ").alias("queries"))


def _candidates_sql() -> str:
    wide = f"select k, 0 p, o * 10 + rn n, q from ({_COMPOUND}) union all select k, 0, 9, 'FROM' from {_TASK} where regexp_matches(lower(task), '\\b(container|docker|image|deploy|deployment)\\b')"
    main = f"select k, 1, place, q from {_search_sql()}"
    words = f"select k, 2, rn, w from {_keywords_sql(X.TASK_OUT)}"
    code = f"(select k, arg_min(q, o * 100 + rn) q from ({_COMPOUND} union all {_NAMED}) where regexp_matches(q, '_|[0-9]|[a-z][A-Z]|[A-Z]{{2,}}') group by 1)"
    last = f"select t.k, 3, 0, coalesce(c.q, w.w, trim(t.task)) from {_TASK} t left join {code} c using (k) left join (select k, w from {_keywords_sql(X.TASK_OUT)} where rn = 1) w using (k)"
    every = f"select k, q, row_number() over (partition by k order by p, n) place from (select k, q, p, n, row_number() over (partition by k, q order by p, n) again from ({wide} union all {main} union all {words} union all {last}) u(k, p, n, q)) where again = 1"
    return f"(select * from ({every}) where place <= 6)"


@query(f"select k, string_agg(q, '|' order by place) as queries from {_candidates_sql()} group by 1")
def task_candidates(spark, d):
    """All queries of each task: of phrases, the three, any keyword, and the last resort."""
    return _tasks(spark, d).select("k", F.array_join(tasks.query_candidates(F.col("task")), "|").alias("queries"))


_HINTS = "select k, unnest(['api', 'routes']) h from " + _TASK + " where regexp_matches(lower(task), '\\b(api|endpoint|endpoints|route|routes)\\b') union all select k, 'auth' from " + _TASK + " where regexp_matches(lower(task), '\\b(auth|token|jwt|login|session)\\b') union all select k, 'config' from " + _TASK + " where regexp_matches(lower(task), '\\b(config|env|secret|yaml|json)\\b') union all select k, unnest(['test', 'tests']) from " + _TASK + " where regexp_matches(lower(task), '\\b(test|tests|spec|coverage)\\b') union all select k, unnest(['model', 'models']) from " + _TASK + " where regexp_matches(lower(task), '\\b(model|models|schema|schemas|entity|entities)\\b') union all select k, unnest(['dockerfile', 'docker']) from " + _TASK + " where regexp_matches(lower(task), '\\b(container|docker|image|deploy|deployment)\\b')"
_ALL_HINTS = f"(select distinct k, h from (select k, w h from {_WORDS} where length(w) > 2 and not list_contains({X.TASK_OUT}, w) union all {_HINTS}))"


@query(f"select k, string_agg(h, ' ' order by h) as hints from {_ALL_HINTS} group by 1")
def task_hints(spark, d):
    """What the paths of a task's files may hold."""
    return _tasks(spark, d).select("k", F.array_join(F.array_sort(tasks.path_hints(F.col("task"))), " ").alias("hints")).where("hints <> ''")


_PLACES = ["src/api/user.js", "src/routes/jwt.js", "models/config.py", "tests/order.test.js", "src/session.ts", "docs/invoice.md", "Dockerfile"]
_SEEDS = "(select k, task, i, ([" + ", ".join(f"'{p}'" for p in _PLACES) + "])[i] rel from " + _TASK + f", (select unnest(range(1, {len(_PLACES) + 1})) i))"


def _seeds(spark, d):
    places = F.posexplode(F.array(*(F.lit(p) for p in _PLACES))).alias("i", "rel")
    return _tasks(spark, d).select("k", "task", places)


_HINT_POINTS = f"(select s.k, s.rel, sum(case when base = h then 28 when contains(lower(s.rel), h) then 18 else 0 end) p, bool_or(h in ('api', 'routes')) api from (select *, regexp_replace(regexp_replace(lower(rel), '^.*/', ''), '(.)\\.[^.]*$', '\\1') base from {_SEEDS}) s join {_ALL_HINTS} using (k) group by 1, 2)"


@query(f"with x as (select s.k, s.rel, lower(s.rel) low, {X.intent('s.task')} intent, coalesce(h.p, 0) p, coalesce(h.api, false) api, 40 - (i - 1) * 8 hit from {_SEEDS} s left join {_HINT_POINTS} h on s.k = h.k and s.rel = h.rel) select k, rel, (greatest(0, hit) + case when low = 'dockerfile' then 0 when contains(low, 'user') then 18 else 0 end + p + case when api and regexp_matches(low, '(^|/)(api|routes)(/|$)') then 28 else 0 end - case when api and regexp_matches(low, '(^|/)(models?|schemas?)(/|$)') then 12 else 0 end + case when regexp_matches(low, '(^|/)(tests?|__tests__)/') then case when intent = 'tests' then 24 else -40 end when intent = 'tests' then -10 else 0 end + case when starts_with(low, 'src/') then case intent when 'implementation' then 10 when 'debug' then 8 else 0 end + case when p > 0 then 6 else 0 end else 0 end + case when contains(low, 'user') and regexp_extract(low, '([^/]*)\\.[^.]*$', 1) = 'user' then 10 else 0 end)::int points from x")
def seed_points(spark, d):
    """Points of files as the primary one of each task; each was found by 'user' at a rank of its own."""
    # what a task says of paths is worked out once, before its places
    s = _tasks(spark, d).select("k", tasks.path_hints(F.col("task")).alias("hints"), T.infer_intent(F.col("task")).alias("intent")).select("*", F.posexplode(F.array(*(F.lit(p) for p in _PLACES))).alias("i", "rel"))
    e = F.array(F.struct(F.lit("searchHit").alias("type"), F.lit("user").alias("query"), (F.col("i") + 1).alias("rank")))
    return s.select("k", "rel", tasks.seed_score(F.col("rel"), e, F.col("hints"), F.col("intent")).cast("int").alias("points"))


# ---- hits, seeds, candidates ------------------------------------------------------------------------------------------------

_HITS = "(select o_custkey % 50 task, o_orderkey % 4 query_at, o_orderkey rel, row_number() over (partition by o_custkey % 50, o_orderkey % 4 order by o_totalprice desc, o_orderkey) rank from orders)"


def _hits(spark, d):
    from pyspark.sql import Window

    o = _t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("task"), (F.col("o_orderkey") % 4).cast("int").alias("query_at"), F.col("o_orderkey").alias("rel"), "o_totalprice")
    rank = F.row_number().over(Window.partitionBy("task", "query_at").orderBy(F.desc("o_totalprice"), "rel"))
    return o.withColumn("rank", rank).withColumn("query", F.concat(F.lit("q"), F.col("query_at").cast("string")))


@query(f"select task, 'f' || (rel % 97) rel, min(query_at * 1000 + rank) // 1000 query_at, (min(query_at * 1000 + rank) % 1000)::int rank_at, string_agg('q' || query_at || ':' || rank, ' ' order by rank, query_at) as found from (select distinct task, query_at, rel % 97 rel, min(rank) over (partition by task, query_at, rel % 97) rank from {_HITS} where rank <= 5) group by 1, 2")
def seed_merge(spark, d):
    """The five best hits of four queries of each task as seeds: a file once, at its best place, with the evidence of all."""
    h = _hits(spark, d).where("rank <= 5").groupBy("task", "query_at", "query", F.concat(F.lit("f"), (F.col("rel") % 97).cast("string")).alias("rel")).agg(F.min("rank").alias("rank"))
    s = planning.merge_seeds(h)
    return s.select("task", "rel", "query_at", F.col("rank_at").cast("int").alias("rank_at"), F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["query"], e["rank"].cast("string"))), " ").alias("found"))


_SEED = f"(select doc_id % 7 task, path rel, doc_id from {_SRC} where path not like '%.test.js')"
_NEAR = f"(select task, rel, 0 o, 'primary' \"role\", null via from {_SEED} union all select s.task, t.path, 1, 'test', s.rel from {_SEED} s join {_SRC} t using (doc_id) where t.path like '%.test.js' union all select s.task, t.path, 2, 'dependency', s.rel from {_SEED} s join {_SRC} t on t.doc_id = s.doc_id + 40 where t.path not like '%.test.js' union all select s.task, t.path, 3, 'dependent', s.rel from {_SEED} s join {_SRC} t on t.doc_id = s.doc_id - 40 where t.path not like '%.test.js')"
_EXPANDED = f"(select task, rel, arg_min(\"role\", o) \"role\", coalesce(string_agg(case o when 1 then 'testOf' when 2 then 'dependencyOf' else 'dependentOf' end || ':' || via, ' ' order by o, via) filter (via is not null), '') via from {_NEAR} group by 1, 2)"


def _expanded(spark, d):
    seeds = _sources(spark, d).where(~T.is_test_path(F.col("path"))).select((F.col("doc_id") % 7).alias("task"), F.col("path").alias("rel"))
    return planning.expand(seeds.withColumn("evidence", F.array().cast(planning.EVIDENCE)), _edges(spark, d))


@query(f"select * from {_EXPANDED}")
def graph_expand(spark, d):
    """Seeds with what they import, what imports them and what tests them, a step away."""
    found = _expanded(spark, d)
    return found.select("task", "rel", "role", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["type"], e["via"])), " ").alias("via"))


@query(f"select task, rel, case \"role\" when 'primary' then 130 when 'test' then 85 when 'dependency' then 60 else 50 end + (length(via) - length(replace(via, 'testOf', ''))) / 6 * 40 + (length(via) - length(replace(via, 'dependencyOf', ''))) / 12 * 25 + (length(via) - length(replace(via, 'dependentOf', ''))) / 11 * 22 as utility, case when via = '' then 'selected' when starts_with(via, 'testOf') then 'test: ' || split_part(split_part(via, ' ', 1), ':', 2) when starts_with(via, 'dependencyOf') then 'imported-by: ' || split_part(split_part(via, ' ', 1), ':', 2) else 'imports: ' || split_part(split_part(via, ' ', 1), ':', 2) end reason from {_EXPANDED}")
def candidate_utility(spark, d):
    """What each candidate is worth by its role and links, and why it is there."""
    none = F.array().cast("array<string>")
    found = _expanded(spark, d)
    return found.select("task", "rel", planning.utility(F.col("role"), F.col("evidence"), none, F.lit("debug")).cast("double").alias("utility"), planning.reason(F.col("evidence")).alias("reason"))


@query(f"with e as (select *, case when via = '' then 0 else 0 end + case when starts_with(rel, 'src/') then 10 else 0 end + case when \"role\" = 'primary' then 6 else 0 end + case when starts_with(rel, 'src/') then 8 else 0 end p from {_EXPANDED}), b as (select task, arg_min(rel, (-p)::varchar || rel) best, max(p) mp from e group by 1), c as (select e.*, (select min(rel) from e f where f.task = e.task and f.p = b.mp) best2 from e join b using (task)) select task, rel, case when rel = best2 then 'primary' when \"role\" <> 'primary' then \"role\" when contains(via, 'testOf') then 'test' when contains(via, 'dependencyOf') then 'dependency' else 'dependent' end \"role\" from c")
def candidate_roles(spark, d):
    """One primary file for each task, the others by their links."""
    none = F.array().cast("array<string>")
    found = _expanded(spark, d)
    p = planning.promotion(F.col("rel"), F.col("role"), F.col("evidence"), none, none, F.lit("debug"))
    return planning.with_primary(found.withColumn("promotion", p)).select("task", "rel", "role")


@query("select case when count(*) filter (p_partkey % 15 in (2, 3, 5, 6, 7, 9, 10, 11, 12, 13, 14)) = 0 then 'partial' else 'none' end imports, case when count(*) filter (p_partkey % 15 in (9, 10, 11, 12, 13, 14)) > 0 then 'none' else 'partial' end tests from part")
def graph_coverage(spark, d):
    return planning.coverage(X.source_files(_t(spark, d, "part")))


@query("select user_id, case when bool_or(event_type = 'error') then 'stale' when bool_or(event_type = 'click') then 'fresh' else 'unavailable' end freshness from events group by 1")
def index_state(spark, d):
    state = F.when(F.col("event_type") == "error", "stale").when(F.col("event_type") == "click", "fresh")
    return planning.freshness(_t(spark, d, "events").select("user_id", state.alias("state")), "user_id")


@query(f"select {X.paths_sql()} path, case p_partkey % 15 when 0 then 'A#:class,f#:method' when 1 then 'F#:function,M#:function' when 2 then 'm#:method,S#:struct' when 3 then 'J#:class,m#:method' when 4 then 'C#:class,M#:method' when 5 then 'K#:class,m#:method' when 6 then 'P#:class,m#:function' when 7 then 'm#:function,g#:function' when 8 then 'J#:class,m#:method' end.replace('#', p_partkey::varchar) shown from part where p_partkey % 15 < 9")
def symbol_previews(spark, d):
    """The two symbols of each file that are shown first."""
    files = X.source_files(_t(spark, d, "part")).select("path", "text")
    found = symbols.with_snippets(symbols.symbols(files), files)
    of = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name", "kind", "signature", "snippet"))).alias("s"))
    shown = planning.previews(F.col("s"), F.array().cast("array<string>"), F.lit(2))
    return of.select("path", F.array_join(F.transform(shown, lambda p: F.concat_ws(":", p["name"], p["kind"])), ",").alias("shown"))


@query(
    f"with s as (select distinct task, rel from {_SEED}), p as (select user_id % 7 task, event_type || '/' || event_id % 13 path, round(count(*) filter (value > 35) / count(*), 4) score from events group by 1, 2) "
    "select task, rel, 'search' via from s union all select p.task, path, 'prefetch' from p join (select distinct task from s) t on p.task = t.task where score >= 0.6 and not exists (select 1 from s where s.task = p.task and s.rel = path)"
)
def seed_prefetch(spark, d):
    """Seeds with the files of predictions that are sure enough, by shares of events on both sides of the limit."""
    seeds = _sources(spark, d).where(~T.is_test_path(F.col("path"))).select((F.col("doc_id") % 7).alias("task"), F.col("path").alias("rel"))
    path = F.concat("event_type", F.lit("/"), (F.col("event_id") % 13).cast("string")).alias("path")
    predicted = _t(spark, d, "events").groupBy((F.col("user_id") % 7).alias("task"), path).agg(F.round(F.count_if(F.col("value") > 35) / F.count("*"), 4).alias("score"))
    return patterns.prefetched(seeds, predicted)


@query("with c as (select distinct user_id % 7 task, user_id rel from events), w as (select distinct user_id % 7 task, event_type low from events where event_id % 5 = user_id % 7), h as (select distinct c.task, c.rel, upper(e.event_type) n from c join events e on e.user_id = c.rel join w on w.task = c.task and w.low = e.event_type) select c.task, c.rel, coalesce((select array_to_string(list_sort(list(n))[1:3], ',') from h where h.task = c.task and h.rel = c.rel), '') matched, coalesce((select array_to_string(list_sort(list(n))[1:3], ',') from h where h.task = c.task and h.rel = c.rel), '') evidence from c")
def symbol_evidence(spark, d):
    """Candidates with the symbols of their task that they hold, whatever the case, three at most, and evidence of them."""
    e = _t(spark, d, "events").withColumn("task", F.col("user_id") % 7)
    candidates = e.select("task", F.col("user_id").alias("rel")).distinct().withColumn("evidence", F.array().cast(planning.EVIDENCE))
    wanted = e.where("event_id % 5 = user_id % 7").select("task", F.col("event_type").alias("name")).distinct()
    out = planning.with_symbols(candidates, e.select(F.col("user_id").alias("path"), F.upper("event_type").alias("name")), wanted)
    return out.select("task", "rel", F.array_join("matched", ",").alias("matched"), F.array_join(F.flatten(F.transform("evidence", lambda x: x["symbols"])), ",").alias("evidence"))


# ---- evaluation ---------------------------------------------------------------------------------------------------------------

_EXPECTED = "(select o_custkey % 50 task, 'm/' || (o_orderkey % 31) || '.js' path from orders where o_orderpriority = '1-URGENT' group by 1, 2)"
_GOT = "(select task, path, row_number() over (partition by task order by p desc, path) rank from (select o_custkey % 50 task, '/app/m/' || (o_orderkey % 31) || '.js' path, max(o_totalprice) p from orders group by 1, 2))"


def _retrieved(spark, d):
    from pyspark.sql import Window

    o = _t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("task"), F.concat(F.lit("m/"), (F.col("o_orderkey") % 31).cast("string"), F.lit(".js")).alias("path"), "o_totalprice", "o_orderpriority")
    got = o.groupBy("task", F.concat(F.lit("/app/"), "path").alias("path")).agg(F.max("o_totalprice").alias("p"))
    got = got.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("p"), "path"))).drop("p")
    return o.where("o_orderpriority = '1-URGENT'").select("task", "path").distinct(), got


@query(f"select t.task, coalesce(count(*) filter (g.rank <= 5) / nullif(count(e.path), 0), 1) precision5, coalesce(count(*) filter (g.rank <= 10) / nullif(count(e.path), 0), 1) precision10, count(e.path) > 0 and count(*) filter (g.rank = 1) = 0 wrong_first from (select distinct o_custkey % 50 task from orders) t left join {_EXPECTED} e using (task) left join {_GOT} g on g.task = e.task and ends_with(g.path, e.path) group by 1")
def eval_search(spark, d):
    """How many of the files that each task expects are among the first five and ten."""
    expected, got = _retrieved(spark, d)
    return evaluate.search_quality(expected, got, got.select("task").distinct())


@query("with r as (select user_id task, event_id, floor(value)::bigint tokens, (props::json->>'k')::int % 4 hits, row_number() over (partition by user_id order by ts, event_id) rank from events), x as (select *, coalesce(max((hits >= 3)::int) over (partition by task order by rank rows between unbounded preceding and 1 preceding), 0) done from r where rank <= 5) select task, count(*) \"reads\", sum(tokens)::bigint tokens, max(hits) hits from x where done = 0 group by 1")
def eval_reads(spark, d):
    """Files read one after another until one holds all three symbols, five at most."""
    from pyspark.sql import Window

    e = _t(spark, d, "events").select(F.col("user_id").alias("task"), F.floor("value").cast("long").alias("tokens"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("hits"), F.lit(3).alias("total"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rank"))
    return evaluate.until_success(e).select("task", "reads", "tokens", "hits")


@query("select event_id, value >= 50 and ((event_id % 3) = 0 or event_id % 2 = 1) search, event_type = 'click' context_only, value >= 50 and ((event_id % 3) = 0 or event_id % 2 = 1) and event_type = 'click' both_modes, not (event_type = 'click' and user_id % 2 = 0) honest from events")
def eval_pass(spark, d):
    """Whether tasks pass by each mode, and whether a search claims no more than it knows."""
    e = _t(spark, d, "events")
    p5, total, hits, ok = F.col("value") / 100, F.col("event_id") % 3, F.col("event_id") % 2, F.col("event_type") == "click"
    engine, conf = F.when(F.col("user_id") % 2 == 0, "walk").otherwise("rg"), F.when(ok, "high").otherwise("low")
    return e.select("event_id", evaluate.passed(p5, hits, total).alias("search"), evaluate.passed(p5, hits, total, ok, "context").alias("context_only"), evaluate.passed(p5, hits, total, ok, "both").alias("both_modes"), evaluate.honest(engine, F.lit("fresh"), conf).alias("honest"))


@query("with r as (select o_orderkey run, o_orderpriority \"mode\", o_orderdate tt, o_orderstatus = 'P' b, round(o_totalprice, 2) s from orders), l as (select run, \"mode\", lag(run) over w other, lag(s) over w before, s from r where not b window w as (partition by \"mode\" order by tt, run)), z as (select run zr, s zs from r where b order by tt desc, run desc limit 1) select run, \"mode\", coalesce(other, zr) other, case when other is not null then 'previous' when zr is not null then 'baseline' end label, round(s - coalesce(before, zs), 3) delta from l left join z on true")
def eval_compare(spark, d):
    """Each run against the one before it of its mode, else the latest baseline."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("mode"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "P").alias("baseline"), F.round("o_totalprice", 2).alias("score"))
    return evaluate.compared(o)


@query("select event_id, len(list_filter(['event', event_type, 'no such', 'k' || user_id], lambda s: contains('an event ' || event_type || ' Symbol not found: event', s) and not contains('an event ' || event_type || ' Symbol not found: event', 'Symbol not found: ' || s)))::int symbol_hits, 4::int symbol_total from events")
def eval_symbols(spark, d):
    """How many wanted symbols a text holds; those that it says are missing don't count."""
    e = _t(spark, d, "events")
    rows = e.select("event_id", F.array(F.lit("event"), F.col("event_type"), F.lit("no such"), F.concat(F.lit("k"), F.col("user_id").cast("string"))).alias("symbols"), F.concat(F.lit("an event "), "event_type", F.lit(" Symbol not found: event")).alias("found"))
    return evaluate.symbols_found(rows).select("event_id", "symbol_hits", "symbol_total")


@query(f"with i as (select task, rank place, path, case when rank % 3 = 2 then 'primary' else 'test' end \"role\", case when rank % 2 = 0 then 'why' else ' ' end reason, rank % 4 previews from {_GOT} where rank <= 6), p as (select task, arg_min(path, case when \"role\" = 'primary' then 0 else 1000 end + place) primary_path, count(*) n_items, round(count(*) filter (trim(reason) <> '') / count(*), 3) explained, round(count(*) filter (previews > 0) / count(*), 3) previewed from i group by 1), m as (select e.task, count(i.path) / count(*) precision_, bool_or(i.path = p.primary_path) hit from {_EXPECTED} e left join i on i.task = e.task and ends_with(i.path, e.path) left join p on p.task = e.task group by 1) select task, n_items, explained, previewed, coalesce(precision_, 1) \"precision\", coalesce(hit, false) primary_hit, coalesce(precision_ > 0, true) passed from p left join m using (task)")
def eval_context(spark, d):
    """What is in the context of each task: how much is explained, previewed and expected, and whether the primary file is."""
    expected, got = _retrieved(spark, d)
    items = got.where("rank <= 6").select("task", F.col("rank").alias("place"), "path", F.when(F.col("rank") % 3 == 2, "primary").otherwise("test").alias("role"), F.when(F.col("rank") % 2 == 0, "why").otherwise(" ").alias("reason"), (F.col("rank") % 4).alias("previews"))
    return evaluate.context_quality(items, expected).drop("primary")
