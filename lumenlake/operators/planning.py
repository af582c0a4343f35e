"""Token budgets, evidence, and the choice of files for a task."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tasks
from ..functions import text as T

# fixed values: the order of roles and of evidence, their points, and what resemblance costs
ROLES = ["primary", "test", "dependency", "dependent"]
ROLE_POINTS = {"primary": 130, "test": 85, "dependency": 60, "dependent": 50}
OTHER_ROLE = 40
EVIDENCE_ORDER = {"entryFile": 0, "diffHit": 1, "searchHit": 2, "symbolMatch": 3, "symbolDetail": 4, "testOf": 5, "dependencyOf": 6, "dependentOf": 7}
EVIDENCE_POINTS = {"entryFile": 120, "diffHit": 100, "searchHit": 70, "symbolMatch": 90, "symbolDetail": 95, "testOf": 40, "dependencyOf": 25, "dependentOf": 22}
SAME_DIR, SAME_ROLE, SAME_VIA, SAME_SYMBOL = {"primary": 3}, {"primary": 2}, 12, 18
OTHER_DIR, OTHER_SAME_ROLE = 8, 5
#: how many of a role are chosen at most (three tests where tests are asked for); none of any other role
ROLE_CAPS = {"primary": 5, "test": 2, "dependency": 3, "dependent": 2}
FILE_TOKENS, MOST_FILES, TIGHT = 800, 10, 4000
#: extensions of which imports and tests are known in full, in part, and tests alone in part
FULL, PARTIAL, TESTS_ONLY = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", ".go"], [".cs", ".kt", ".php", ".swift"], [".rs", ".java"]
EVIDENCE = "array<struct<type:string,via:string,ref:string,rank:int,query:string,symbols:array<string>>>"


# ---- budgets --------------------------------------------------------------------------------------------------------


def prefix_budget(items: DataFrame, group: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """Items in order while their costs fit; the first is always taken. Costs aren't negative, so sums only grow."""
    w = Window.partitionBy(group).orderBy(*order)
    used = items.withColumn("__used", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__rn", F.row_number().over(w))
    return used.where((F.col("__used") <= budget) | (F.col("__rn") == 1)).drop("__rn", "__used")


def skip_budget(costs: Column, budget: int, used: Column | int = 0, exempt: Column | None = None) -> Column:
    """Places (from 1) of the costs taken in order, skipping any that would overflow what is `used` already.

    exempt: the place (from 1) that is taken whatever it costs, the first unless told otherwise."""
    used = F.lit(used) if isinstance(used, int) else used
    free = F.lit(1) if exempt is None else exempt
    start = F.struct(used.cast("long").alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, c: Column) -> Column:
        ok = (s["at"] + 1 == free) | (s["used"] + c <= budget)
        return F.struct((s["used"] + F.when(ok, c).otherwise(0)).cast("long").alias("used"), (s["at"] + 1).alias("at"), F.when(ok, F.concat(s["kept"], F.array(s["at"] + 1))).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(costs, start, step, lambda s: s["kept"])


def with_texts(plan: DataFrame, texts: DataFrame, max_tokens: int, group: str = "task") -> DataFrame:
    """(group, place, rel, ..., text, tokens) of plan(group, place, rel, base_tokens, read_text): what fits a budget of tokens.

    Entries are taken in order as long as their own tokens fit, the first in any case; then the texts of those that ask for one
    (texts: group, rel, text) in order, skipping what would overflow; the first entry's text is exempt. A group is a plan: some ten entries."""
    kept = prefix_budget(plan, group, [F.col("place")], "base_tokens", max_tokens)
    asked = kept.where("read_text").select(group, "place", "rel").join(texts.select(group, "rel", "text"), [group, "rel"]).where(F.col("text") != "")
    costs = asked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", T.token_count(F.col("text")).cast("long").alias("cost"), "rel", "text"))).alias("asked"))
    total = kept.groupBy(group).agg(F.sum("base_tokens").alias("__used"), F.min("place").alias("__first"))
    rows = costs.join(total, group)
    exempt = F.array_position(F.transform("asked", lambda x: x["place"]), F.col("__first"))
    chosen = skip_budget(F.transform("asked", lambda x: x["cost"]), max_tokens, F.col("__used"), exempt)
    given = rows.select(group, F.explode(F.transform(chosen, lambda i: F.element_at("asked", i))).alias("g")).select(group, F.col("g.rel").alias("rel"), F.col("g.text").alias("text"), F.col("g.cost").alias("__cost"))
    out = kept.join(given, [group, "rel"], "left")
    return out.withColumn("tokens", F.col("base_tokens") + F.coalesce("__cost", F.lit(0))).drop("__cost")


# ---- evidence -------------------------------------------------------------------------------------------------------


def _lookup(values: dict[str, int], key: Column, other: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), F.lit(other))


def clean_evidence(evidence: Column) -> Column:
    """Each piece once, with three symbols at most, the weightiest kinds first, then by rank."""
    normal = F.transform(
        F.filter(F.coalesce(evidence, F.array().cast(EVIDENCE)), lambda e: e["type"].isNotNull()),
        lambda e: e.withField("symbols", F.nullif(F.slice(F.array_distinct(F.filter(F.coalesce(e["symbols"], F.array().cast("array<string>")), lambda s: s != "")), 1, 3), F.array().cast("array<string>"))),
    )
    placed = F.transform(F.array_distinct(normal), lambda e, i: F.struct(_lookup(EVIDENCE_ORDER, e["type"], 99).alias("o"), F.coalesce(e["rank"], F.lit(999)).alias("r"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(placed), lambda x: x["e"])


def reason(evidence: Column) -> Column:
    """Why a file is there, by its first piece of evidence."""
    e = F.get(evidence, F.lit(0))
    two = F.array_join(F.slice(F.coalesce(e["symbols"], F.array().cast("array<string>")), 1, 2), ", ")
    with_ = lambda name, field: F.when(F.coalesce(e[field], F.lit("")) != "", F.concat(F.lit(f"{name}: "), e[field])).otherwise(F.lit(name))
    out = F.when(e["type"] == "entryFile", "entry").when(e["type"] == "diffHit", with_("diff", "ref")).when(e["type"] == "searchHit", with_("search", "query"))
    out = out.when(e["type"] == "symbolMatch", F.concat(F.lit("symbol: "), two)).when(e["type"] == "symbolDetail", F.concat(F.lit("detail: "), two))
    return out.when(e["type"] == "testOf", with_("test", "via")).when(e["type"] == "dependencyOf", with_("imported-by", "via")).when(e["type"] == "dependentOf", with_("imports", "via")).otherwise(F.lit("selected"))


def _sum(items: Column, points) -> Column:
    return F.aggregate(items, F.lit(0), lambda s, e: s + points(e).cast("int"))


def _symbols(e: Column) -> Column:
    return F.coalesce(F.size(F.coalesce(e["symbols"], F.array().cast("array<string>"))), F.lit(0))


def _rank(e: Column) -> Column:
    return F.coalesce(e["rank"], F.lit(1)) - 1


def utility(role: Column, evidence: Column, matched: Column, intent: Column) -> Column:
    """What a file is worth by itself: its role, its evidence, the symbols of the task that it holds."""
    points = lambda e: _lookup(EVIDENCE_POINTS, e["type"], 0) + F.when(e["type"] == "searchHit", F.greatest(F.lit(0), 24 - _rank(e) * 6)).when(e["type"] == "symbolMatch", _symbols(e) * 12).otherwise(0)
    return _lookup(ROLE_POINTS, role, OTHER_ROLE) + F.when((role == "test") & (intent == "tests"), 20).otherwise(0) + _sum(evidence, points) + F.size(matched) * 10


def primary_signal(rel: Column, evidence: Column, matched: Column, intent: Column) -> Column:
    """How strongly evidence speaks for a file as the primary one."""
    kind = lambda e: e["type"]
    points = lambda e: F.when(kind(e) == "entryFile", 120).when(kind(e) == "diffHit", 110).when(kind(e) == "searchHit", F.greatest(F.lit(0), 28 - _rank(e) * 6)).when(kind(e) == "symbolMatch", _symbols(e) * 10).when(kind(e) == "symbolDetail", _symbols(e) * 12).otherwise(0)
    low = F.lower(rel)
    place = F.when(low.rlike(tasks.TEST_FOLDER), F.when(intent == "tests", 10).otherwise(-60)).when(low.startswith("src/"), 10).otherwise(0)
    return _sum(evidence, points) + F.size(matched) * 12 + place


def promotion(rel: Column, role: Column, evidence: Column, matched: Column, hints: Column, intent: Column) -> Column:
    return tasks.seed_score(rel, evidence, hints, intent) + primary_signal(rel, evidence, matched, intent) + F.when(role == "primary", 6).otherwise(0)


def demoted(evidence: Column) -> Column:
    """The role of a file that isn't the primary one, by how it is linked."""
    has = lambda t: F.exists(evidence, lambda e: e["type"] == t)
    return F.when(has("testOf"), "test").when(has("dependencyOf"), "dependency").otherwise(F.lit("dependent"))


# ---- from hits to candidates ----------------------------------------------------------------------------------------


def merge_seeds(hits: DataFrame, group: str = "task", per_query: int = 5) -> DataFrame:
    """(group, rel, evidence, query_at, rank_at) of hits(group, query_at, query, rank, rel): the first of each query, a file once.

    A file keeps the place of its best query; its evidence is that of all."""
    near = hits.where(F.col("rank") <= per_query)
    piece = F.struct(F.lit("searchHit").alias("type"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("ref"), F.col("rank").cast("int").alias("rank"), F.col("query"), F.lit(None).cast("array<string>").alias("symbols"))
    # six queries at most, so what is gathered for a file is small
    out = near.groupBy(group, "rel").agg(F.min(F.struct("query_at", "rank")).alias("at"), F.array_sort(F.collect_list(F.struct("query_at", piece.alias("e")))).alias("e"))
    return out.select(group, "rel", clean_evidence(F.transform("e", lambda x: x["e"])).alias("evidence"), F.col("at.query_at").alias("query_at"), F.col("at.rank").alias("rank_at"))


def best_seeds(seeds: DataFrame, points: str = "points", group: str = "task", k: int = 5) -> DataFrame:
    """The k seeds of most points of each group; of equal ones the least path."""
    w = Window.partitionBy(group).orderBy(F.desc(points), "rel")
    return seeds.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def expand(seeds: DataFrame, edges: DataFrame, group: str = "task") -> DataFrame:
    """(group, rel, role, evidence): the seeds, and what they import, what imports them and what tests them, a step away.

    seeds: (group, rel, evidence); edges: (src, dst, kind import or testOf). A file with several roles has the first of ROLES."""
    none = F.lit(None).cast("string")
    via = lambda kind, col: F.array(F.struct(F.lit(kind).alias("type"), F.col(col).alias("via"), none.alias("ref"), F.lit(None).cast("int").alias("rank"), none.alias("query"), F.lit(None).cast("array<string>").alias("symbols"))).cast(EVIDENCE)
    e, s = edges.distinct(), seeds.select(group, F.col("rel").alias("seed"))
    out = s.join(e.where("kind = 'import'"), F.col("seed") == F.col("src")).select(group, F.col("dst").alias("rel"), F.lit(2).alias("role"), via("dependencyOf", "seed").alias("evidence"))
    back = s.join(e.where("kind = 'import'"), F.col("seed") == F.col("dst")).select(group, F.col("src").alias("rel"), F.lit(3).alias("role"), via("dependentOf", "seed").alias("evidence"))
    test = s.join(e.where("kind = 'testOf'"), F.col("seed") == F.col("dst")).select(group, F.col("src").alias("rel"), F.lit(1).alias("role"), via("testOf", "seed").alias("evidence"))
    every = seeds.select(group, "rel", F.lit(0).alias("role"), F.col("evidence").cast(EVIDENCE).alias("evidence")).union(test).union(out).union(back)
    # five seeds a task at most: pieces of evidence of a file are few
    met = every.groupBy(group, "rel").agg(F.min("role").alias("role"), F.flatten(F.array_sort(F.collect_list("evidence"))).alias("evidence"))
    names = F.array(*(F.lit(r) for r in ROLES))
    return met.select(group, "rel", F.get(names, F.col("role")).alias("role"), clean_evidence(F.col("evidence")).alias("evidence"))


def neighbours(seeds: DataFrame, files: DataFrame, group: str = "task") -> DataFrame:
    """(group, path) of the files in the folders of the seeds, themselves left out."""
    here = seeds.select(group, F.col("rel").alias("seed"), T.dirname(F.col("rel")).alias("dir"))
    there = files.select("path", T.dirname(F.col("path")).alias("dir"))
    return here.join(there, "dir").where("path <> seed").select(group, "path").distinct().join(seeds.select(group, F.col("rel").alias("path")), [group, "path"], "left_anti")


def with_symbols(candidates: DataFrame, symbols: DataFrame, wanted: DataFrame, group: str = "task") -> DataFrame:
    """candidates with `matched`, the symbols of the task that a file holds (three at most), and evidence of them.

    symbols: (path, name); wanted: (group, name): names are alike whatever their case."""
    hit = symbols.select(F.col("path").alias("rel"), F.lower("name").alias("low"), "name").join(wanted.select(group, F.lower("name").alias("low")).distinct(), "low").join(candidates.select(group, "rel"), [group, "rel"])
    hit = hit.groupBy(group, "rel").agg(F.slice(F.array_sort(F.collect_set("name")), 1, 3).alias("matched"))
    none = F.lit(None).cast("string")
    piece = F.array(F.struct(F.lit("symbolMatch").alias("type"), none.alias("via"), none.alias("ref"), F.lit(None).cast("int").alias("rank"), none.alias("query"), F.col("matched").alias("symbols"))).cast(EVIDENCE)
    out = candidates.join(hit, [group, "rel"], "left")
    return out.withColumn("evidence", F.when(F.col("matched").isNotNull(), clean_evidence(F.concat("evidence", piece))).otherwise(F.col("evidence"))).withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))


def with_primary(candidates: DataFrame, group: str = "task") -> DataFrame:
    """candidates(group, rel, role, evidence, matched, promotion) with one primary file a task, the most promoted; others fall back to their link."""
    w = Window.partitionBy(group)
    best = F.min_by("rel", F.struct(-F.col("promotion"), F.col("rel"))).over(w)
    marked = candidates.withColumn("__best", best)
    return marked.withColumn("role", F.when(F.col("rel") == F.col("__best"), "primary").when(F.col("role") == "primary", demoted(F.col("evidence"))).otherwise(F.col("role"))).drop("__best")


def allocate(candidates: DataFrame, group: str = "task", max_tokens: int = 8000, detail: str = "balanced") -> DataFrame:
    """The plan of reading: (all columns, place, gain, mode), the candidate of highest worth less what resembles the chosen ones, again and again.

    candidates: (group, rel, role, utility, via, matched, intent). A task has at most five seeds and their links; shortlist() bounds any other."""
    most = min(MOST_FILES, -(-max_tokens // FILE_TOKENS))
    tight = max_tokens < TIGHT
    names = list(candidates.columns)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values("rel").to_dict("records")
        out: list[dict] = []
        room = dict(ROLE_CAPS)
        if len(left) and left[0].get("intent") == "tests":
            room["test"] = 3
        folder = lambda rel: rel.rpartition("/")[0] or "."
        while len(out) < most and (left := [c for c in left if room.get(c["role"], 0) > 0]):

            def gain(c: dict) -> float:
                lost = 0
                via, named = set(c["via"]), {s.lower() for s in c["matched"]}
                for o in out:
                    lost += (folder(c["rel"]) == folder(o["rel"])) * SAME_DIR.get(c["role"], OTHER_DIR) + (c["role"] == o["role"]) * SAME_ROLE.get(c["role"], OTHER_SAME_ROLE)
                    lost += sum(v in via for v in set(o["via"])) * SAME_VIA + sum(s.lower() in named for s in o["matched"]) * SAME_SYMBOL
                return c["utility"] - lost

            scored = [(gain(c), c) for c in left]
            top = max(g for g, _ in scored)
            best = min((c for g, c in scored if g == top), key=lambda c: (ROLES.index(c["role"]), c["rel"]))
            mode = "full" if detail == "deep" else "outline" if best["role"] == "primary" and not tight else "signatures"
            out.append(best | {"place": len(out) + 1, "gain": float(top), "mode": mode})
            left.remove(best)
            room[best["role"]] -= 1
        return pd.DataFrame(out, columns=[*names, "place", "gain", "mode"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema) + ", place int, gain double, mode string"
    return candidates.groupBy(group).applyInPandas(choose, schema)


def shortlist(candidates: DataFrame, group: str = "task", k: int = 5) -> DataFrame:
    """What greedy() can choose: of each role, the k best of each of the k folders with the best candidates.

    Within a role and folder all gain and lose alike, so the better goes first; and of k folders one is without a chosen
    item until k are chosen, so a folder behind these can't be the next."""
    names = candidates.columns
    marked = candidates.where(F.col("role").isin(*ROLE_CAPS)).withColumn("__dir", T.dirname(F.col("rel")))
    near = Window.partitionBy(group, "role", "__dir").orderBy(F.desc("utility"), "rel")
    best = marked.withColumn("__rn", F.row_number().over(near)).withColumn("__first", F.first("utility").over(near)).withColumn("__name", F.first("rel").over(near)).where(F.col("__rn") <= k)
    return best.withColumn("__rank", F.dense_rank().over(Window.partitionBy(group, "role").orderBy(F.desc("__first"), "__name"))).where(F.col("__rank") <= k).select(*names)


def greedy(candidates: DataFrame, group: str = "task", k: int = 5) -> DataFrame:
    """allocate() for candidates(group, rel, role, utility) of any number, k of each task, with place and gain."""
    bare = F.array().cast("array<string>")
    few = shortlist(candidates, group, k).withColumns({"via": bare, "matched": bare, "intent": F.lit("")})
    few = few.withColumn("utility", F.col("utility").cast("double"))
    return allocate(few, group, k * FILE_TOKENS).drop("via", "matched", "intent", "mode")


# ---- freshness and coverage -----------------------------------------------------------------------------------------


def freshness(states: DataFrame, group: str, state: str = "state") -> DataFrame:
    """stale if any is, else fresh if any is, else unavailable."""
    has = lambda s: F.bool_or(F.col(state) == s)
    return states.groupBy(group).agg(F.when(has("stale"), "stale").when(has("fresh"), "fresh").otherwise("unavailable").alias("freshness"))


def index_freshness(known: DataFrame, disk: DataFrame, group: str) -> DataFrame:
    """(group, freshness) by the times of files: stale if one that the index knows (group, path, mtime) has another time on disk (path, mtime), fresh if none
    has, unavailable if the index knows none that is there."""
    met = known.select(group, "path", F.col("mtime").alias("__known")).join(disk.select("path", F.col("mtime").alias("__now")), "path", "left")
    state = F.when(F.col("__now").isNull(), F.lit(None)).when(F.floor("__known") != F.floor("__now"), "stale").otherwise("fresh")
    return freshness(met.withColumn("state", state), group)


def coverage(files: DataFrame, path: str = "path") -> DataFrame:
    """One row: how much of the graph is known of all these files, the least of what is known of each extension."""
    ext = T.extension(F.col(path))
    imports = F.when(ext.isin(FULL), 2).when(ext.isin(PARTIAL), 1).otherwise(0)
    tests = F.when(ext.isin(FULL), 2).when(ext.isin(PARTIAL + TESTS_ONLY), 1).otherwise(0)
    name = lambda x: F.get(F.array(F.lit("none"), F.lit("partial"), F.lit("full")), F.coalesce(F.min(x), F.lit(0)))
    return files.agg(name(imports).alias("imports"), name(tests).alias("tests"))


# ---- what is handed on of a file --------------------------------------------------------------------------------------

#: fixed values: kinds of symbols that are shown first, and their order
TOP_KINDS, NEXT_KINDS = ["class", "function", "method"], ["interface", "type", "protocol", "trait", "struct", "enum", "actor"]


def previews(symbols: Column, matched: Column, most: Column, any_symbol: bool = True) -> Column:
    """Names and heads of a file's symbols: those of the task first, then classes and functions, then types, then the rest.

    symbols: array of structs with name, kind, line, signature, snippet; most: how many."""
    low = F.transform(matched, F.lower)
    known = lambda s: F.array_contains(low, F.lower(s["name"]))
    kind = lambda s: F.when(s["kind"].isin(TOP_KINDS), 4).when(s["kind"].isin(NEXT_KINDS), 3).otherwise(0)
    rich = lambda s: F.when(F.coalesce(s["signature"], F.lit("")) != "", 1).otherwise(0) + F.when(F.coalesce(s["snippet"], F.lit("")) != "", 1).otherwise(0)
    some = symbols if any_symbol else F.filter(symbols, known)
    key = lambda s, i: F.struct(F.when(known(s) | (kind(s) > 0), 0).otherwise(1).alias("z"), F.when(known(s), 0).otherwise(1).alias("m"), (-kind(s)).alias("k"), (-rich(s)).alias("r"), s["line"].alias("l"), i.alias("i"), s.alias("s"))
    head = lambda s: F.coalesce(F.nullif(s["signature"], F.lit("")), F.nullif(s["snippet"], F.lit("")))
    return F.slice(F.transform(F.array_sort(F.transform(some, key)), lambda x: F.struct(x["s"]["name"].alias("name"), x["s"]["kind"].alias("kind"), head(x["s"]).alias("head"))), F.lit(1), most)


def payload(plan: DataFrame, symbols: DataFrame, group: str = "task", detail: str = "balanced") -> DataFrame:
    """plan with reason, evidence that is handed on, names, signatures and previews of its files' symbols, and whether the text is to be read.

    symbols: (path, name, kind, line, signature, snippet); those of a file are gathered, so a file is a row here."""
    entry = F.struct("line", "name", "kind", "signature", "snippet")
    of = symbols.groupBy(F.col("path").alias("rel")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    p = plan.join(of, "rel", "left")
    bare = F.array().cast("array<struct<line:int,name:string,kind:string,signature:string,snippet:string>>")
    p = p.withColumn("entries", F.coalesce(F.col("entries").cast("array<struct<line:int,name:string,kind:string,signature:string,snippet:string>>"), bare))
    primary = F.col("role") == "primary"
    minimal = detail == "minimal"
    most = F.when(primary, 3).otherwise(2) if minimal else F.when(F.size("matched") > 0, 3).when(primary, 2).when(F.col("role").isin("dependency", "test"), 1).otherwise(0)
    names = F.when(primary, 4).otherwise(2) if minimal else F.when(primary, 6).otherwise(3)
    p = p.withColumn("previews", previews(F.col("entries"), F.col("matched"), most))
    shown = primary | (F.size("previews") == 0)
    cut = lambda field: F.when(shown, F.slice(F.filter(F.transform("entries", lambda e: e[field]), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(1), names)).otherwise(F.array().cast("array<string>"))
    links = F.filter("evidence", lambda e: e["type"].isin("testOf", "dependencyOf", "dependentOf"))
    told = F.when(primary, F.slice("evidence", 1, 2)).otherwise(F.slice(F.array_distinct(F.concat(F.slice(links, 1, 1), F.slice("evidence", 1, 1))), 1, 1))
    p = p.withColumns({"names": cut("name"), "signatures": cut("signature"), "reason": reason(F.col("evidence")), "told": told})
    strong = (F.size("previews") > 0) | (F.size("signatures") > 0)
    if minimal or detail == "deep":
        read = F.lit(detail == "deep")
    else:
        read = F.when(primary, (F.size("matched") == 0) & ~strong).when((F.col("role") == "test") & (F.col("intent") == "tests"), ~strong).when(F.col("role") == "dependency", ~strong & (F.size("names") == 0)).otherwise(False)
    return p.withColumn("read_text", read).drop("entries")


def context(tasks_: DataFrame, hits: DataFrame, edges: DataFrame, symbols: DataFrame, max_tokens: int = 8000, detail: str = "balanced") -> DataFrame:
    """What to read for each of tasks_(task, text): the plan of files with roles, reasons and previews.

    hits: (task, query_at, query, rank, rel), the best files of each of query_candidates(); edges and symbols: of the index."""
    named = tasks_.select("task", T.infer_intent(F.col("text")).alias("intent"), tasks.path_hints(F.col("text")).alias("hints"), tasks.symbols(F.col("text")).alias("wanted"))
    merged = merge_seeds(hits).join(named, "task")
    merged = merged.withColumn("points", tasks.seed_score(F.col("rel"), F.col("evidence"), F.col("hints"), F.col("intent")))
    best = best_seeds(merged)
    near = with_symbols(expand(best.select("task", "rel", "evidence"), edges), symbols, named.select("task", F.explode("wanted").alias("name"))).join(named.drop("wanted"), "task")
    near = near.withColumn("promotion", promotion(F.col("rel"), F.col("role"), F.col("evidence"), F.col("matched"), F.col("hints"), F.col("intent")))
    near = with_primary(near).withColumn("utility", utility(F.col("role"), F.col("evidence"), F.col("matched"), F.col("intent")).cast("double"))
    via = F.array_distinct(F.filter(F.transform("evidence", lambda e: e["via"]), lambda v: v.isNotNull()))
    plan = allocate(near.withColumn("via", via).drop("hints", "promotion"), "task", max_tokens, detail)
    return payload(plan, symbols, "task", detail)
