"""From the text of a task to search queries and to points of a file's path: column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# fixed values: words that aren't searched for, patterns of names, and points
STOP_WORDS = [
    "the", "a", "an", "in", "on", "at", "to", "for", "of", "with", "is", "are",
    "was", "were", "be", "been", "and", "or", "but", "not", "this", "that", "it",
    "how", "what", "where", "when", "why", "which", "who", "do", "does", "did",
    "has", "have", "had", "from", "by", "about", "into", "my", "our", "your",
    "can", "could", "will", "would", "should", "may", "might", "i", "we", "you",
    "all", "each", "every", "me", "us", "them", "its",
]
LOW_SIGNAL = [
    "find", "show", "list", "get", "search", "locate", "lookup", "look", "check",
    "inspect", "review", "analyze", "analyse", "understand", "explore", "read",
    "open", "walk", "help", "need", "want", "please", "context", "preview",
    "recall", "stuff", "thing", "things", "happen", "happens", "handle", "handles",
    "handling", "wired", "declare", "declared", "defined", "owns", "owner", "existing",
    "exercise", "exercises", "before", "main", "shared", "related", "across", "split",
    "live", "lives", "surface", "public", "entry", "point", "path", "logic", "covers",
    "api", "apis", "flow", "flows", "file", "files", "onboarding", "app", "application", "load", "loads", "loaded",
]
#: word bounds of ASCII, as the text around may be in any script
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
NAMES = rf"{_L}[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*{_R}|{_L}[A-Z][a-zA-Z0-9]{{2,}}{_R}|{_L}[a-z]{{2,}}_[a-z_]+{_R}"
COMPOUNDS = {"createUser": r"(create[-\s]+user|user[-\s]+creation)", "jwtSecret": r"jwt[-\s]+secret"}
CONTAINER = r"(container|docker|image|deploy|deployment)"
HINTS = [
    (r"(api|endpoint|endpoints|route|routes)", ["api", "routes"]), (r"(auth|token|jwt|login|session)", ["auth"]), (r"(config|env|secret|yaml|json)", ["config"]),
    (r"(test|tests|spec|coverage)", ["test", "tests"]), (r"(model|models|schema|schemas|entity|entities)", ["model", "models"]), (CONTAINER, ["dockerfile", "docker"]),
]
TEST_FOLDER = r"(^|/)(tests?|__tests__)/"
QUERIES, CANDIDATES = 3, 6


def _says(low: Column, pattern: str) -> Column:
    return low.rlike(_L + pattern + _R)


def _found(condition: Column, values: list[str]) -> Column:
    return F.when(condition, F.array(*(F.lit(v) for v in values))).otherwise(F.array().cast("array<string>"))


def _without_jwt(queries: Column, compounds: Column) -> Column:
    return F.when(F.array_contains(compounds, "jwtSecret"), F.filter(queries, lambda q: F.lower(q) != "jwt")).otherwise(queries)


def compounds(task: Column) -> Column:
    """Names that a phrase stands for."""
    return F.concat(*(_found(_says(F.lower(task), p), [k]) for k, p in COMPOUNDS.items()))


def symbols(task: Column) -> Column:
    """Names in a task: those of its phrases, then whatever is written like one."""
    c = compounds(task)
    return F.array_distinct(F.concat(c, _without_jwt(F.regexp_extract_all(task, F.lit(NAMES), 0), c)))


def like_code(name: Column) -> Column:
    return name.rlike("_|[0-9]|[a-z][A-Z]|[A-Z]{2,}")


def keywords(task: Column, intents_too: bool = False) -> Column:
    """The words to search for, the most telling first: long ones and early ones."""
    low = F.lower(task)
    words = F.transform(F.regexp_extract_all(task, F.lit("[a-zA-Z0-9_]+"), 0), F.lower)
    out = STOP_WORDS + LOW_SIGNAL + ([] if intents_too else [w for ws in T.INTENT_WORDS.values() for w in ws])
    words = F.filter(words, lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$") & ~w.isin(out))

    def place(w: Column) -> Column:
        at, n = F.position(w, low) - 1, F.length(w)
        points = F.least(n, F.lit(8)) + F.when(at >= 0, F.greatest(F.lit(0), 16 - at)).otherwise(0) + F.when(n >= 12, 1).otherwise(0)
        return F.struct((-points).alias("p"), at.alias("at"), (-n).alias("n"), w.alias("w"))

    return _without_jwt(F.array_distinct(F.transform(F.array_sort(F.transform(words, place)), lambda x: x["w"])), compounds(task))


def search_queries(task: Column) -> Column:
    """Three queries at most: names that look like code, then keywords; alike ones but for case once."""
    names = F.filter(symbols(task), lambda s: like_code(s) & ~F.lower(s).isin(LOW_SIGNAL + STOP_WORDS))
    every = F.transform(F.concat(names, keywords(task)), lambda q, i: F.struct(F.lower(q).alias("key"), i.alias("at"), q.alias("q")))
    none = F.lit(None).cast("struct<key:string,at:int,q:string>")
    # names and words are worked out once, though sorted and held against their neighbours
    pairs = T.let(F.array_sort(every), lambda s: F.arrays_zip(s.alias("me"), F.concat(F.array(none), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).alias("before")))
    first = F.filter(pairs, lambda p: p["me"].isNotNull() & (p["before"]["key"].isNull() | (p["me"]["key"] != p["before"]["key"])))
    return F.slice(F.transform(F.array_sort(F.transform(first, lambda p: F.struct(p["me"]["at"].alias("at"), p["me"]["q"].alias("q")))), lambda p: p["q"]), 1, QUERIES)


def expanded_queries(task: Column) -> Column:
    return F.concat(compounds(task), _found(_says(F.lower(task), CONTAINER), ["FROM"]))


def fallback_query(task: Column) -> Column:
    """The first name that looks like code, else the first keyword (intents too), else the task itself."""
    return F.coalesce(F.get(F.filter(symbols(task), like_code), F.lit(0)), F.get(keywords(task, True), F.lit(0)), T.strip(task))


def query_candidates(task: Column) -> Column:
    """Up to six queries in the order in which their hits count."""
    words = F.struct(symbols(task).alias("names"), keywords(task, True).alias("words"))
    last = lambda w: F.coalesce(F.get(F.filter(w["names"], like_code), F.lit(0)), F.get(w["words"], F.lit(0)), T.strip(task))
    every = T.let(words, lambda w: F.concat(expanded_queries(task), search_queries(task), w["words"], F.array(last(w))))
    return F.slice(F.array_distinct(F.filter(every, lambda q: q != "")), 1, CANDIDATES)


def path_tokens(path: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(path), F.lit("[a-z0-9]+"), 0), lambda t: F.length(t) > 1))


def path_hints(task: Column) -> Column:
    """Words of a task that a path may hold, and what its subject suggests."""
    low = F.lower(task)
    words = F.filter(F.regexp_extract_all(low, F.lit("[a-zA-Z0-9_]+"), 0), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS + LOW_SIGNAL))
    return F.array_distinct(F.concat(words, *(_found(_says(low, p), h) for p, h in HINTS)))


def _total(items: Column, points) -> Column:
    return F.aggregate(items, F.lit(0), lambda s, x: s + points(x).cast("int"))


def seed_score(rel: Column, evidence: Column, hints: Column, intent: Column) -> Column:
    """Points of a file as the primary one of a task; evidence: array of structs with type, query and rank; hints: path_hints()."""
    low = F.lower(rel)
    path = F.struct(low.alias("low"), F.regexp_replace(T.basename(low), r"(?<=.)\.[^.]*$", "").alias("base"), path_tokens(low).alias("tokens"))
    return T.let(path, lambda p: _seed_points(p["low"], p["base"], p["tokens"], evidence, hints, intent))


def _seed_points(low: Column, base: Column, tokens: Column, evidence: Column, hints: Column, intent: Column) -> Column:
    hits = F.filter(evidence, lambda e: e["type"] == "searchHit")

    def hit(e: Column) -> Column:
        q = F.lower(e["query"])
        named = F.when(F.coalesce(q, F.lit("")) == "", 0).when(base == q, 28).when(F.contains(low, q), 18).when(F.array_contains(tokens, q), 14).otherwise(0)
        return F.greatest(F.lit(0), 40 - (F.coalesce(e["rank"], F.lit(1)) - 1) * 8) + named

    known = lambda h: F.when(base == h, 28).when(F.contains(low, h) | F.array_contains(tokens, h), 18).otherwise(0)
    api = F.array_contains(hints, "api") | F.array_contains(hints, "routes")
    in_src = low.startswith("src/")

    def total(of_hints: Column) -> Column:
        return (
            F.coalesce(_total(hits, hit), F.lit(0)) + of_hints
            + F.when(api & low.rlike("(^|/)(api|routes)(/|$)"), 28).otherwise(0) - F.when(api & low.rlike("(^|/)(models?|schemas?)(/|$)"), 12).otherwise(0)
            + F.when(low.rlike(TEST_FOLDER), F.when(intent == "tests", 24).otherwise(-40)).when(intent == "tests", -10).otherwise(0)
            + F.when(in_src, F.when(intent == "implementation", 10).when(intent.isin("debug", "review"), 8).otherwise(0) + F.when(of_hints > 0, 6).otherwise(0)).otherwise(0)
        )

    return T.let(_total(hints, known), total)
