"""Column builders for text: all built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the word lists, scores and limits that results depend on
INTENT_WORDS = {
    "debug": ["debug", "fix", "error", "bug", "crash", "fail", "broken", "issue", "trace"],
    "tests": ["test", "spec", "coverage", "assert", "mock", "jest", "vitest"],
    "config": ["config", "env", "setup", "deploy", "docker", "ci", "terraform", "yaml", "secret", "secrets", "settings", "database"],
    "docs": ["doc", "readme", "explain", "document", "guide"],
    "implementation": ["implement", "add", "create", "build", "feature", "refactor", "update", "modify"],
}
INTENTS = ["implementation", "debug", "tests", "config", "docs", "explore"]
#: words that say nothing when a prompt is held against a summary
STOP_WORDS = [
    "the", "and", "for", "with", "that", "this", "from", "into", "when", "where",
    "what", "have", "will", "your", "about", "there", "their", "then", "than",
    "want", "need", "make", "does", "just", "each", "also", "todo", "done",
    "pero", "para", "como", "esta", "esto", "cuando", "donde", "quiero", "hacer",
    "sobre", "porque", "tengo", "vamos", "luego", "ahora", "puede", "puedo",
]
SIGNATURE_WORDS, SIGNATURE_LEAST = 8, 2
#: what is trimmed at both ends of a text
BLANK = " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.btrim(text, F.lit(BLANK))


def collapse(text: Column) -> Column:
    """Runs of white space made one space each, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{BLANK}]+", " "))


def trim_signature(text: Column, most: int = 200) -> Column:
    """On one line, capped with an ellipsis beyond the limit (280 for snippets)."""
    one = collapse(text)
    return F.when(F.length(one) > most, F.concat(F.left(one, F.lit(most)), F.lit("..."))).otherwise(one)


def snippet(text: Column, line: Column, most: int = 3) -> Column:
    """Up to three lines from a line on, before the first blank one, on one line."""
    from_ = F.slice(lines(text), line, F.lit(most))
    blank = F.array_position(F.transform(from_, lambda x: F.when(strip(x) == "", 1).otherwise(0)), 1)
    return trim_signature(F.array_join(F.when(blank > 0, F.slice(from_, F.lit(1), (blank - 1).cast("int"))).otherwise(from_), " "), 280)


def truncate(text: Column, most: int = 4000) -> Column:
    n = F.length(text)
    return F.when(n > most, F.concat(F.left(text, F.lit(most)), F.lit("\n\n[truncated "), (n - most).cast("string"), F.lit(" chars]"))).otherwise(text)


def shorten(text: Column, most: int) -> Column:
    """Capped with an ellipsis inside the limit; limits up to 3 leave nothing of a longer text."""
    if most <= 3:
        return F.when(F.length(text) <= most, text).otherwise(F.lit(""))
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def smart_case_contains(text: Column, query: str) -> Column:
    """Case counts if the query has a capital."""
    return F.contains(text, F.lit(query)) if query != query.lower() else F.contains(F.lower(text), F.lit(query))


def token_count(text: Column) -> Column:
    """Words and single symbols; the default of the pluggable token counters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")), F.lit(0))


def fits_tokens(text: Column, most: int) -> Column:
    """Whether a text has `most` tokens or fewer. A start of it has no more than the whole, so long texts are mostly told by theirs."""
    head = F.left(text, F.lit(16 * most))
    return F.when((F.length(text) > 16 * most) & (token_count(head) > most), F.lit(False)).otherwise(token_count(text) <= most)


def task_signature(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 \t\n]", " "), "[ \t\n]+")
    return F.array_join(F.slice(F.filter(words, lambda w: F.length(w) > SIGNATURE_LEAST), 1, SIGNATURE_WORDS), " ")


def terms(text: Column) -> Column:
    words = F.split(F.lower(text), "[^a-z0-9_.-]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS)))


def infer_intent(text: Column) -> Column:
    """The intent with the most keywords in the text; the earlier of equal ones; explore without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    score = {k: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for k, words in INTENT_WORDS.items()}
    best = F.greatest(*score.values())
    out = F.when(best == 0, F.lit("explore"))
    for k, s in score.items():
        out = out.when(s == best, F.lit(k))
    return out


def relevant_lines(text: Column, patterns: list[str]) -> Column:
    keep = lambda line: F.exists(F.array(*(F.lit(p.lower()) for p in patterns)), lambda p: F.contains(F.lower(line), p))
    return F.array_join(F.filter(lines(text), keep), "\n")


def unique_lines(text: Column) -> Column:
    """The first of lines alike but for white space around them; blank lines all stay.

    Lines are sorted by key and held against their neighbours: no line is searched for among all."""
    none = F.lit(None).cast("struct<key:string,at:int,line:string>")

    def kept(keyed: Column) -> Column:
        pairs = F.arrays_zip(keyed.alias("me"), F.concat(F.array(none), F.slice(keyed, F.lit(1), F.size(keyed) - 1)).alias("before"))
        first = F.filter(pairs, lambda p: (p["me"]["key"] == "") | p["before"]["key"].isNull() | (p["me"]["key"] != p["before"]["key"]))
        return F.array_join(F.transform(F.array_sort(F.transform(first, lambda p: F.struct(p["me"]["at"].alias("at"), p["me"]["line"].alias("line")))), lambda p: p["line"]), "\n")

    return let(F.array_sort(F.transform(lines(text), lambda x, i: F.struct(strip(x).alias("key"), i.alias("at"), x.alias("line")))), kept)


def first_lines(items: Column, most: int | None = None) -> Column:
    """Items as lines, each once, none blank, the first `most` of them."""
    kept = F.filter(F.split(unique_lines(F.array_join(items, "\n")), "\n"), lambda x: x != "")
    return kept if most is None else F.slice(kept, 1, most)


def section(title: str, items: Column, most: int) -> Column:
    """A title and its lines, capped; '' without lines."""
    return let(items, lambda x: F.when(F.size(x) == 0, F.lit("")).otherwise(let(F.concat(F.lit(title + "\n"), F.array_join(x, "\n")), lambda t: truncate(t, most))))


def sections(parts: list[Column], most: int) -> Column:
    """The parts that aren't empty, a blank line between, capped."""
    return let(F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n"), lambda t: truncate(t, most))


def numbered(items: Column, first: Column) -> Column:
    """Lines as number|line."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((first + i).cast("string"), F.lit("|"), x)), "\n")


def line_range(text: Column, start: Column | None = None, end: Column | None = None, most: int | None = 12000) -> Column:
    """Lines from start to end (counted from 1, both optional), numbered, capped unless most is None."""
    ls = lines(text)
    a = F.greatest(F.lit(0), F.coalesce(start if start is not None else F.lit(None).cast("int"), F.lit(1)) - 1)
    z = F.coalesce(end if end is not None else F.lit(None).cast("int"), F.size(ls))
    out = numbered(F.slice(ls, a + 1, F.greatest(z - a, F.lit(0))), a + 1)
    return out if most is None else truncate(out, most)


def prefix_by_tokens(text: Column, most: int, marker: str = "[truncated]") -> Column:
    """Leading lines whose tokens fit the limit less the marker's; the marker follows on a line of its own."""
    import re

    room = max(1, most - len(re.findall(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]", marker, re.ASCII)))
    # how many lines fit: running sums stop at the first that overflows
    state = lambda used, over, n: F.struct(used.alias("used"), over.alias("over"), n.alias("n"))
    more = lambda s, used: F.when(used > room, state(s["used"], F.lit(True), s["n"])).otherwise(state(used, F.lit(False), s["n"] + 1))
    step = lambda s, x: F.when(s["over"], state(s["used"], s["over"], s["n"])).otherwise(let(s["used"] + token_count(x), lambda used: more(s, used)))
    n = lambda ls: F.aggregate(ls, state(F.lit(0), F.lit(False), F.lit(0)), step, lambda s: s["n"])
    return let(lines(text), lambda ls: F.array_join(F.concat(F.slice(ls, F.lit(1), n(ls)), F.array(F.lit("\n" + marker))), "\n"))


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(?:\.(?:test|spec)\.[jt]sx?$|__tests__|_test\.go$|test_\w+\.py$|Tests?\.(?:cs|kt|swift)$|_test\.(?:cs|kt)$|Test\.php$)")


def extension(path: Column) -> Column:
    """.ext of the last part of a path in lower case; '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def dirname(path: Column) -> Column:
    """The folder of a path; '.' without one."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(folder == "", F.lit(".")).otherwise(folder)


def is_dockerfile(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)dockerfile(\.[^/]*)?$")


def compact_path(path: Column) -> Column:
    """The last three parts of a long path behind '.../', unless the path itself is as short."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    whole = F.replace(path, F.lit("\\"), F.lit("/"))
    n = F.least(F.lit(3), F.size(parts))
    tail = F.array_join(F.when(n > 0, F.slice(parts, -n, n)).otherwise(parts), "/")
    short = (F.size(parts) <= 3) & (F.length(whole) <= 60) | (F.length(whole) <= F.length(tail))
    return F.when(strip(path) == "", path).when(short, whole).otherwise(F.concat(F.lit(".../"), tail))


def session_id(goal: Column, day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("-"), F.left(F.regexp_replace(F.lower(goal), "[^a-z0-9]+", "-"), F.lit(30)))


def to_time(value: Column, fallback: Column) -> Column:
    """The time that an ISO text says; the fallback (now for what is stored, the epoch for metrics) if it says none."""
    return F.coalesce(F.try_to_timestamp(value), fallback)


def merge_unique(*lists: Column) -> Column:
    """Ordered union of the strings that aren't blank."""
    out = lists[0]
    for x in lists[1:]:
        out = F.array_union(out, x)
    return F.array_distinct(F.filter(out, lambda x: x.isNotNull() & (strip(x) != "")))


def added(before: Column, after: Column) -> Column:
    """What `after` has that `before` lacks, in order."""
    return F.array_except(merge_unique(after), merge_unique(before))


def one_of(value: Column, valid: list[str], default: str) -> Column:
    return F.when(value.isin(valid), value).otherwise(F.lit(default))


def meaningful(value: Column) -> Column:
    return F.coalesce(strip(value) != "", F.lit(False))


def without_empty(fields: Column) -> Column:
    """A map of JSON texts without those that say null, "" or []."""
    return F.map_filter(fields, lambda k, v: v.isNotNull() & ~v.isin("null", '""', "[]", ""))


def next_step(message: Column) -> Column:
    """What follows 'next step:' (or its Spanish) up to the end of the sentence, 150 characters at most."""
    found = F.regexp_extract(collapse(message), r"(?i)(?:next step|siguiente paso)\s*[:\-]\s*([^.;\n]{12,180})", 1)
    return shorten(collapse(found), 150)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
