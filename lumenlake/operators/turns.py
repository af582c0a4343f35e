"""Turns of a conversation with a tool: what a prompt and an answer say, what a turn should leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: tools that write, least lengths, points towards a reminder, and limits of texts
WRITE_TOOLS = ["Write", "Edit", "MultiEdit"]
LEAST_PROMPT, LEAST_TERMS, LONG_ANSWER, BLOCK_FROM = 20, 4, 140, 3
FOCUS, CONTEXT_LINES, CONTEXT_CHARS = 140, 5, 420


def prompt_terms(prompt: Column) -> Column:
    """All terms of three letters or more, repeats and stop words too."""
    return F.filter(F.split(T.collapse(prompt), "(?i)[^a-z0-9_.-]+"), lambda t: F.length(t) >= 3)


def meaningful_prompt(prompt: Column, distinct: bool = False) -> Column:
    """Long enough and with four terms at least; distinct: of those that aren't stop words, each once."""
    text = F.coalesce(prompt, F.lit(""))
    terms = T.terms(text) if distinct else prompt_terms(text)
    return (F.length(T.collapse(text)) >= LEAST_PROMPT) & (F.size(terms) >= LEAST_TERMS)


def checkpoint_use(tool: Column, phase: Column, action: Column, event: Column) -> Column:
    """The event of a tool call that saves state, null of any other."""
    named = lambda name: F.coalesce(tool, F.lit("")).rlike(rf"(?i)^mcp__.+__{name}$")
    told = F.coalesce(event, F.lit("manual"))
    return F.when(named("smart_turn"), F.when(phase == "end", told)).when(named("smart_summary"), F.when(action == "checkpoint", told).when(action.isin("append", "auto_append", "update"), action))


def touched(tool: Column, *paths: Column) -> Column:
    """The files that a writing tool names, each once."""
    return F.when(tool.isin(WRITE_TOOLS), T.merge_unique(F.array(*paths))).otherwise(F.array().cast("array<string>"))


def stop_points(writes: Column, files: Column, answer: Column, state: Column) -> Column:
    """Points that say a turn should have saved its state: it wrote, touched files, named a next step, said much, or shifted."""
    one = lambda condition, n: F.when(F.coalesce(condition, F.lit(False)), n).otherwise(0)
    return one(writes > 0, 3) + one(F.size(files) > 0, 1) + one(T.next_step(answer) != "", 2) + one(F.length(T.collapse(answer)) >= LONG_ANSWER, 1) + one(state.isin("task_switch", "possible_shift"), 1)


def must_stop(points: Column) -> Column:
    return points >= BLOCK_FROM


def carryover(prompt: Column, files: Column, answer: Column) -> Column:
    """What an unsaved turn leaves for the next: its focus, a pinned line, its files and next step; null where there is none."""
    focus = T.shorten(T.collapse(F.coalesce(prompt, F.lit(""))), FOCUS)
    some = lambda c: F.when(c != "", c)
    return F.struct(
        some(focus).alias("current_focus"), F.when(focus != "", F.array(F.concat(F.lit("Uncheckpointed turn: "), focus))).alias("pinned_context"),
        F.when(F.size(files) > 0, files).alias("touched_files"), some(T.next_step(F.coalesce(answer, F.lit("")))).alias("next_step"),
    )


def context_lines(*lines: Column) -> Column:
    """Up to five lines that say something, together 420 characters at most."""
    kept = F.slice(F.filter(F.array(*lines), T.meaningful), 1, CONTEXT_LINES)
    return T.strip(F.left(F.array_join(kept, "\n"), F.lit(CONTEXT_CHARS)))


def reuse(state: Column) -> Column:
    """Whether a turn goes on in its session rather than in one of its own."""
    return state.isin("aligned", "resume")


def overhead(injected: DataFrame, text: str = "text") -> DataFrame:
    """Metric entries of texts that were put before prompts: what they cost, nothing saved."""
    n = T.token_count(F.col(text))
    bare = F.lit(0).cast("long")
    return injected.withColumns({"tool": F.lit("hook"), "raw_tokens": bare, "compressed_tokens": bare, "saved_tokens": bare, "overhead_tokens": n.cast("long")}).where(F.col("overhead_tokens") > 0)
