"""Text made to fit: a cascade of ever shorter forms, and the output of commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .outline import OUTLINE, SIGNATURES, marked

# fixed values: what tells why a command failed
TELLING = ["error", "warning", "failed", "exception", "maximum update depth", "entity not found"]


def cascade(text: Column, budget: int) -> Column:
    """The longest of the whole text, its outline and its signatures that fits the budget of tokens, else the last one cut at a line."""
    cut = lambda t: T.prefix_by_tokens(t, budget, f"[truncated to fit {budget} token budget]")
    fits = lambda t: T.fits_tokens(t, budget)
    # forms are worked out once, and only if the longer ones don't fit
    signatures = lambda kept: T.let(T.truncate(kept, SIGNATURES), lambda t: F.when(fits(t), t).otherwise(cut(t)))
    outline = lambda kept: T.let(T.truncate(kept, OUTLINE), lambda t: F.when(fits(t), t).otherwise(signatures(kept)))
    return F.when(fits(text), text).otherwise(T.let(marked(text), outline))


def shell_output(text: Column, failed: Column, most: int = 5000) -> Column:
    """Of a failed command the lines that tell why; lines alike once; capped."""
    relevant = T.relevant_lines(text, TELLING)
    return T.truncate(T.unique_lines(F.when(failed & (relevant != ""), relevant).otherwise(text)), most)
