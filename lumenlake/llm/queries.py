"""The registered queries of this folder, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, decontamination, divergence, hnsw, jaccard, katz, mixing, pii, prefix_pieces, quality, suffix_dedup, token_ids, toxicity

_MODULES = (suffix_dedup, pii, hnsw, jaccard, quality, token_ids, katz, mixing, decontamination, toxicity, prefix_pieces, divergence, codes)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {m.NAME: m.query for m in _MODULES}
#: Where SQL can't say an operator, or not over whole tables in reasonable time, tests hold it against brute force.
ORACLES: dict[str, str] = {m.NAME: m.ORACLE for m in _MODULES if m.ORACLE}
