"""From raw documents to token files: quality, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Filters judge rows, not ids: where doc_ids are null or
repeat, rows are numbered first, so a row goes or stays by its own text. Of a group of near duplicates the row of least doc_id stays
(a null one comes last, equal ones go by their number); rows without words are like no other and stay. Without a model (no positive training
label) the quality stage keeps all rows. Very long texts are texts like others; null texts are empty ones, which the classifier
judges. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm.common import materialise, table
from lumenlake.llm.decontamination import decontaminate
from lumenlake.llm.jaccard import similar
from lumenlake.llm.mixing import mix
from lumenlake.llm.quality import quality
from lumenlake.llm.token_ids import token_ids


def _told_apart(docs: DataFrame) -> bool:
    """Whether each row has a doc_id of its own."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()


def _kept(docs: DataFrame, gone: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Rows of docs without those that gone(docs, key) lists in a column `gone`: by doc_id, or by a number where that doesn't tell rows apart."""
    names, key = docs.columns, "doc_id"
    if not _told_apart(docs):
        key = "row_of_stage"
        while key in names:
            key += "_"
        docs = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    out = materialise(gone(docs, key), "gone")
    return docs.join(out, F.col(key) == F.col("gone"), "left_anti").select(*(F.col(f"`{c}`") for c in names))


def _as_id(docs: DataFrame, key: str) -> DataFrame:
    """The texts under the column that tells rows apart."""
    return docs.select(F.col(key).alias("doc_id"), "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""

    def gone(docs: DataFrame, key: str) -> DataFrame:
        judged = quality(docs, table(spark, sf_dir, "labels"), key if key != "doc_id" else None)
        return judged.where("fitted and predicted = 0").select(F.col("doc_id" if key == "doc_id" else "rid").alias("gone"))

    return _kept(docs, gone)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""

    def gone(docs: DataFrame, key: str) -> DataFrame:
        found = similar(_as_id(docs, key))
        if key == "doc_id":
            return found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
        found = materialise(found.select(F.col("doc_id").alias("__row"), "component_id"), "components")
        named = found.join(docs.select(F.col(key).alias("__row"), F.col("doc_id").alias("__id")), "__row")
        first = named.groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__row"))["__row"].alias("stays"))
        return found.join(first, "component_id").where("__row <> stays").select(F.col("__row").alias("gone"))

    return _kept(docs, gone)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, its numbers or names changed or not, go."""
    return _kept(docs, lambda docs, key: decontaminate(_as_id(docs, key), table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("gone")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, laid out in the order of the schedule: the part files in turn hold the slots in turn."""
    placed = mix(docs, carry=F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    return placed.repartitionByRange("slot", "h").sortWithinPartitions("slot", "h").select("carried.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the layout, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_ids(docs, as_laid_out=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID output", token_stage),
]
#: A trained classifier and a tokenizer cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
