"""Values at given ranks, exactly, with no group sorted or gathered in one task.

A pass counts the values of each group by range; the range that holds the rank is cut into ranges of its own by the next, with the least and greatest
value that it holds as its ends, until these are one. Ranges are counts before they are shuffled, so a group of any size is BINS
rows for each task; each pass cuts what is left by about that number, and takes one distinct value away at least."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

BINS = 1024


def nearest(p: float, n: Column) -> Column:
    """The nearest rank of a share of n rows, from 1."""
    return F.greatest(F.ceil(F.lit(Decimal(str(p))) * n).cast("long"), F.lit(1).cast("long"))


def _range(v: Column, lo: Column, hi: Column) -> Column:
    """0 for the least value, BINS - 1 for the greatest, the ranges between for those between; ends that aren't finite have one range between."""
    width = hi / 2 - lo / 2
    fine = ~F.isnan(width) & (F.abs(width) != float("inf")) & (width > 0)
    inner = F.when(fine, F.floor((v / 2 - lo / 2) / F.when(fine, width) * (BINS - 2)).cast("int") + 1).otherwise(1)
    return F.when(v.eqNullSafe(lo), 0).when(v.eqNullSafe(hi), BINS - 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(BINS - 2), inner)))


def at_ranks(rows: DataFrame, value: str, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """(by..., one column for each of ranks): the value at a rank, from the least, in each group; ranks are columns over `n`, the rows of a group.

    Nulls of the value don't count, NaN is the greatest; a rank over n gives the greatest value. Numbers are compared as doubles, so
    whole ones must be under 2 ** 53."""
    spark = rows.sparkSession
    v = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    whole = v.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    aims = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.least(r, F.col("n")).alias("r")) for k, r in ranks.items())))
    state = whole.withColumn("__aim", aims).select(*by, F.col("__aim.k").alias("__k"), F.col("__aim.r").alias("__r"), "__lo", "__hi")
    root = scratch.folder(spark, "ranks")
    turn = 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal turn
        turn += 1
        df.write.parquet(f"{root}/{turn}")
        return spark.read.schema(df.schema).parquet(f"{root}/{turn}")

    state = kept(state)
    split = ~F.col("__lo").eqNullSafe(F.col("__hi"))
    while state.where(split).limit(1).count():
        open_ = state.where(split).withColumnsRenamed({b: f"__by_{b}" for b in by})
        on = F.lit(True)
        for b in by:
            on = on & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
        met = v.join(open_, on & (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))
        bins = met.groupBy(*by, "__k", "__r", _range(F.col("__v"), F.col("__lo"), F.col("__hi")).alias("__bin")).agg(F.count("*").alias("__c"), F.min("__v").alias("__a"), F.max("__v").alias("__z"))
        w = Window.partitionBy(*by, "__k").orderBy("__bin")  # BINS rows at most
        upto = bins.withColumn("__upto", F.sum("__c").over(w))
        hit = upto.where((F.col("__upto") >= F.col("__r")) & (F.col("__upto") - F.col("__c") < F.col("__r")))
        closer = hit.select(*by, "__k", (F.col("__r") - F.col("__upto") + F.col("__c")).alias("__r"), F.col("__a").alias("__lo"), F.col("__z").alias("__hi"))
        state = kept(state.where(~split).unionByName(closer))
    return state.groupBy(*by).agg(*(F.max(F.when(F.col("__k") == k, F.col("__lo"))).alias(k) for k in ranks))


def percentiles(rows: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by..., one column for each of shares): nearest-rank percentiles."""
    return at_ranks(rows, value, by, {k: nearest(p, F.col("n")) for k, p in shares.items()})


def greatest(rows: DataFrame, k: int, major: Column, minor: Column) -> DataFrame:
    """The k rows greatest by (major, minor), two whole numbers; rows that tie in both with the last all stay. Nothing is sorted."""
    marked = rows.withColumns({"__major": major.cast("long"), "__minor": minor.cast("long")})
    from_top = F.greatest(F.col("n") - (k - 1), F.lit(1).cast("long"))
    edge = at_ranks(marked, "__major", [], {"edge": from_top}).select(F.col("edge").cast("long").alias("__edge"))
    above = marked.crossJoin(F.broadcast(edge))  # one row
    n = above.agg(F.count_if(F.col("__major") > F.col("__edge")).alias("n")).first().n or 0
    at = above.where(F.col("__major") == F.col("__edge"))
    last = at_ranks(at, "__minor", [], {"last": F.greatest(F.col("n") - (k - n - 1), F.lit(1).cast("long"))}).select(F.col("last").cast("long").alias("__last"))
    both = above.join(F.broadcast(last), F.lit(True))
    return both.where((F.col("__major") > F.col("__edge")) | ((F.col("__major") == F.col("__edge")) & (F.col("__minor") >= F.col("__last")))).select(*rows.columns)
