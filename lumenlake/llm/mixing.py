"""Mixing sources to target weights by Pfair scheduling.

A source's texts, in an order by hash, are cut into blocks of BLOCK bytes. Block k of a source of weight w may start
at slot floor(k / w) and must be over by slot ceil((k + 1) / w); among the blocks that may start, the one with the
earliest deadline gets the slot (ties: the shorter window, then the source's name). As weights are made whole shares
of PERIOD slots, the schedule repeats after PERIOD slots; one period is worked out on the driver and any block's slot
follows from it by arithmetic. At every slot each source that still has blocks is less than one block off its weight.

Nothing is dropped: slots of a source that has run out stay empty, and in_mix tells whether a text lies before the
first such slot. Running totals of a source are taken in two steps, over hash buckets (more of them for more rows) and within
one, so that a source with a third of all rows is no single group. The driver holds a number for each source. Null texts are empty ones; null sources are one source, written as ''.
Ties of the hash are broken by doc_id; rows alike in all of it get neighbouring places. A text longer than a block lies in
the block it begins in. No rows give no rows. Other columns are left out, but for those that `carry` names.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, table, tuned

BLOCK, PERIOD, ALPHA = 1 << 16, 4096, 0.5
#: Rows that a hash bucket of a source is to hold about, and the least and most bits of a bucket's number.
BUCKET_ROWS, BITS = 256, (10, 24)


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots of a period for each source, by largest remainders, one at least; they add up to the period."""
    if not weights:
        return {}
    if len(weights) > period:
        period = 1 << (len(weights) - 1).bit_length()
    total = sum(weights.values())
    part = {s: max(0.0, w) / total * period if total > 0 else period / len(weights) for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in part.items()}
    order = sorted(part, key=lambda s: (out[s] - part[s], s))
    k = 0
    while (gap := period - sum(out.values())) != 0:
        s = order[k % len(order)] if gap > 0 else max(out, key=lambda s: (out[s] - part[s] if out[s] > 1 else -period, s))
        out[s] += 1 if gap > 0 else -1
        k += 1
    return out


def schedule(slots: dict[str, int]) -> dict[str, list[int]]:
    """The slot of each block of a period, by earliest deadline first among the blocks released."""
    import heapq

    period = sum(slots.values())
    window = lambda s, k: (k * period // slots[s], -(-(k + 1) * period // slots[s]))
    waiting = [(*window(s, 0), s, 0) for s in slots]
    heapq.heapify(waiting)
    ready: list = []
    out: dict[str, list[int]] = {s: [] for s in slots}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            r, d, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (d, d - r, s, k))
        d, _, s, k = heapq.heappop(ready)
        if d <= t:
            raise AssertionError("a deadline was missed")
        out[s].append(t)
        if k + 1 < slots[s]:
            heapq.heappush(waiting, (*window(s, k + 1), s, k + 1))
    return out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, carry: Column | None = None) -> DataFrame:
    """source, block, slot and in_mix of each row, with doc_id or what `carry` says; built-in functions alone.

    weights: target weight of each source; by default the bytes of a source to the power ALPHA, which flattens the
    natural mix."""
    spark = tuned(docs.sparkSession)
    bits = min(BITS[1], max(BITS[0], (docs.count() // BUCKET_ROWS).bit_length()))
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 1
    rows = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"), *([carry.alias("carried")] if carry is not None else []),
    ).withColumn("bucket", F.shiftright("h", 64 - bits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bytes"))
    found = {r.source: r.b for r in sums.groupBy("source").agg(F.sum("bytes").alias("b")).collect()}
    given = {s: (found[s] ** ALPHA if weights is None else weights.get(s, 0.0)) for s in sorted(found)}
    slots = shares(given)
    period = sum(slots.values())
    plan = schedule(slots)
    blocks = {s: -(-found[s] // block) for s in found}
    #: slot of the first block that a source lacks
    end = min((plan[s][blocks[s] % slots[s]] + blocks[s] // slots[s] * period for s in found), default=0)
    listed = [(s, k, t, slots[s]) for s in plan for k, t in enumerate(plan[s])]
    table_ = held(spark, **{c: pa.array([r[i] for r in listed], kind) for i, (c, kind) in enumerate((("source", pa.string()), ("k", pa.int64()), ("at", pa.int64()), ("of", pa.int64())))})
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("bytes").over(w), F.lit(0))).select("source", "bucket", "before", F.lit(0).alias("of0")).drop("of0")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, ["source", "bucket"])
    placed = placed.withColumn("block", F.floor((F.col("before") + F.col("inside")) / block).cast("long"))
    #: one row of four numbers for each slot of a period: a size that is fixed, or the number of sources
    of = held(spark, source=pa.array(list(slots), pa.string()), of=pa.array(list(slots.values()), pa.int64()))
    placed = placed.join(F.broadcast(of), "source").withColumn("k", F.pmod("block", "of")).drop("of").join(F.broadcast(table_), ["source", "k"])
    placed = placed.withColumn("slot", F.floor(F.col("block") / F.col("of")).cast("long") * period + F.col("at")).withColumn("in_mix", F.col("slot") < end)
    return placed.select(*(["carried"] if carry is not None else []), "doc_id", "source", "block", "slot", "in_mix", "h")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("h")


NAME, ORACLE = "op8_mixing", None
