"""N-gram Jaccard self-join, exact, by the size-aware heavy-light method (after Deng, Tao and Li, 2018).

A document's set holds its distinct 5-word shingles. Sets that are alike in all shingles are one class. All sets are
ordered alike: shingles that many documents hold come last (a count sketch of a fixed size tells), the rest by hash.
With J >= 0.75 two sets share at least two shingles among the first n - ceil(0.75 n) + 2 of each. Small sets enumerate
the 2-subsets of that prefix; large ones put its single shingles into inverted lists, which small sets near the boundary
scan too, as a partner may lie beyond it, and pairs that meet in one list only go. The boundary is the size at which the
estimated cost of subset keys plus list entries is least.

Classes that share a key are first compared with one of them, the centre, only; classes that are linked by then need
no further comparison for the components, so a group of thousands of near copies costs a star, not all its pairs.
Keys that still hold classes of several components are joined in full, so no link between components is lost. At the
first shingle that two sets share, what either has left bounds their overlap; pairs below the least overlap go.
Verification counts shared shingles exactly.

Words, shingles and sets go by 64-bit hashes; sets of one class are held against a second hash, and all is done again with
another salt should they be unlike. Null doc_ids link with nothing and are their own component (null). Rows of a repeated
doc_id are judged one by one; equal ones are copies, and of documents in a tie the smallest doc_id names the component.
Texts without words have an empty set; very long ones are shingled whole. Extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, drop_scratch, lean, materialise, release, table, texts, tuned

SKETCH_BITS, BLOCKS = 20, 16
#: Cost of an entry of an inverted list, its verification included, against that of a subset key.
LIST_COST = 4.0
#: Classes that a task remembers to have handed on; beyond them copies are handed on again, which costs room and no more.
KNOWN = 500_000
#: What two sets have left at the first or second shingle they share must reach the least overlap of their sizes, 3 / 7 of both, less one.
NEAR = "7 * (least(rest, rest2) + 1) >= 3 * (n + n2)"
_C1, _C2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _least(n: int) -> int:
    """Shingles that a set of n shares at least with any partner: ceil(0.75 n)."""
    return -(-3 * n // 4)


def _class(u: np.ndarray, salt: int = 0) -> int:
    """A 64-bit hash of a sorted set, as a signed number; 0 for the empty one."""
    return (xxhash.xxh3_64_intdigest(u.tobytes(), seed=salt) ^ 1 << 63) - (1 << 63) if len(u) else 0


def profile(docs: DataFrame, salt: int) -> DataFrame:
    """kind 0: doc_id, n, cls of each row and a second hash of its set; kind 1: a block of the sketch's counts (doc_id: the block's number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "cls", "check", "counts"]
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column(1)):
                sets = K.shingle_sets(data, offsets, salt=salt)
                every = np.concatenate(sets)
                counts += np.bincount((every & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=len(counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, np.int8)), batch.column(0).slice(a, b - a), pa.array([len(u) for u in sets], pa.int64()), pa.array([_class(u, salt) for u in sets], pa.int64()), pa.array([_class(u, ~salt & 0xFFFF) for u in sets], pa.int64()), pa.nulls(b - a, pa.binary())], names)
        if counts.any():
            parts = [x.tobytes() for x in counts.reshape(BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array([1] * BLOCKS, pa.int8()), pa.array(range(BLOCKS), pa.int64()), *(pa.array([0] * BLOCKS, pa.int64()) for _ in range(3)), pa.array(parts, pa.binary())], names)

    return docs.mapInArrow(lean(run), "kind byte, doc_id long, n long, cls long, check long, counts binary")


def levels(prof: DataFrame) -> np.ndarray:
    """How far each bucket of the sketch is above the usual load, in doublings: 2 ** SKETCH_BITS bytes at any size."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for j, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(x, np.int64 if len(x) > (4 << SKETCH_BITS) // BLOCKS else np.int32).astype(np.int64)
                sums[j] = sums[j] + c if j in sums else c
        for j, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int64()), pa.array([c.tobytes()], pa.binary())], ["j", "c"])

    spark = prof.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    parts = prof.where("kind = 1").select(F.col("doc_id").alias("j"), F.col("counts").alias("c")).mapInArrow(lean(total), "j long, c binary")
    rows = {r.j: r.c for r in parts.repartition(BLOCKS, "j").mapInArrow(lean(total), "j long, c binary").collect()}
    tuned(spark)
    if not rows:
        return np.zeros(1 << SKETCH_BITS, np.uint8)
    c = np.concatenate([np.frombuffer(rows[j], np.int64) for j in range(BLOCKS)])
    usual = max(4.0, 4 * float(np.median(c)))
    return np.ceil(np.maximum(0, np.log2(np.maximum(c, 1) / usual))).astype(np.uint8)


def boundary(prof: DataFrame) -> int:
    """Sets under this size enumerate subsets. Costs come from the counts of sets by size, sizes over 256 in one."""
    sizes = {r.n: r["count"] for r in prof.where("kind = 0").groupBy(F.least("n", F.lit(257)).alias("n")).count().collect()}

    def cost(x: int) -> float:
        out = 0.0
        for n, k in sizes.items():
            if 3 <= n < x:
                p = n - _least(n) + 2
                out += k * p * (p - 1) / 2
            if n >= 0.75 * x:
                out += k * (n - _least(n) + 2) * LIST_COST
        return out

    return min(range(3, 129), key=cost)


def keys(docs: DataFrame, level: np.ndarray, x: int, salt: int) -> DataFrame:
    """(key, shares, cls, n, rest): subset keys of small sets (two shingles shared), single ones of the others; a class once a task.

    rest: shingles from the key's first one on, in the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        done: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column(0)):
                out, shares, cls, size, rest = [], [], [], [], []
                for u in K.shingle_sets(data, offsets, salt=salt):
                    n = len(u)
                    if not n or (c := _class(u, salt)) in done:
                        continue
                    if len(done) < KNOWN:
                        done.add(c)
                    lv = shared.value[(u & mask).astype(np.int64)]
                    if lv.any():
                        u = u[np.argsort(lv, kind="stable")]
                    got, at, two = [], [], []
                    p = u[: n - _least(n) + 2]
                    if n >= 0.75 * x:
                        got.append(K.mix(p + _C1))
                        at.append(np.arange(len(p)))
                        two.append(np.full(len(p), 1, np.int8))
                    if 3 <= n < x:
                        i, j = np.triu_indices(len(p), 1)
                        got.append(K.mix(p[i] * _C1 + p[j] * _C2))
                        at.append(i)
                        two.append(np.full(len(i), 2, np.int8))
                    if got:
                        k = np.concatenate(got)
                        out.append(k)
                        shares.append(np.concatenate(two))
                        cls.append(np.full(len(k), c))
                        size.append(np.full(len(k), n, np.int32))
                        rest.append((n - np.concatenate(at)).astype(np.int32))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), *(pa.array(np.concatenate(c)) for c in (shares, cls, size, rest))], ["key", "shares", "cls", "n", "rest"])

    return docs.select("text").mapInArrow(lean(run), "key long, shares byte, cls long, n int, rest int")


def _bits(need: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the classes in need(cls), of 2 ** bits bits whatever their number; it may let others through."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << bits, bool)
        for b in batches:
            out[(b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()], pa.binary())], ["m"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in need.select("cls").coalesce(4).mapInArrow(lean(mark), "m binary").collect():
        out |= np.frombuffer(r.m, np.uint8)
    return np.unpackbits(out).astype(bool)


def _parity(u: np.ndarray) -> bytes:
    """Whether an odd number of shingles has each value of their low bits; two to four bits a shingle, a power of two."""
    size = max(64, 2 << (len(u) - 1).bit_length())
    return np.packbits((np.bincount((u & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def sets_of(docs: DataFrame, need: DataFrame, cut: bool, salt: int) -> DataFrame:
    """(cls, shingles) of the classes in need(cls): sorted hashes, or if cut a bitmap of the parity of their low bits.

    The texts are read again where they lie; a bitmap of a bounded size (16 MB) tells nearly all that aren't asked for,
    and a semi-join the rest."""
    bits = min(27, max(18, need.count().bit_length() + 4))
    shared = docs.sparkSession.sparkContext.broadcast(_bits(need, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column(0)):
                rows = []
                for u in K.shingle_sets(data, offsets, salt=salt):
                    if len(u) and (c := _class(u, salt)) not in done and shared.value[(c % (1 << 64)) >> (64 - bits)]:
                        if len(done) < KNOWN:
                            done.add(c)
                        rows.append((c, _parity(u) if cut else u.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["cls", "shingles"])

    found = docs.select("text").mapInArrow(lean(run), "cls long, shingles binary")
    return found.join(need, "cls", "left_semi").dropDuplicates(["cls"])


def verify(pairs: DataFrame, sets: DataFrame, cut: bool) -> DataFrame:
    """The pairs(a, b, n, m) of classes that are similar; by bitmaps, those that may be.

    Two bitmaps differ in no more places than the sets have shingles apart, which are (n + m) / 7 of a similar pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                if cut:
                    u, v = sorted((np.frombuffer(z, np.uint8) for z in (x, y)), key=len)
                    while len(v) > len(u):
                        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
                    keep.append(7 * int(np.bitwise_count(u ^ v).sum()) <= n + m)
                else:
                    both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * shared >= 75 * (n + m - shared))
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in range(4)], ["a", "b", "n", "m"])

    joined = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    return joined.select("a", "b", "n", "m", "x", "y").mapInArrow(lean(run), "a long, b long, n int, m int")


def compare(docs: DataFrame, pairs: DataFrame, small: DataFrame, salt: int) -> DataFrame:
    """The similar ones of pairs(a, b, n, m): bitmaps leave few to hold against each other in full."""
    maybe = materialise(verify(pairs, small, True), "maybe")
    need = maybe.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = materialise(sets_of(docs, need, False, salt), "sets")
    out = materialise(verify(maybe, sets, False).select("a", "b"), "links")
    drop_scratch(sets)
    drop_scratch(maybe)
    return out


def stars(docs: DataFrame, level: np.ndarray, x: int, salt: int) -> DataFrame:
    """Entries (key, shares, cls, n, rest) of the keys that several classes hold, with the key's centre (cls2, n2, rest2).

    The centre is a class that holds the key early in its order."""
    w = Window.partitionBy("key")
    centre = F.min(F.struct((-F.floor(8 * F.col("rest") / F.col("n"))).alias("early"), "cls", "n", "rest")).over(w)
    entries = keys(docs, level, x, salt).withColumn("lo", F.min("cls").over(w)).withColumn("hi", F.max("cls").over(w)).where("lo <> hi").withColumn("c", centre)
    return entries.select("key", "shares", "cls", "n", "rest", F.col("c.cls").alias("cls2"), F.col("c.n").alias("n2"), F.col("c.rest").alias("rest2"))


def _ordered(pairs: DataFrame, least: int) -> DataFrame:
    """(a, b, n, m) of pairs that share `least` shingles by the keys at which they meet."""
    first = F.col("cls") < F.col("cls2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    met = pairs.groupBy(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b"), pick("n", "n2").alias("n"), pick("n2", "n").alias("m")).agg(F.sum("shares").alias("shared"))
    return met.where(F.col("shared") >= least).drop("shared")


def rest_pairs(live: DataFrame, comp: DataFrame, star: DataFrame) -> DataFrame:
    """All pairs that share keys across components and have not been compared."""
    w = Window.partitionBy("key")
    left = live.select("key", "shares", "cls", "n", "rest").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    left = left.withColumn("lo", F.min("component").over(w)).withColumn("hi", F.max("component").over(w)).where("lo <> hi").select("key", "shares", "cls", "n", "rest", "component")
    mate = left.select("key", F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("rest").alias("rest2"), F.col("component").alias("component2"))
    return _ordered(left.join(mate, "key").where(f"cls < cls2 and component <> component2 and {NEAR}"), 2).join(star, ["a", "b"], "left_anti")


def similar(docs: DataFrame, salt: int = 0) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; salt: of all hashes, another one if sets of one class prove unlike."""
    spark = tuned(docs.sparkSession)
    docs = texts(docs)
    prof = materialise(profile(docs, salt), "profile")
    rows = prof.where("kind = 0").select("doc_id", "n", "cls", "check")
    if rows.groupBy("cls").agg(F.min("check").alias("a"), F.max("check").alias("b"), F.min("n").alias("c"), F.max("n").alias("d")).where("a <> b or c <> d").limit(1).count():
        return similar(docs, salt + 1)
    x = boundary(prof)
    level = levels(prof)
    named = docs.where("doc_id is not null")
    live = materialise(stars(named, level, x, salt), "live")
    release(spark)
    small = materialise(sets_of(named, live.select("cls").distinct(), True, salt), "small")
    star = materialise(_ordered(live.where(f"cls <> cls2 and {NEAR}"), 1), "pairs")
    edges = compare(named, star, small, salt)
    comp = materialise(components(edges), "comp")
    release(spark)
    more = materialise(rest_pairs(live, comp, star), "pairs")
    again = compare(named, more, small, salt)
    for t in (live, small, star, more):
        drop_scratch(t)
    release(spark)
    if again.limit(1).count():
        comp = materialise(components(edges.union(again)), "comp")
    joined = rows.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    joined = joined.where("n > 0 and doc_id is not null")
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = joined.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


NAME = "op4_jaccard"
#: Sets, intersections and reachability spelt out; groups of some hundred documents are no trouble for it.
ORACLE = r"""
with recursive d as materialized (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as materialized (select distinct rid, array_to_string(w[i : i + 4], ' ') sh from (select rid, w, unnest(range(1, greatest(len(w) - 3, 2))) i from d where len(w) > 0)),
n as materialized (select rid, count(*) n from s group by rid),
p as materialized (select a.rid a, b.rid b, count(*) i from s a join s b on a.sh = b.sh and a.rid < b.rid group by a.rid, b.rid),
l as materialized (select a, b from p join n x on a = x.rid join n y on b = y.rid where 100 * i >= 75 * (x.n + y.n - i)),
e as materialized (select a, b from l union all select b, a from l),
r as (select rid a, rid b from d union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0) n_shingles, min(o.doc_id) component_id from d join r on r.a = d.rid join d o on o.rid = r.b left join n on n.rid = d.rid group by d.rid, d.doc_id, n.n
"""
