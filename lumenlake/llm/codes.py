"""Vectors as codes of their parts: product quantisation in whole numbers.

A component x becomes floor(SCALE * x); a vector is cut into PARTS equal parts, each coded by the nearest of ENTRIES entries of a
codebook for its position. Parts that are equal at a position are one row with a weight, so the rounds of Lloyd's
algorithm run over distinct rows: a task assigns them to the entries (a few numbers, sent to it) and hands back weighted sums. Codes and
errors are then joined back to the vectors. Rows of the join that a thousandth of the vectors or more would meet at are
broadcast, of which there are a thousand a position at most; all other keys are small, and shuffled.

Vectors that are null or hold null or non-finite components are left out. Codebooks start as the parts of the vectors of smallest
vec_id (a null vec_id comes last, equal ones go by their components); with fewer than ENTRIES vectors they are shorter. Ties of the
distance go to the lower entry; an entry without parts stays. Equal vec_ids are vectors of their own. Null labels are one label. Vectors
must have one length, a multiple of PARTS, and components under 2 ** 27 after scaling, or the operator raises ValueError: then
squared distances of parts of up to 64 components fit in 64 bits. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import drop_scratch, lean, materialise, table, tuned

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: A key that one vector in SHARE or more has is joined by broadcast; of these there are SHARE at most for each position.
SHARE, LIMIT = 1000, 1 << 27


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id, label, v (64-bit components) of each vector that is whole; built-in functions alone."""
    given = F.col("embedding")
    bad = F.exists(given, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(given, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    kept = vectors.where(given.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), scaled.alias("v"))


def parts_of(whole: DataFrame, parts: int) -> DataFrame:
    """row, vec_id, label, pos, part (64-bit numbers as bytes): `parts` rows for each vector."""
    label = dict(whole.dtypes)["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(3).flatten().to_numpy().reshape(b.num_rows * parts, -1)
            width = v.shape[1] * 8
            data = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer((np.arange(len(v) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v))])
            each = pa.array(np.repeat(np.arange(b.num_rows), parts))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(each) for i in range(3)), pa.array(np.tile(np.arange(parts, dtype=np.int8), b.num_rows)), data], ["row", "vec_id", "label", "pos", "part"])

    return whole.mapInArrow(lean(run), f"row long, vec_id long, label {label}, pos byte, part binary")


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of x; the lower entry at ties."""
    best, error = np.zeros(len(x), np.int64), ((x - book[0]) ** 2).sum(1)
    for k in range(1, len(book)):
        d = ((x - book[k]) ** 2).sum(1)
        new = d < error
        best[new], error[new] = k, d[new]
    return best, error


def _by_position(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows of the batch that have it, their parts) for each position of a batch (pos, part, ...)."""
    pos = batch.column(0).to_numpy()
    data, offsets = K.buffers(batch.column(1))
    every = data[offsets[0] : offsets[-1]].view(np.int64).reshape(len(pos), -1)
    for p in range(parts):
        at = np.flatnonzero(pos == p)
        if len(at):
            yield p, at, every[at]


def _round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries after one round over distinct(pos, part, weight)."""
    parts, entries, width = books.shape
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            weight = b.column(2).to_numpy()
            for p, at, x in _by_position(b, parts):
                k = p * entries + _nearest(x, shared.value[p])[0]
                np.add.at(sums, k, x * weight[at, None])
                np.add.at(seen, k, weight[at])
        used = np.flatnonzero(seen)
        if len(used):
            cell = (used[:, None] * width + np.arange(width)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums[used].ravel()), pa.array(np.repeat(seen[used], width))], ["cell", "total", "seen"])

    got = distinct.mapInArrow(lean(run), "cell long, total long, seen long").groupBy("cell").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"))
    out = books.copy().reshape(-1)
    for r in got.collect():  # a row for each component of each entry
        out[r.cell] = r.total // r.seen
    shared.unpersist()
    return out.reshape(books.shape)


def _coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """pos, part, weight, code, error of distinct(pos, part, weight)."""
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for p, at, x in _by_position(b, len(books)):
                code[at], error[at] = _nearest(x, shared.value[p])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code), pa.array(error)], ["pos", "part", "weight", "code", "error"])

    return distinct.mapInArrow(lean(run), "pos byte, part binary, weight long, code long, error long")


def _joined_back(rows: DataFrame, keyed: DataFrame, keys: list[str], most: int) -> DataFrame:
    """rows with the other columns of keyed(keys, weight, ...), which has one row for each key; keys of a weight of `most` or more are broadcast.

    Nulls of a key meet each other. There are sum(weight) / most such keys at most."""
    named = keyed.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in keyed.columns if c not in keys))
    on = None
    for k in keys:
        on = F.col(k).eqNullSafe(F.col(f"__{k}")) if on is None else on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    gone = [f"__{k}" for k in keys] + ["weight"]
    hot = F.broadcast(named.where(F.col("weight") >= most))
    often = rows.join(hot, on).drop(*gone)
    seldom = rows.join(hot.select(*(f"__{k}" for k in keys)), on, "left_anti").join(named.where(F.col("weight") < most), on).drop(*gone)
    return often.unionByName(seldom)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes (array of one number a part), error, label_error; the codebooks by part, entry and place)."""
    spark = tuned(vectors.sparkSession)
    whole = materialise(whole_numbers(vectors, scale), "whole")
    shape = whole.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    if shape.n and (shape.a != shape.b or shape.a % parts or not shape.a or shape.most >= LIMIT or shape.a // parts > 64):
        raise ValueError(f"vectors need one length that {parts} divides, and components under {LIMIT}: lengths {shape.a} to {shape.b}, up to {shape.most}")
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy() if first else np.zeros((parts, 0, 0), np.int64)
    long = parts_of(whole, parts)
    distinct = materialise(long.groupBy("pos", "part").agg(F.count("*").alias("weight")), "distinct")
    if first:
        for _ in range(rounds):
            books = _round(distinct, books)
    coded = materialise(_coded(distinct, books), "coded") if first else spark.createDataFrame([], "pos byte, part binary, weight long, code long, error long")
    drop_scratch(distinct)
    most = max(1, shape.n // SHARE)
    met = _joined_back(long, coded, ["pos", "part"], most)
    codes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"])
    done = materialise(met.groupBy("row").agg(F.any_value("vec_id").alias("vec_id"), F.any_value("label").alias("label"), codes.alias("codes"), F.sum("error").alias("error")), "done")
    by_label = done.groupBy("label").agg(F.count("*").alias("weight"), F.sum("error").alias("label_error"))
    out = _joined_back(done, materialise(by_label, "labels"), ["label"], most)
    return out.select("vec_id", "label", "codes", "error", "label_error"), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The contract in SQL: components as rows, a round as two tables."""
    floor = "((s - ((s % n) + n) % n) // n)"
    out = [
        "whole as materialized (select row_number() over (order by vec_id) r, vec_id, label, embedding e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        "size as (select max(len(e)) // 8 w from whole)",
        "long as materialized (select r, vec_id, label, (i - 1) // w pos, (i - 1) % w j, cast(floor(cast(e[i] as double) * 4096) as bigint) x from (select r, vec_id, label, e, unnest(range(1, len(e) + 1)) i from whole), size)",
        "b0 as materialized (select pos, r - 1 k, j, x from long where r <= 16)",
    ]
    for i in range(7):
        near = "arg_min({'k': k, 'd': d}, d * 16 + k)"
        out.append(f"a{i} as materialized (select r, pos, {near}.k k, {near}.d d from (select l.r, l.pos, b.k, cast(sum((l.x - b.x) * (l.x - b.x)) as bigint) d from long l join b{i} b on l.pos = b.pos and l.j = b.j group by l.r, l.pos, b.k) group by r, pos)")
        if i < 6:
            mean = f"(select l.pos, a.k, l.j, cast(sum(l.x) as bigint) s, count(*) n from long l join a{i} a on l.r = a.r and l.pos = a.pos group by l.pos, a.k, l.j)"
            out.append(f"b{i + 1} as materialized (select b.pos, b.k, b.j, case when m.n is null then b.x else {floor} end x from b{i} b left join {mean} m on b.pos = m.pos and b.k = m.k and b.j = m.j)")
    out.append("sha as (select sha256(string_agg(cast(x as varchar), ',' order by pos, k, j)) h from b6)")
    out.append("done as (select w.vec_id, w.label, string_agg(printf('%02x', a.k), '' order by a.pos) code, cast(sum(a.d) as bigint) error from whole w join a6 a on w.r = a.r group by w.r, w.vec_id, w.label)")
    return f"with {', '.join(out)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, h codebooks_sha256 from done, sha"


NAME, ORACLE = "op13_codes", _sql()
