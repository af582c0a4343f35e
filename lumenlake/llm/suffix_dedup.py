"""Removal of repeated byte strings with longest-previous-factor arrays over distributed suffix arrays.

A suffix array of the whole corpus is too large for a machine, so suffixes are first brought together by content:
every window of `length` bytes names the place of its least 64-byte hash (its anchor), alike windows name alike anchors,
and the windows that name one anchor form one range of starts. Ranges alike in all bytes are one class; ranges of
anchors that are seen once are done with. The classes of an anchor then meet in a shard, which builds the suffix array
of their window starts by prefix doubling, takes the LCP array from the doubled ranks, and finds for each start the
previous and next smaller position in suffix order (and larger ones): the larger LCP of the two is the longest previous
(next) factor. keep='first' removes what an earlier place holds; keep='none' removes every copy. With report < length,
windows of `report` bytes are brought together instead, and repeats of that many bytes are told beside those removed.

Bytes are judged on the input; matches never cross documents. An anchor with more than HOT classes is divided by the
bytes that any match of a part must share, so that one very common passage is no single group. Null texts are empty,
texts shorter than `length` keep all bytes; rows of a repeated doc_id are documents of their own (and copies, if
alike), ties between places are broken by doc_id and place, and all of a repeated passage counts, however many texts
hold it. A very long text is cut in overlapping parts. Extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import drop_scratch, lean, materialise, per_batch, release, table, texts, tuned

LENGTH, GRAM, HOT, PART = 400, 64, 2000, 48
#: Repeats of so many bytes are told in a column of the query; passages of over 50 words have about 300 bytes at least.
REPORT = 300
#: Bytes of window ranges that one suffix array takes (one anchor may have more): its arrays stay in a core's cache.
SHARD_BYTES = 128 << 10
SEGMENT = 1 << 23


# ---- arrays over one text -------------------------------------------------------------------------------------------


def smaller(sa: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """By rank, the least LCP down to the previous rank of a smaller position; 0 if there is none or it is under `least`.

    All ranks follow their chain of larger neighbours at once; a pointer that has been moved spares others the way."""
    n = len(sa)
    to = np.arange(n) - 1
    low = lcp.copy()
    while True:
        go = np.flatnonzero((to >= 0) & (low >= least))
        go = go[sa[to[go]] > sa[go]]
        if not len(go):
            return np.where((to >= 0) & (low >= least), low, 0)
        via = to[go]
        low[go], to[go] = np.minimum(low[go], low[via]), to[via]


def factors(sa: np.ndarray, lcp: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous factor, longest next factor) by rank; lcp[k] is that of ranks k - 1 and k, lcp[0] = 0."""
    up = np.concatenate([[0], lcp[1:][::-1]]).astype(lcp.dtype)
    both = lambda p: np.maximum(smaller(p, lcp, least), smaller(p[::-1], up, least)[::-1])
    return both(sa), both(-sa)


def _dense(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x)
    y = x[order]
    rank = np.empty(len(x), np.int64)
    step = np.zeros(len(x), np.int64)
    np.not_equal(y[1:], y[:-1], out=step[1:], casting="unsafe")
    rank[order] = np.cumsum(step)
    return rank


def doubled(data: np.ndarray, ends: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """(d, rank of the first d bytes of each suffix) for d = 8, 16 .. up to most; ends: where each suffix's text ends."""
    n = len(data)
    left = ends - np.arange(n)
    some = np.flatnonzero(left < 8)
    word = K.eights(data)[:n].byteswap()
    word[some] &= ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * left[some].astype(np.uint64)))
    rank = _dense(word)
    if len(some):  # texts end in a value below all bytes: of suffixes alike in 8 bytes, the one with fewer left is the lesser
        rank = _dense(rank * 9 + np.minimum(left, 8))
    out = [(8, rank)]
    d = 8
    while 2 * d <= most:
        next_ = np.where(left > d, np.concatenate([rank[d:], np.zeros(min(d, n), np.int64)])[:n] + 1, 0)
        rank = _dense(rank * (n + 1) + next_)
        d *= 2
        out.append((d, rank))
    return out


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, LCP array) of one text, with the LPF array by position."""
    n = len(data)
    ranks = doubled(data, np.full(n, n), max(8, 2 * n))
    sa = np.argsort(ranks[-1][1], kind="stable")
    lcp = np.zeros(n, np.int64)
    for k in range(1, n):
        a, b = int(sa[k - 1]), int(sa[k])
        while b + lcp[k] < n and a + lcp[k] < n and data[a + lcp[k]] == data[b + lcp[k]]:
            lcp[k] += 1
    lpf = np.zeros(n, np.int64)
    if n:
        lpf[sa] = factors(sa, lcp)[0]
    return sa, lcp, lpf


# ---- anchors ----------------------------------------------------------------------------------------------------------


def _segments(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, int | None]]:
    """(rows, bytes left out before each, bytes, offsets, how many starts count); a text longer than SEGMENT comes in overlapping parts."""
    for a, b, data, offsets in K.chunks(column):
        if b - a > 1 or len(data) <= SEGMENT:
            yield np.arange(a, b), np.zeros(b - a, np.int64), data, offsets, None
        else:
            step = SEGMENT - length + 1
            for x in range(0, len(data), step):
                part = data[x : x + SEGMENT]
                last = x + SEGMENT >= len(data)
                yield np.array([a]), np.array([x]), part, np.array([0, len(part)]), None if last else step
                if last:
                    break


def ranges(data: np.ndarray, offsets: np.ndarray, window: int, length: int, most: int | None = None) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, class hash, first start, last start, anchor, end) of each range of windows; places count from the row's start.

    A class is alike in all bytes of its windows and those up to `length` from its last start on (the end, or the text's)."""
    n = len(data) - GRAM + 1
    z = np.zeros(0, np.int64)
    if n <= 0 or len(data) < window:
        return (z,) * 7
    prefix = K.prefix_hash(data, K.BYTE_KEY)  # of anchors: that unlike bytes meet does no harm
    h = K.mix((prefix[GRAM:] - prefix[:n]) * K._powers(K._UNBASE, n))
    low = np.uint64(24)
    m = (h >> low) << low | np.arange(n, dtype=np.uint64)
    width, have = window - GRAM + 1, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    size = np.diff(offsets)
    ok = np.zeros(len(m) + 1, np.int32)
    long = np.flatnonzero(size >= window)
    ok[offsets[long]] += 1
    ok[offsets[long + 1] - window + 1] -= 1
    s = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    if most is not None:
        s = s[s < most]
    if not len(s):
        return (z,) * 7
    p = (m[s] & np.uint64((1 << 24) - 1)).astype(np.int64)
    row = np.searchsorted(offsets, s, "right") - 1
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (row[1:] != row[:-1])])
    head = np.flatnonzero(new)
    first, last, p, row = s[head], s[np.append(head[1:], len(s)) - 1], p[head], row[head]
    end = np.minimum(last + length, offsets[row + 1])
    raw = data.tobytes()
    cls = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(first.tolist(), end.tolist())), np.uint64, len(first))
    cls = K.mix(cls ^ K.mix(((p - first) << 32 | (last - first)).astype(np.uint64)))
    at = offsets[row]
    return row, h[p].view(np.int64), cls.view(np.int64), first - at, last - at, p - at, end - at


def anchored(docs: DataFrame, window: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, skip, data, offsets, most in _segments(b.column(2), length):
                r, h, c, *places = ranges(data, offsets, window, length, most)
                if len(r):
                    take = pa.array(rows[r])
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), b.column(0).take(take), b.column(1).take(take), *(pa.array(x + skip[r]) for x in places)], ["h", "cls", "doc_id", "rid", "x", "y", "p", "e"])

    return docs.mapInArrow(lean(run), "h long, cls long, doc_id long, rid long, x long, y long, p long, e long")


# ---- shards -----------------------------------------------------------------------------------------------------------


def judge(groups: np.ndarray, blobs: list[bytes], counts: np.ndarray, length: int, least: int) -> np.ndarray:
    """The longest previous and next factors of the first `counts` places of each byte range, on end, among ranges of the same
    group, earlier ranges of the list counting as earlier places. Factors are cut at length; of those under `least` 0 may be told."""
    data = np.frombuffer(b"".join(blobs), np.uint8)
    size = np.array([len(b) for b in blobs])
    first = np.cumsum(size) - size
    ranks = doubled(data, np.repeat(first + size, size), length)
    at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    left = np.repeat(first + size, counts) - at
    d, top = ranks[-1]
    group = np.repeat(groups, counts)
    far = np.where(left > length - d, top[np.minimum(at + length - d, len(top) - 1)] + 1, 0)
    whole_rank = _dense(_dense(group * (len(top) + 1) + top[at]) * (len(top) + 2) + far)
    order = np.argsort(whole_rank)
    sa, g, whole_rank, room = at[order], group[order], whole_rank[order], left[order]
    lcp = np.zeros(len(sa), np.int64)
    whole = whole_rank[1:] == whole_rank[:-1]
    lcp[1:][whole] = length
    part = np.flatnonzero((g[1:] == g[:-1]) & ~whole)
    l = np.zeros(len(part), np.int64)
    for d, r in reversed(ranks):
        a, b = sa[part] + l, sa[part + 1] + l
        l += d * ((l + d <= length) & (r[np.minimum(a, len(r) - 1)] == r[np.minimum(b, len(r) - 1)]))
    # fewer than eight bytes are left to compare: one by one
    live = np.flatnonzero(l < length)
    for _ in range(7):
        a, b = sa[part[live]] + l[live], sa[part[live] + 1] + l[live]
        live = live[(l[live] < np.minimum(room[part[live]], room[part[live] + 1])) & (l[live] < length) & (data[np.minimum(a, len(data) - 1)] == data[np.minimum(b, len(data) - 1)])]
        l[live] += 1
    lcp[part + 1] = l
    lcp[1:] = np.minimum(lcp[1:], np.minimum(room[1:], room[:-1]))
    previous, later = factors(sa, lcp, least)
    by_place = np.empty((2, len(sa)), np.int64)
    by_place[:, order] = previous, later
    return by_place


def _divide(raw: bytes, w: dict, window: int, length: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(shard key, bytes, first start, starts) of a range of windows. That of a hot anchor comes in parts: starts are divided
    by their distance from the anchor, the same for all that match, and a part is keyed by the bytes its windows share."""
    a = w["x"]
    if not w["hot"]:
        yield w["h"], raw[a : w["e"]], a, w["y"] - a + 1
        return
    while a <= w["y"]:
        far, over = divmod(w["p"] - a, PART)
        z = min(w["y"], a + over)
        # a part may be cut short at an end of the range; what all windows of the whole part share is the key
        core = raw[a + over : a + over - PART + 1 + window]
        yield int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=far.to_bytes(8, "little")).digest(), "little", signed=True), raw[a : min(z + length, w["e"])], a, z - a + 1
        a = z + 1


def shards(classes: DataFrame, docs: DataFrame, window: int, length: int, keep: str) -> DataFrame:
    """(doc_id, rid, start, end, whether it goes or is only told) of the classes in classes(h, n, hot, doc_id, rid, x, y, p, e)."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, rid, text, want in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = text.encode()
                for w in want:
                    for key, blob, x, starts in _divide(raw, w, window, length):
                        out.append((key, w["n"], doc, rid, x, starts, blob))
                    if len(out) > 2000:
                        yield _rows(out)
                        out = []
            if out:
                yield _rows(out)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(7))):
                if size >= SHARD_BYTES and held[-1][0] != row[0]:
                    yield _removed(held, window, length, keep)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield _removed(held, window, length, keep)

    want = classes.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("h", "n", "hot", "x", "y", "p", "e")).alias("want"))
    with_text = docs.dropDuplicates(["doc_id", "rid"]).withColumnsRenamed({"doc_id": "d", "rid": "r"}).join(want, (F.col("r") == want.rid) & F.col("d").eqNullSafe(want.doc_id)).select("doc_id", "rid", "text", "want")
    cut = with_text.mapInArrow(lean(fetch), "key long, n long, doc_id long, rid long, x long, starts long, blob binary")
    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut.repartition(n, "key").sortWithinPartitions("key", "doc_id", "x").mapInArrow(lean(decide), "doc_id long, rid long, a long, b long, goes boolean")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    k = list(zip(*out))
    return pa.RecordBatch.from_arrays([*(pa.array(k[i], pa.int64()) for i in range(6)), pa.array(k[6], pa.binary())], ["key", "n", "doc_id", "rid", "x", "starts", "blob"])


def _removed(held: list[tuple], window: int, length: int, keep: str) -> pa.RecordBatch:
    keys, n, docs, rids, x, counts = (np.array([r[i] if r[i] is not None else 0 for r in held]) for i in range(6))
    groups = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
    size = np.array([len(r[6]) for r in held])
    previous, later = judge(groups, [r[6] for r in held], counts, length, window)
    first = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(held)), counts)
    place = np.arange(len(row)) - first[row]
    copies = np.where(n[row] > 1, np.minimum(length, size[row] - place), 0)
    longest = np.maximum(np.maximum(previous, later), copies)
    opens, closes = np.zeros(len(row), bool), np.zeros(len(row), bool)
    opens[first], closes[first + counts - 1] = True, True
    found = []
    for bytes_, goes, of in ((length, True, previous if keep == "first" else longest), (window, False, longest))[: 1 + (window < length)]:
        gone = of >= bytes_
        before, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
        s, e = np.flatnonzero(gone & (opens | ~before)), np.flatnonzero(gone & (closes | ~after))
        found.append((row[s], x[row[s]] + place[s], x[row[s]] + place[e] + bytes_, np.full(len(s), goes)))
    r, a, b, goes = (np.concatenate(z) for z in zip(*found))
    none = np.array([h[2] is None for h in held])[r]
    return pa.RecordBatch.from_arrays([pa.array(docs[r], pa.int64(), mask=none), pa.array(rids[r]), pa.array(a), pa.array(b), pa.array(goes)], ["doc_id", "rid", "a", "b", "goes"])


# ---- the operator -----------------------------------------------------------------------------------------------------


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(docs: DataFrame, length: int = LENGTH, keep: str = "none", report: int | None = None) -> DataFrame:
    """doc_id, rid, text, the byte spans to remove and, of repeats of `report` bytes, those to tell, for each row of docs."""
    spark = tuned(docs.sparkSession)
    window = min(length, report or length)
    docs = texts(docs).withColumn("rid", F.xxhash64("doc_id", "text")).select("doc_id", "rid", "text")
    every = materialise(anchored(docs, window, length), "anchors")
    place = F.struct("doc_id", "x", "rid", "y", "p", "e")
    classes = every.groupBy("h", "cls").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    w = Window.partitionBy("h")
    classes = classes.withColumn("of", F.count("*").over(w)).where("n > 1 or of > 1")
    classes = materialise(classes, "classes")
    release(spark)
    shared = classes.where("of > 1").select("h", "n", (F.col("of") > HOT).alias("hot"), "at.*")
    spans = materialise(shards(shared, docs, window, length, keep), "spans")
    release(spark)
    many = classes.where("n > 1").select(F.col("h").alias("h2"), F.col("cls").alias("cls2"), "at")
    copies = every.join(many, (every.h == many.h2) & (every.cls == many.cls2))
    later = ~F.struct("doc_id", "x", "rid").eqNullSafe(F.struct("at.doc_id", "at.x", "at.rid")) if keep == "first" else F.lit(True)
    goes = copies.where(later & (F.col("e") - F.col("x") >= length)).select("doc_id", "rid", F.col("x").alias("a"), F.col("e").alias("b"), F.lit(True).alias("goes"))
    spans = spans.union(goes)
    if window < length:
        spans = spans.union(copies.select("doc_id", "rid", F.col("x").alias("a"), (F.col("y") + window).alias("b"), F.lit(False).alias("goes")))
    of = lambda goes: F.collect_set(F.when(F.col("goes") == goes, F.struct("a", "b")))
    found = spans.groupBy("doc_id", "rid").agg(of(True).alias("spans"), of(False).alias("told")).withColumnsRenamed({"doc_id": "d", "rid": "r"})
    return docs.join(found, (docs.rid == found.r) & docs.doc_id.eqNullSafe(found.d), "left").select("doc_id", "text", "spans", "told")


def dedup(docs: DataFrame, length: int = LENGTH, keep: str = "none", report: int | None = None) -> DataFrame:
    """doc_id, spans removed (bytes, end exclusive), the text that is left, n_bytes and n_repeated, for each row of docs.

    n_repeated: bytes covered by strings of `report` bytes (`length` by default) that start elsewhere too."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        spans, left, size, told = [], [], [], []
        for text, found, also in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
            raw, s = text.encode(), merged([(x["a"], x["b"]) for x in found or []])
            cut = [0, *(y for z in s for y in z), len(raw)]
            left.append(b"".join(raw[cut[i] : cut[i + 1]] for i in range(0, len(cut), 2)))
            spans.append([{"a": x, "b": y} for x, y in s])
            size.append(len(raw))
            told.append(sum(y - x for x, y in merged([(x["a"], x["b"]) for x in [*(found or []), *(also or [])]])))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(left, pa.binary()), pa.array(size, pa.int64()), pa.array(told, pa.int64())], ["doc_id", "spans", "kept", "n_bytes", "n_repeated"])

    return removed(docs, length, keep, report).mapInArrow(lean(per_batch(run)), "doc_id long, spans array<struct<a: long, b: long>>, kept binary, n_bytes long, n_repeated long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the bytes that repeats of REPORT bytes cover: shorter than the rule, so told but not removed."""
    out = dedup(table(spark, sf_dir, "documents"), report=REPORT)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.b - s.a)
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_repeated", (F.col("n_repeated") > 0).alias("has_repeat"))


NAME, ORACLE = "op1_suffix_dedup", None
