"""Benchmark decontamination by template canonicalisation.

Tokens are runs of letters and digits, lower-cased; numbers, names (title case inside a sentence) and units (after a
number) become typed placeholders, runs of numbers or of names one placeholder. Windows of WINDOW canonical tokens
(items with fewer tokens: the whole item) with at least half literal tokens are hashed and looked up in the windows of
the benchmark. A match goes on over neighbours that are the same word for word. Matches on one alignment of a text and an item are joined into runs, and these split where slots are in
conflict: within a stretch one item value stands for one text value and the other way round. A stretch of MIN_RUN
tokens, or of the whole item where that is shorter, marks the text. Thus a question asked again with other numbers or
names is found, and one in which a value was changed in one of its places only. Beside the templates, MIN_RUN tokens as
they stand (lower-cased, without placeholders; the whole item where it has fewer, down to one token) mark the text too,
whatever they are made of: so items of numbers and names, short items, and items whose first word looks like a name
where it stands in the text are found word for word.

Null or empty texts and items match nothing; an item that stands twice under two ids counts for both. The benchmark is
looked up in slices of SLICE windows at most, each with a pass over the texts, so what is broadcast stays bounded
however long the benchmark is. Rows of a repeated doc_id are judged together (their items united); null doc_ids are
one document. Ties (items of one text, runs of one length) all count. Very long texts are read whole. No documents give no
rows; without items every document is clean. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import quality as Q
from .common import lean, table, texts, tuned

WINDOW, MIN_RUN, SLICE = 8, 13, 1_000_000
UNITS = "mm cm m km mg g kg t ml l kb mb gb tb ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years inch inches foot feet yard yards mile miles pound pounds ounce ounces percent degree degrees dollar dollars euro euros cent cents usd eur gbp mph kmh watt watts volt volts".split()
NUM, NAME_, UNIT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _hash(words: list[str]) -> np.ndarray:
    col = pa.array(words, pa.string())
    data, offsets = K.buffers(col)
    return K.word_hashes(data, offsets)[0]


UNIT_HASHES = np.sort(_hash(UNITS))
_ENDS_SENTENCE = np.isin(np.arange(256), [ord(c) for c in ".!?:\n|\"*%$#&"])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first token by row, start byte, end byte) of the tokens as they stand, lower-cased."""
    s, e, first = K.words(np.where(Q.ALNUM[data], data, np.uint8(32)), offsets)
    return (K.span_hash(K.LOWER[data], s, e) if len(s) else np.zeros(0, np.uint64)), first, s, e


def canonical(data: np.ndarray, raw: np.ndarray, first: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, slot value or 0, first token by row) of the canonical tokens made of tokens()."""
    if not len(s):
        return raw, raw, first
    opens = np.zeros(len(s) + 1, bool)
    opens[first[:-1]] = True
    opens = opens[:-1]
    digits = np.concatenate([[0], np.cumsum(Q.DIGIT[data])])
    number = digits[e] > digits[s]
    breaks = np.concatenate([[0], np.cumsum(_ENDS_SENTENCE[data])])
    gap = np.concatenate([[0], e[:-1]])
    fresh = opens | (breaks[s] > breaks[gap])
    upper = Q.UPPER[data[s]] | ((data[s] == 0xC3) & (data[np.minimum(s + 1, len(data) - 1)] <= 0x9E))
    caps = np.concatenate([[0], np.cumsum(Q.UPPER[data])])
    name = upper & ~fresh & ~number & (caps[e] - caps[s] <= 1) & (e - s > 1)
    at = np.minimum(np.searchsorted(UNIT_HASHES, raw), len(UNIT_HASHES) - 1)
    unit = (UNIT_HASHES[at] == raw) & ~opens & np.concatenate([[False], number[:-1]])
    code = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME_, raw)))
    slot = np.where(number | unit | name, raw, np.uint64(0))
    again = np.concatenate([[False], (code[1:] == code[:-1]) & (number | name)[1:]]) & ~opens
    again &= ~(number & (s - gap > 1))  # 3.14 is one number, 3 14 are two
    if again.any():
        head = np.flatnonzero(~again)
        group = np.cumsum(~again) - 1
        value = np.zeros(len(head), np.uint64)
        np.add.at(value, group, slot * (np.uint64(2) * (np.arange(len(slot)) - head[group]).astype(np.uint64) + np.uint64(1)))
        first = np.searchsorted(head, first)
        return code[head], value, first
    return code, slot, first


def windows(code: np.ndarray, slot: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first token) of each window of k tokens inside one row, half of them literal at least."""
    h = K.window_hashes(code, k)
    if not len(h):
        return h, np.zeros(0, np.int64)
    literal = np.concatenate([[0], np.cumsum(slot == 0)])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(h)
    ok = (row[:n] == row[k - 1 : k - 1 + n]) & (2 * (literal[k : k + n] - literal[:n]) >= k)
    at = np.flatnonzero(ok)
    return h[at], at


class Exact:
    """The windows of MIN_RUN tokens as they stand, and items of fewer tokens whole, sorted by hash for each size."""

    def __init__(self, raw: np.ndarray, first: np.ndarray):
        n = np.diff(first)
        self.by_size = {}
        for k in sorted({min(x, MIN_RUN) for x in n.tolist() if x}):
            h = K.window_hashes(raw, k)
            at = np.arange(len(h))
            item = np.searchsorted(first, at, "right") - 1
            keep = (at + k <= first[item + 1]) & ((n[item] >= MIN_RUN) if k == MIN_RUN else (n[item] == k))
            h, at, item = h[keep], at[keep], item[keep]
            order = np.argsort(h, kind="stable")
            u, start, count = np.unique(h[order], return_index=True, return_counts=True)
            some = np.zeros(1 << 22, bool)
            some[u >> np.uint64(42)] = True
            self.by_size[k] = (u, start, count, at[order], item[order], some)

    def judge(self, raw: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, tokens) of the runs that stand word for word in a text."""
        for k, (u, start, count, at, item, some) in self.by_size.items():
            h = K.window_hashes(raw, k)
            here = np.flatnonzero(some[h >> np.uint64(42)])
            p = np.minimum(np.searchsorted(u, h[here]), len(u) - 1)
            row = np.searchsorted(first, here, "right") - 1
            hit = np.flatnonzero((u[p] == h[here]) & (here + k <= first[row + 1]))
            p, here, row = p[hit], here[hit], row[hit]
            if not len(p):
                continue
            c = count[p]
            q = np.repeat(start[p] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            here, row = np.repeat(here, c), np.repeat(row, c)
            shift, which = here - at[q], item[q]
            order = np.lexsort((here, shift, which, row))
            here, row, shift, which = here[order], row[order], shift[order], which[order]
            # windows of one alignment that begin one after another are one run
            head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (which[1:] != which[:-1]) | (shift[1:] != shift[:-1]) | (here[1:] != here[:-1] + 1)]))
            yield row[head], which[head], here[np.append(head[1:], len(here)) - 1] + k - here[head]


class Items:
    """The windows of a slice of the benchmark, sorted by hash, and the slots of its items."""

    def __init__(self, ids: list[int], item_texts: list[str], sizes: list[int] | None = None):
        data, offsets = K.buffers(pa.array(item_texts, pa.string()))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        raw, first, s, e = tokens(data, offsets)
        self.exact = Exact(raw, first)
        self.code, self.slot, self.first = canonical(data, raw, first, s, e)
        self.value = np.where(self.slot != 0, self.slot, self.code)
        self.ids = np.array(ids, np.int64)
        n = np.diff(self.first)
        self.need = np.minimum(n, MIN_RUN)
        found: dict[int, list] = {}
        for k in sorted({WINDOW, *(x for x in n.tolist() if 3 <= x < WINDOW)}):
            h, at = windows(self.code, self.slot, self.first, k)
            item = np.searchsorted(self.first, at, "right") - 1
            keep = (n[item] >= WINDOW) if k == WINDOW else (n[item] == k)
            found[k] = [h[keep], at[keep], item[keep]]
        self.by_size = {}
        for k, (h, at, item) in found.items():
            order = np.argsort(h, kind="stable")
            u, start, count = np.unique(h[order], return_index=True, return_counts=True)
            self.by_size[k] = (u, start, count, at[order], item[order])

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item id, tokens in its longest consistent stretch, or in a run word for word) of each marked pair."""
        raw, first, s, e = tokens(data, offsets)
        found = [*self.exact.judge(raw, first), self._templates(*canonical(data, raw, first, s, e))]
        row, item, n = (np.concatenate(x) for x in zip(*found))
        return row, self.ids[item], n

    def _templates(self, code: np.ndarray, slot: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, items, starts, ends, shift = [], [], [], [], []
        for k, (u, start, count, at, item) in self.by_size.items():
            if not len(u):
                continue
            h, here = windows(code, slot, first, k)
            p = np.minimum(np.searchsorted(u, h), len(u) - 1)
            hit = np.flatnonzero(u[p] == h)
            p, here = p[hit], here[hit]
            c = count[p]
            q = np.repeat(start[p] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            here = np.repeat(here, c)
            rows.append(np.searchsorted(first, here, "right") - 1)
            items.append(item[q])
            starts.append(here)
            ends.append(here + k)
            shift.append(here - at[q])
        if not rows or not sum(map(len, rows)):
            z = np.zeros(0, np.int64)
            return z, z, z
        rows, items, starts, ends, shift = (np.concatenate(x) for x in (rows, items, starts, ends, shift))

        def runs() -> tuple[np.ndarray, ...]:
            order = np.lexsort((starts, shift, items, rows))
            r, i, s, e, d = (x[order] for x in (rows, items, starts, ends, shift))
            head = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (s[1:] > e[:-1])]))
            return r[head], i[head], s[head], e[np.append(head[1:], len(s)) - 1], d[head]

        rows, items, starts, ends, shift = runs()
        # a run goes on over tokens that are the same word for word, be they placeholders on one side or on both
        value = np.where(slot != 0, slot, code)
        low, high = np.maximum(first[rows], self.first[items] + shift), np.minimum(first[rows + 1], self.first[items + 1] + shift)
        live = np.flatnonzero(starts > low)
        while len(live):
            live = live[value[starts[live] - 1] == self.value[starts[live] - 1 - shift[live]]]
            starts[live] -= 1
            live = live[starts[live] > low[live]]
        live = np.flatnonzero(ends < high)
        while len(live):
            live = live[value[ends[live]] == self.value[ends[live] - shift[live]]]
            ends[live] += 1
            live = live[ends[live] < high[live]]
        rows, items, a, b, shift = runs()
        long = np.flatnonzero(b - a >= self.need[items])
        n = np.zeros(len(long), np.int64)
        for at, i in enumerate(long.tolist()):
            u, v = slice(a[i], b[i]), slice(a[i] - shift[i], b[i] - shift[i])
            filled = (slot[u] != 0) | (self.slot[v] != 0)
            n[at] = _longest(np.where(filled, value[u], np.uint64(0)), np.where(filled, self.value[v], np.uint64(0)))
        good = n >= self.need[items[long]]
        return rows[long[good]], items[long[good]], n[good]


def _longest(x: np.ndarray, y: np.ndarray) -> int:
    """Tokens in the longest stretch of aligned slots in which one value of x stands for one of y and the other way round."""
    filled = np.flatnonzero((x != 0) | (y != 0))
    there: dict[int, tuple[int, int]] = {}
    back: dict[int, tuple[int, int]] = {}
    best = low = 0
    for i, u, v in zip(filled.tolist(), x[filled].tolist(), y[filled].tolist()):
        v_, at = there.get(u, (v, -1))
        u_, to = back.get(v, (u, -1))
        # a stretch begins behind the last slot that gave either value another partner
        best = max(best, i - low)
        low = max(low, at + 1 if v_ != v else 0, to + 1 if u_ != u else 0)
        there[u], back[v] = (v, i), (u, i)
    return max(best, len(x) - low)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, run) of each text and item that match; a pass over docs for each slice of the benchmark."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    out = spark.createDataFrame([], "doc_id long, item_id long, run long")
    held: list[tuple[int, str]] = []
    size = 0

    def one(part: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Items([i for i, _ in part], [t for _, t in part]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                for a, b, data, offsets in K.chunks(batch.column(1)):
                    r, item, n = shared.value.judge(data, offsets)
                    if len(r):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(r + a)), pa.array(item), pa.array(n)], ["doc_id", "item_id", "run"])

        return docs.mapInArrow(lean(run), "doc_id long, item_id long, run long")

    for row in items.toLocalIterator(prefetchPartitions=True):
        held.append((row.item_id, row.text))
        size += len(row.text) // 4 + 1
        if size >= SLICE:
            out, held, size = out.union(one(held)), [], 0
    return out.union(one(held)) if held else out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, item_ids (ascending), longest_run, contaminated for each doc_id."""
    tuned(docs.sparkSession)
    t = texts(docs)
    found = matches(t, benchmark).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("run").alias("longest_run"))
    found = found.withColumnRenamed("doc_id", "found_id")
    # the texts are not needed any more: only ids meet the few documents found
    every = t.select("doc_id").distinct()
    out = every.join(found, every.doc_id.eqNullSafe(found.found_id), "left")
    return out.select("doc_id", F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"), F.coalesce(F.size("item_ids") > 0, F.lit(False)).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


NAME, ORACLE = "op9_decontamination", None
