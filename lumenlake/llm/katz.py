"""Language-model scores by Katz backoff over n-grams, from an order down to single words.

Counts are taken of training texts only (a word's tokens end with an end token; start marks are the first history).
With h' the history h less its first word, p(w | h') is d_c c(h, w) / c(h) where the n-gram was seen, else a(h) p(w | h'),
and p(w | h') where h was never seen; p(w) is the add-one estimate with one unknown word, so it sums to 1. d_c are
Good-Turing discounts of each order for counts up to CUT; a(h) is the mass that they leave over the mass p(. | h') of
unseen words, so every p(. | h) sums to 1 exactly (a history whose counts are all above CUT gets one more count in its
denominator, which makes room). Histories are settled from the short ones to the long ones, a pass for each order.

Texts lie in blocks of numbered words, in buckets that answers to them share. A block asks the partition that holds a key for its count, once for each
distinct key, in sorted arrays; answers come in the order of the keys. So the tables are never broadcast, and an n-gram
that a third of all texts hold is one entry a block. A history is an n-gram too, so its count is known. What its backoff
weight needs is only sent for histories that matter: those that a held-out text holds (the answers to the counts tell)
and those seen more than CUT times. One block that asked for a seen n-gram is told to own it, and adds its shares to
the sums of its history; a block asks for the weights that its unseen n-grams need. At last a block scores its texts.

Keys are 64-bit hashes of words and of chains of them; of n distinct n-grams n ** 2 / 2 ** 65 pairs are taken for one
(at 10 ** 9, 0.03 pairs). Partitions grow in number with the tokens, so what one holds at once stays alike.

Null texts are empty ones (one token: the end). Rows of a repeated doc_id each count and each are scored. Null doc_ids
are hashed as ''. A very long text is one block by itself. No training rows: every score is the base score with
N = V = 0. Extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import bucketed, crc_mod, drop_scratch, lean, materialise, release, table, texts, tuned

#: Bytes of text in a block (its columns stay below what the JVM takes for huge objects), the counts that are discounted, the order, and the tokens that a partition is to hold.
BLOCK, CUT, ORDER, PARTITION = 3 << 18, 5, 3, 1 << 21
#: Partitions of keys that a task sorts, and blocks of a bucket: both lie in the JVM's memory as a whole.
TASK, BUCKET = 4, 32
END = np.uint64(0x8F1BBCDC5A827999)
_START, _A, _B = np.uint64(0x6ED9EBA1CA62C1D6), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)
#: Kinds of requests: counts of n-grams have their n, weights of the histories of n-grams HISTORY more.
HISTORY = 64


def _zip(x: np.ndarray) -> bytes:
    """Numbers without a sign in the least width that holds them, and doubles: all first bytes, all second ones and so on, compressed."""
    if x.dtype.kind != "f":
        x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(-1, x.itemsize).T
    return bytes([x.itemsize]) + pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(x) else b""


def _unzip(x: bytes, n: int, dtype: type = np.int64) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    size = x[0]
    planes = np.frombuffer(pa.decompress(x[1:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(f"f{size}" if dtype is np.float64 else f"u{size}").ravel().astype(dtype, copy=False)


def blocks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, held_out) as rows of some MB each: block, doc_ids, held, sizes (in tokens), words (hashes by falling count), at (the number of each token's word)."""
    names = ["block", "doc_ids", "held", "sizes", "words", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, size = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        held: list = []
        sizes: list[np.ndarray] = []
        words: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            word, at, count = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
            order = np.argsort(-count)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            row = [[(part << 24) + k], [ids], [held], [np.concatenate(sizes).tolist()], [word[order].tobytes()], [_zip(rank[at])]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names)

        for b in batches:
            for a, z, data, offsets in K.chunks(b.column(1), BLOCK // 4):
                h, first = K.word_hashes(data, offsets)
                n = z - a
                ends = first[1:] + np.arange(n)
                word = np.empty(len(h) + n, np.uint64)
                inside = np.ones(len(word), bool)
                inside[ends] = False
                word[inside], word[ends] = h, END
                ids += b.column(0).slice(a, n).to_pylist()
                held += b.column(2).slice(a, n).to_pylist()
                sizes.append(np.diff(first) + 1)
                words.append(word)
                size += len(data)
                if size >= BLOCK:
                    yield flush()
                    ids, held, sizes, words, k, size = [], [], [], [], k + 1, 0
        if ids:
            yield flush()

    return docs.mapInArrow(lean(run), "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, words binary, at binary")


class Tokens:
    """The tokens of a block; of each order the distinct n-grams by their keys and the number of each token's n-gram among them."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.n = int(self.first[-1])
        self.train = np.repeat(~np.array(row["held"], bool), self.sizes)
        self.word, self.at = np.frombuffer(row["words"], np.uint64), _unzip(row["at"], self.n)
        self.hash = self.word[self.at]

    def raise_to(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(order, sorted keys, number of each token's n-gram) for the orders up to n."""
        order = np.argsort(self.word)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        yield 1, self.word[order], rank[self.at]
        for k in range(2, n + 1):
            self.chain(k)
            yield k, *np.unique(self.hash, return_inverse=True)

    def of(self, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """raise_to() for some orders, ascending, alone."""
        if orders[0] == 1:
            yield from (x for x in self.raise_to(orders[-1]) if x[0] in orders)
            return
        for k in range(2, orders[-1] + 1):
            self.chain(k)
            if k in orders:
                yield k, *np.unique(self.hash, return_inverse=True)

    def chain(self, k: int) -> None:
        """From the hashes of the (k - 1)-grams to those of the k-grams."""
        before = np.empty_like(self.hash)
        before[1:] = self.hash[:-1]
        before[self.first[:-1]] = start(k)
        self.hash = K.mix(self.word[self.at] * _A + before * _B)

    def before(self, x: np.ndarray, at_start) -> np.ndarray:
        """x of the token before each; at_start for the first ones of texts."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first[:-1]] = at_start
        return out


def start(k: int) -> np.uint64:
    """The key of the history of k - 1 start marks."""
    return K.mix(np.array([_START + np.uint64(k)]))[0]


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as the bytes that a step takes, the first key, then the steps."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(x: bytes, n: int) -> np.ndarray:
    width = x[0]
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(x, np.uint8, 8, 1)
    steps[1:, :width] = np.frombuffer(x, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(partition, begin, end) of the sorted keys of each of 2 ** bits partitions that has some."""
    pid = (keys >> np.uint64(64 - bits)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]])) if len(pid) else np.zeros(0, np.int64)
    return zip(pid[head].tolist(), head.tolist(), [*head[1:].tolist(), len(keys)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks, one at a time, with all that they were told in one list."""
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            r["told"] = r.get("told") or []
            yield r


_ASK = "kind byte, pid int, block long, n long, keys binary, given binary"


def _ask(rows: list[tuple]) -> pa.RecordBatch:
    k = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(k, [pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])], ["kind", "pid", "block", "n", "keys", "given"])


def count_requests(parts: DataFrame, orders: tuple[int, ...], bits: int) -> DataFrame:
    """Of each distinct n-gram of a block its count in training texts, and (the lowest bit) whether a held-out text holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            t = Tokens(r)
            for kind, keys, at in t.of(orders):
                learnt = np.bincount(at[t.train], minlength=len(keys)).astype(np.uint64)
                held = np.zeros(len(keys), np.uint64)
                held[at[~t.train]] = 1
                given = learnt << np.uint64(1) | held
                yield _ask([(kind, p, r["block"], y - x, _pack(keys[x:y]), _zip(given[x:y])) for p, x, y in _slices(keys, bits)])

    return parts.select("block", "held", "sizes", "words", "at").mapInArrow(lean(run), _ASK)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[dict]]]:
    """Rows of one (kind, pid) after another."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and (held[0]["kind"], held[0]["pid"]) != (r["kind"], r["pid"]):
                yield held[0]["kind"], held[0]["pid"], held
                held = []
            held.append(r)
    if held:
        yield held[0]["kind"], held[0]["pid"], held


def _met(asked: DataFrame, bits: int) -> DataFrame:
    """Requests in the order of their partitions, TASK of which a task has, whatever the input."""
    return asked.repartition(max(8, (1 << bits) // TASK), "pid").sortWithinPartitions("kind", "pid", "block")


def answer_counts(asked: DataFrame) -> DataFrame:
    """Answers to each block (count, whether a held-out text holds it, whether the block owns it), and a row with block -1 of each partition's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, pid, rows in _groups(batches):
            keys = np.concatenate([_unpack(r.pop("keys"), r["n"]) for r in rows])
            given = np.concatenate([_unzip(r.pop("given"), r["n"]) for r in rows])
            order = np.argsort(keys)
            keys, given = keys[order], given[order]
            head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            total = np.add.reduceat(given >> 1, head)
            wanted = np.bitwise_or.reduceat(given & 1, head)
            del given
            value = np.empty(len(keys), np.int64)
            value[order] = np.repeat(total << 2 | wanted << 1, np.diff(np.append(head, len(keys))))
            value[order[head]] |= 1
            at = 0
            out = []
            for r in rows:
                out.append((kind, pid, r["block"], r["n"], b"", _zip(value[at : at + r["n"]].astype(np.uint64))))
                at += r["n"]
            seen = total[total > 0]
            sums = np.concatenate([[seen.sum(), len(seen)], np.bincount(np.minimum(seen, CUT + 2), minlength=CUT + 3)[1 : CUT + 2]]).astype(np.uint64)
            out.append((kind, pid, -1, len(sums), b"", _zip(sums)))
            yield _ask(out)

    return asked.mapInArrow(lean(run), _ASK)


def discounts(of: np.ndarray) -> np.ndarray:
    """d_1 .. d_CUT from the numbers of n-grams seen 1 .. CUT + 1 times; where Good-Turing gives none in (0, 1), c - 1/2 over c."""
    out = np.array([(c - 0.5) / c for c in range(1, CUT + 1)])
    if of[0] > 0:
        rest = (CUT + 1) * of[CUT] / of[0]
        for c in range(1, CUT + 1):
            if of[c - 1] > 0 and rest < 1:
                d = ((c + 1) * of[c] / (c * of[c - 1]) - rest) / (1 - rest)
                if 0 < d < 1:
                    out[c - 1] = d
    return out


def _table(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where(c > CUT, 1.0, np.concatenate([[1.0], d])[np.minimum(c, CUT)])


def _answers(rows: list[dict], kind: int, dtype: type = np.int64) -> np.ndarray:
    got = sorted((r["pid"], r["n"], r["given"]) for r in rows if r["kind"] == kind)
    return np.concatenate([np.zeros(0, dtype), *(_unzip(g, n, dtype) for _, n, g in got)])


def _with(parts: DataFrame, answers: DataFrame) -> DataFrame:
    """The blocks with what they were told; both tables are in buckets by block, so nothing is shuffled.

    All answers lie in one table: with one for each kind, a task would group, sort and join as many at once."""
    told = answers.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("kind", "pid", "n", "given")).alias("told"))
    return parts.join(told, "block", "left")


class Level:
    """What a block knows of its n-grams of one order: keys, number by token, counts; and of the histories (-1: start marks)."""

    def __init__(self, t: Tokens, told: list[dict], model: dict, n: int, keys: np.ndarray, at: np.ndarray, below: Level | None):
        self.keys, self.at = keys, at
        value = _answers(told, n)
        self.count, self.wanted, self.own = value >> 2, value >> 1 & 1, value & 1
        self.c = self.count[at]
        if below is None:
            self.p = (self.c + 1.0) / model["below"]
            return
        self.history = t.before(below.at, -1)
        self.ch = t.before(below.c, model["docs"])
        self.history_keys = np.append(below.keys, start(n))  # number -1 is the last
        #: histories whose weight is wanted, and those of which it is enough to know the denominator
        self.needs, self.asks = np.zeros(len(self.history_keys), bool), np.zeros(len(self.history_keys), bool)
        self.needs[self.history[(self.ch > 0) & (self.c == 0)]] = True
        self.asks[self.history[self.ch > CUT]] = True
        self.asks |= self.needs

    def settle(self, told: list[dict], model: dict, n: int, below: Level) -> None:
        """p of each token, from the answers on its history."""
        order = np.argsort(self.history_keys)
        weight = np.zeros(len(order))
        weight[order[self.asks[order]]] = _answers(told, HISTORY + n, np.float64)
        w = weight[self.history]
        denominator = np.maximum(self.ch + (w < 0), 1)
        self.p = np.where(self.c > 0, _table(model["d"][n], self.c) * self.c / denominator, np.where(self.ch > 0, np.abs(w) / denominator, 1.0) * below.p)


def _levels(t: Tokens, told: list[dict], model: dict, order: int, settled: int) -> tuple[Level, Level | None, Level]:
    """(first, last but one, last) of the levels up to order; those up to `settled` have p."""
    first = below = last = None
    for n, keys, at in t.raise_to(order):
        below, last = last, Level(t, told, model, n, keys, at, last)
        if n == 1:
            first = last
        elif n <= settled:
            last.settle(told, model, n, below)
    return first, below, last


def history_requests(parts: DataFrame, answers: DataFrame, model: dict, order: int, bits: int) -> DataFrame:
    """By history: what the discounts leave of the counts of the n-grams that the block owns and their mass by the shorter
    history, where that matters, and whether the block wants its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            t = Tokens(r)
            _, below, last = _levels(t, r["told"], model, order, order - 1)
            token = np.empty(len(last.keys), np.int64)
            token[last.at] = np.arange(t.n)
            own = np.flatnonzero(last.own & (last.count > 0))
            token, c = token[own], last.count[own]
            wanted = t.before(below.wanted[below.at], 1)[token] > 0
            matters = (last.ch[token] > CUT) | wanted
            token, c, wanted = token[matters], c[matters], wanted[matters]
            h, n = last.history[token] % len(last.history_keys), len(last.history_keys)
            gives = np.bincount(h, minlength=n) > 0
            left = np.bincount(h, (1 - _table(model["d"][order], c)) * c, n)
            mass = np.bincount(h, np.where(wanted, below.p[token], 0), n)  # whose weight nobody wants has none
            some = np.flatnonzero(gives | last.asks)
            some = some[np.argsort(last.history_keys[some])]
            keys, does = last.history_keys[some], gives[some] + 2 * last.asks[some].astype(np.uint64) + 4 * last.needs[some].astype(np.uint64)
            if len(keys):
                yield _ask([(HISTORY + order, pid, r["block"], y - x, _pack(keys[x:y]), _pair(does[x:y], left[some[x:y]], mass[some[x:y]])) for pid, x, y in _slices(keys, bits)])

    return _with(parts, answers).mapInArrow(lean(run), _ASK)


def _pair(does: np.ndarray, left: np.ndarray, mass: np.ndarray) -> bytes:
    gives = does & np.uint64(1) == 1
    parts = [_zip(does), _zip(left[gives]), _zip(mass[gives])]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unpair(x: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, at = [], 0
    for _ in range(3):
        size = int.from_bytes(x[at : at + 4], "little")
        parts.append(x[at + 4 : at + 4 + size])
        at += 4 + size
    does = _unzip(parts[0], n)
    gives = does & 1 == 1
    sums = np.zeros((2, n))
    for row, p in zip(sums, parts[1:]):
        row[gives] = _unzip(p, int(gives.sum()), np.float64)
    return does, *sums


def answer_histories(asked: DataFrame) -> DataFrame:
    """For each history that a block asks for, a(h) times its denominator (0 if the block needs no weight), negative if the denominator is one more than c(h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, pid, rows in _groups(batches):
            keys = np.concatenate([_unpack(r["keys"], r["n"]) for r in rows])
            given = [_unpair(r["given"], r["n"]) for r in rows]
            u, at = np.unique(keys, return_inverse=True)
            left, mass = (np.bincount(at, np.concatenate([g[i] for g in given]), len(u)) for i in (1, 2))
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.where(left <= 1e-9, -1.0, left) / (1 - mass)
            out, k = [], 0
            for r, (does, _, _) in zip(rows, given):
                wants = does & 2 == 2
                if wants.any():
                    told = value[at[k : k + r["n"]][wants]]
                    told = np.where(does[wants] & 4 == 4, told, np.where(told < 0, -1.0, 0.0))
                    out.append((kind, pid, r["block"], int(wants.sum()), b"", _zip(told)))
                k += r["n"]
            if out:
                yield _ask(out)

    return asked.mapInArrow(lean(run), _ASK)


def score(parts: DataFrame, answers: DataFrame, model: dict, order: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            t = Tokens(r)
            first, _, last = _levels(t, r["told"], model, order, order)
            add = lambda x: np.add.reduceat(x, t.first[:-1])  # noqa: E731  every row holds its end token
            n = len(t.sizes)
            yield pa.RecordBatch.from_arrays([
                pa.array(r["doc_ids"], pa.int64()), pa.array(r["held"], pa.bool_()), pa.array(t.sizes), pa.array(add((first.c > 0).astype(np.int64))),
                pa.array(np.full(n, model["n"], np.int64)), pa.array(add(np.log10(first.p))), pa.array(add(np.log10(last.p)))
            ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _with(parts, answers).mapInArrow(lean(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def katz(docs: DataFrame, held_out: F.Column, order: int = 2) -> DataFrame:
    """With n-grams of up to order tokens: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; rows of held_out aren't learnt from."""
    spark = tuned(docs.sparkSession)
    parts = materialise(blocks(texts(docs).withColumn("held_out", held_out)), "blocks")
    buckets = max(4, -(-parts.count() // BUCKET))
    plain, parts = parts, bucketed(parts, "blocks", "block", buckets)
    drop_scratch(plain)
    release(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    usual = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "8")  # rows hold up to a megabyte
    count = parts.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)), F.sum(F.size(F.filter("held", lambda x: ~x)))).first()
    tokens = int(count[0] or 0)
    bits = max(3, (tokens // PARTITION).bit_length())
    answers: DataFrame | None = None
    # the counts of one order after another, so that only the requests of one are on disk at once
    for orders in [(n,) for n in range(1, order + 1)]:
        answers = bucketed(answer_counts(_met(count_requests(parts, orders, bits), bits)), "answers", "block", buckets, answers)
        release(spark)
    stats = {n: np.zeros(CUT + 3, np.int64) for n in range(1, order + 1)}
    # two numbers and a few counts of counts, added up by partition of the answers
    for r in _totals(answers).collect():
        stats[r.kind] += np.frombuffer(r.sums, np.int64)
    model = {"n": int(stats[1][0]), "docs": int(count[1] or 0), "below": float(stats[1][0] + stats[1][1] + 1), "d": {n: discounts(x[2:]) for n, x in stats.items()}}
    for n in range(2, order + 1):
        # up to the order in question the counts are needed, and the weights of all shorter histories
        known = answers.where((F.col("kind") <= n) | (F.col("kind") > HISTORY))
        answers = bucketed(answer_histories(_met(history_requests(parts, known, model, n, bits), bits)), "answers", "block", buckets, answers)
        release(spark)
    # a row for each text: written here, while tables are read a few rows at a time
    out = materialise(score(parts, answers, model, order), "scores")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", usual)
    tuned(spark)
    return out


def _totals(answers: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                out[r["kind"]] = out.get(r["kind"], 0) + _unzip(r["given"], r["n"])
        for k, v in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int8()), pa.array([v.tobytes()], pa.binary())], ["kind", "sums"])

    return answers.where("block = -1").select("kind", "n", "given").mapInArrow(run, "kind byte, sums binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz(table(spark, sf_dir, "documents"), crc_mod(7) == 2, ORDER)


NAME, ORACLE = "op7_katz", None
