"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Texts are encoded by the tokenizers library. A byte-level BPE never merges across its pre-tokens, so a text is cut at
places where a pre-token surely ends, each distinct piece of a batch is encoded once, and the ids are put together by
numpy; tests hold this against encoding whole texts. Ids are replaced by their rank by frequency, so that most take
one byte. A shard holds a header, document ids and lengths, control bytes (two bits an id: bytes it takes, less one)
and the data bytes. Decoding looks the lengths of four ids up for each control byte.

Shards are cells of a Parquet folder that Spark writes, for its commit protocol survives lost executors and any store
that Spark can reach will do; export_shard() gives the bytes of one as a plain file. Empty or null texts hold the end
id alone; equal doc_ids are ordered by their ids; null doc_ids come first. A very long text is one text of its shard, and
a shard holds one text at least. No rows give no shards and no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import drop_scratch, held, lean, materialise, scratch_path, table, texts, tuned

END_ID = 2
#: Ids that a shard holds before the next one begins (the last text is kept whole).
SHARD_IDS = 2_000_000
#: Distinct pieces whose ids a worker keeps (others are encoded whenever they come), and the places of a table of short ones.
CACHE, TABLE_BITS = 1_000_000, 20
_ODD = re.compile(r"[\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_BYTES = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True


def vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def _marked(n: int, *places) -> np.ndarray:
    """The distinct places among 0 .. n, ascending; marks in a bitmap cost less than sorting or hashing them."""
    mark = np.zeros(n + 1, bool)
    for p in places:
        mark[p] = True
    return np.flatnonzero(mark)


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending places at which pre-tokens end, 0 and the end included; white space beyond ASCII must be absent.

    The pattern gives a run of white space to one piece but for its last character; that one opens the next piece if
    it is a space and stands alone else. A word's last commas and full stops are cut off where a letter or digit is
    before them."""
    s, e, _ = K.words(data, offsets)
    if not len(s):
        return _marked(len(data), offsets, [0, len(data)])
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    began = opens[s]
    before = data[np.maximum(s - 1, 0)]
    lead = ~began & (before == 0x20)
    alone = s[~began & ~lead] - 1
    t = e.copy()
    for _ in range(3):
        t -= (t - 1 > s) & _STOP[data[t - 1]]
    low = data[t - 1]
    latin = (t - 2 >= s) & (data[np.maximum(t - 2, 0)] == 0xC3) & (low >= 0x80) & (low != 0x97) & (low != 0xB7)
    ok = (t < e) & (_ALNUM[low] | latin)
    return _marked(len(data), offsets, s - lead, alone, e, t[ok])


class Pieces:
    """The ids of the pieces that a worker has met, told apart by their bytes.

    Pieces of 16 bytes or fewer lie in two tables of fixed size, each piece at a place of either that its hash names;
    a lookup compares all bytes and the length. Longer pieces, and short ones whose places are taken, are in a dict."""

    def __init__(self, dtype: type):
        n = 1 << TABLE_BITS
        self.low, self.high = np.zeros((2, n), np.uint64), np.zeros((2, n), np.uint64)
        self.length, self.entry = np.zeros((2, n), np.uint8), np.zeros((2, n), np.int32)
        self.other: dict[bytes, int] = {}
        self.flat, self.first, self.size = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def _places(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = K.mix(low ^ K.mix(high ^ size.astype(np.uint64)))
        return h >> np.uint64(64 - TABLE_BITS), (h >> np.uint64(16)) & np.uint64((1 << TABLE_BITS) - 1)

    def find(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """(entry or -1 of each piece, what put() needs of them)."""
        size = b - a
        at = K.eights(data)
        low = at[a] & K._MASK[np.minimum(size, 8)]
        high = np.zeros(len(a), np.uint64)
        more = np.flatnonzero(size > 8)
        high[more] = at[a[more] + 8] & K._MASK[np.minimum(size[more] - 8, 8)]
        places = self._places(low, high, size)
        out = np.full(len(a), -1, np.int64)
        left = slice(None)
        for t, p in enumerate(places):
            p = p[left]
            hit = (self.low[t][p] == low[left]) & (self.high[t][p] == high[left]) & (self.length[t][p] == size[left]) & (size[left] <= 16)
            if t == 0:
                out[hit] = self.entry[t][p[hit]]
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = self.entry[t][p[hit]]
        return out, (low, high, size, *places)

    def put(self, ids: np.ndarray, n: np.ndarray, keys: tuple[np.ndarray, ...], piece) -> np.ndarray:
        """Entries of new pieces; ids: theirs on end, n: how many each has, keys: what find() gave of each; piece(i): the bytes of one."""
        at = len(self.size) + np.arange(len(n))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(n) - n])
        self.size = np.concatenate([self.size, n.astype(np.int32)])
        self.flat = np.concatenate([self.flat, ids.astype(self.flat.dtype)])
        if len(self.size) <= CACHE:
            low, high, size, *places = keys
            left = size <= 16
            for t, p in enumerate(places):
                free = np.flatnonzero(left & (self.length[t][p] == 0))
                _, one = np.unique(p[free], return_index=True)
                new = free[one]
                q = p[new]
                self.low[t][q], self.high[t][q], self.length[t][q], self.entry[t][q] = low[new], high[new], size[new], at[new]
                left[new] = False
            for i in np.flatnonzero(left | (size > 16)).tolist():
                self.other[piece(i)] = int(at[i])
        return at

    def cut(self, entries: int) -> None:
        """Forget the entries beyond the bound."""
        if len(self.size) > max(entries, CACHE):
            keep = max(entries, CACHE)
            self.flat, self.first, self.size = self.flat[: self.first[keep]], self.first[:keep], self.size[:keep]


class Encoder:
    """Ids of whole texts by the library, each distinct piece encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = re.compile(b"|".join([_ODD_BYTES, *(re.escape(x.encode()) for x in self.special)]))
        self.known = Pieces(self.dtype)
        spaced = self.library.get_vocab()
        self.opens = np.zeros(size, bool)
        self.opens[[i for t, i in spaced.items() if t.startswith("Ġ")]] = True

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _joined(self, raw: bytes, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of pieces that begin with a space and hold no other, given on end with their lengths.

        A space before other characters opens a pre-token wherever it stands, and only there does an id begin with it."""
        ends = np.cumsum(n)
        at = [0, *ends[511:-1:512].tolist(), int(ends[-1])]
        out = np.concatenate([np.array(self.library.encode_batch_fast([raw[x:y].decode()], add_special_tokens=False)[0].ids, self.dtype) for x, y in zip(at[:-1], at[1:]) if y > x])
        opens = np.flatnonzero(self.opens[out])
        if len(opens) != len(n):
            raise AssertionError("a piece with more than one space")
        return out, np.diff(np.append(opens, len(out)))

    def _one_by_one(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.library.encode_batch_fast([self._sure(p).decode() for p in pieces], add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((x for g in got for x in g), self.dtype, int(n.sum())), n

    def _learn(self, data: np.ndarray, raw: bytes, a: np.ndarray, b: np.ndarray, spaced: np.ndarray, at: np.ndarray, keys: tuple[np.ndarray, ...]) -> None:
        """Fill in the entries (-1 in at) of pieces that find() has not found."""
        miss = np.flatnonzero(at < 0)
        fast = miss[spaced[miss] & (b[miss] - a[miss] <= 16)]
        if len(fast):
            key = K.mix(keys[0][fast] ^ K.mix(keys[1][fast] ^ keys[2][fast].astype(np.uint64)))
            order = np.argsort(key)
            f = fast[order]
            same = lambda k: k[f[1:]] == k[f[:-1]]
            head = np.concatenate([[True], ~(same(keys[0]) & same(keys[1]) & same(keys[2]))])
            one = f[head]  # a piece may be there twice if two have one hash: that costs an entry, no more
            if self.known.other:
                old = np.array([self.known.other.get(raw[x:y], -1) for x, y in zip(a[one].tolist(), b[one].tolist())])
            else:
                old = np.full(len(one), -1)
            new = np.flatnonzero(old < 0)
            if len(new):
                x, n = a[one[new]], b[one[new]] - a[one[new]]
                where = np.repeat(x - (np.cumsum(n) - n), n) + np.arange(n.sum())
                ids, m = self._joined(data[where].tobytes(), n)
                old[new] = self.known.put(ids, m, tuple(k[one[new]] for k in keys), lambda i: raw[x[i] : x[i] + n[i]])
            at[f] = old[np.cumsum(head) - 1]
        rest = miss[at[miss] < 0]
        if len(rest):
            new_: dict[bytes, list[int]] = {}
            for i, x, y in zip(rest.tolist(), a[rest].tolist(), b[rest].tolist()):
                piece = raw[x:y]
                if (e := self.known.other.get(piece)) is not None:
                    at[i] = e
                else:
                    new_.setdefault(piece, []).append(i)
            if new_:
                pieces = list(new_)
                ids, m = self._one_by_one(pieces)
                first = np.array([new_[p][0] for p in pieces])
                entries = self.known.put(ids, m, tuple(k[first] for k in keys), pieces.__getitem__)
                for p, e in zip(pieces, entries.tolist()):
                    at[new_[p]] = e

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, the end id appended."""
        raw = data.tobytes()
        odd = set()
        if self.odd.search(raw):
            for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if self.odd.search(raw, a, b):
                    t = raw[a:b].decode()
                    if _ODD.search(t) or any(x in t for x in self.special):
                        odd.add(r)
        cuts = _cuts(data, offsets)
        a, b = cuts[:-1], cuts[1:]
        if not len(a):
            return [np.array([END_ID], self.dtype) for _ in offsets[1:]]
        at, keys = self.known.find(data, a, b)
        had = len(self.known.size)
        if (at < 0).any():
            spaced = (data[a] == 0x20) & (b - a > 1) & ~K.SPACE[data[np.minimum(a + 1, len(data) - 1)]]
            for r in odd:
                spaced[np.searchsorted(a, offsets[r]) : np.searchsorted(a, offsets[r + 1])] = False
            self._learn(data, raw, a, b, spaced, at, keys)
        n = self.known.size[at].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.known.flat[np.repeat(self.known.first[at] - (ends - n), n) + np.arange(ends[-1])]
        self.known.cut(had)
        row = np.concatenate([[0], ends])[np.searchsorted(a, offsets)]
        return [np.append(self.whole(raw[offsets[r] : offsets[r + 1]].decode()) if r in odd else ids[row[r] : row[r + 1]], self.dtype(END_ID)) for r in range(len(offsets) - 1)]

    @staticmethod
    def _sure(piece: bytes) -> bytes:
        try:
            piece.decode()
            return piece
        except UnicodeDecodeError:  # only of a text that is encoded whole
            return b" "


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """kind 0: doc_id, n_tokens, ids, file, place of each row of docs(doc_id, text, file, place); kind 1: a task's counts by id."""
    path = vocabulary(path)
    names = ["kind", "doc_id", "n_tokens", "ids", "file", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        counts = np.zeros(len(e.opens), np.int64)
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column(1)):
                ids = e.rows(data, offsets)
                counts += np.bincount(np.concatenate(ids), minlength=len(counts))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, np.int8)), batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), *(batch.column(j).slice(a, b - a) for j in (2, 3))], names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int8()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([counts.tobytes()], pa.binary()), *(pa.array([None], pa.int64()) for _ in range(2))], names)

    return docs.mapInArrow(lean(run), "kind byte, doc_id long, n_tokens long, ids binary, file long, place long")


def ranking(encoded: DataFrame) -> np.ndarray:
    """Ids by falling count, ties by id. Its length is the vocabulary's, whatever the corpus."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                c = np.frombuffer(x, np.int64)
                out = c if out is None else out + c
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["c"])

    # one step of Python: two on end in a task would take two workers, each of which then keeps an encoder
    rows = encoded.where("kind = 1").select(F.col("ids").alias("c")).coalesce(8).mapInArrow(lean(total), "c binary").collect()
    if not rows:
        return np.zeros(0, np.int64)
    c = sum(np.frombuffer(r.c, np.int64) for r in rows)
    return np.lexsort((np.arange(len(c)), -c))


# ---- the format ---------------------------------------------------------------------------------------------------

HEAD = struct.Struct("<4sIQQ")
MAGIC = b"LLT1"
#: Bytes taken by each of the four ids of a control byte.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned values under 2 ** 32."""
    v = values.astype("<u4")
    size = 1 + (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = size - 1
    q = padded.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def shard(doc_ids: list[int | None], lengths: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    none = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join([HEAD.pack(MAGIC, len(doc_ids), len(ranks), len(data)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), none, np.array(lengths, "<u4").tobytes(), control, data])


def unshard(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ranks)."""
    magic, docs, n, size = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = HEAD.size
    ids = np.frombuffer(blob, "<i8", docs, at)
    none = np.frombuffer(blob, np.uint8, docs, at := at + 8 * docs)
    lengths = np.frombuffer(blob, "<u4", docs, at := at + docs)
    control = np.frombuffer(blob, np.uint8, -(-n // 4), at := at + 4 * docs)
    data = np.frombuffer(blob, np.uint8, size, at + len(control))
    return [None if x else i for i, x in zip(ids.tolist(), none)], lengths, unpack(control, data, n)


def export_shard(row, path: str) -> None:
    with open(path, "wb") as f:
        f.write(row.payload)


def write(encoded: DataFrame, rank_of: np.ndarray, path: str, order: list[str] | None = None) -> None:
    """Write shards in ascending order (doc_id, unless other columns of `encoded` are named) below path."""
    spark = encoded.sparkSession
    to_rank = np.empty(len(rank_of), np.uint32)
    to_rank[rank_of] = np.arange(len(rank_of), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(to_rank)
    dtype = np.uint16 if len(rank_of) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        blobs: list = []
        part, n = -1, 0

        def flush(k: int) -> pa.RecordBatch:
            r = shared.value[np.frombuffer(b"".join(blobs), dtype)]
            lengths = [len(b) // dtype().itemsize for b in blobs]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([len(r)], pa.int64()), pa.array([shard(ids, lengths, r)], pa.binary())], ["part", "k", "n_ids", "payload"])

        k = 0
        for b in batches:
            part = b.column(2)[0].as_py()
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(d)
                blobs.append(x)
                n += len(x) // dtype().itemsize
                if n >= SHARD_IDS:
                    yield flush(k)
                    ids, blobs, n, k = [], [], 0, k + 1
        if ids:
            yield flush(k)

    order = order or ["doc_id"]
    rows = encoded.where("kind = 0").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    rows = rows.sortWithinPartitions(*order, F.xxhash64("ids"), "ids").select("doc_id", "ids", "part")
    rows.mapInArrow(lean(run), "part int, k int, n_ids long, payload binary").write.option("compression", "none").parquet(f"{path}/shards")
    held(spark, ids=pa.array([rank_of.astype("<u4").tobytes()], pa.binary())).coalesce(1).write.parquet(f"{path}/ranks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode the shards below path: doc_id, start, n_tokens, ids_crc32."""
    rank_of = np.frombuffer(spark.read.parquet(f"{path}/ranks").first().ids, "<u4")
    shared = spark.sparkContext.broadcast(rank_of)
    shards = spark.read.schema("part int, k int, n_ids long, payload binary").parquet(f"{path}/shards")
    #: what comes before a shard: whole parts (a row for each), then shards of its own part; no task sees all shards
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "ahead")
    own = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "k", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("own")).join(before, "part").select("part", "k", (F.col("ahead") + F.col("own")).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, k, blob in zip(*(b.column(i).to_pylist() for i in range(3))):
                docs, lengths, ranks = unshard(blob)
                ids = shared.value[ranks].astype("<u4") if len(ranks) else ranks
                ends = np.cumsum(lengths.astype(np.int64))
                crc = [zlib.crc32(ids[x:y]) for x, y in zip((ends - lengths).tolist(), ends.tolist())]
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([k] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["part", "k", "doc_id", "at", "n_tokens", "ids_crc32"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = shards.select("part", "k", "payload").mapInArrow(lean(run), "part int, k int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "k"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, path: str | None = None, out: str | None = None, as_laid_out: bool = False) -> DataFrame:
    """Encode docs, write them below `out` (the scratch folder by default) and return what reading them back gives.

    as_laid_out: keep the order in which the part files of docs hold the rows, rather than that of doc_id; docs must be
    read from Parquet files that Spark wrote. No rows give no rows. Columns other than doc_id and text are ignored."""
    spark = tuned(docs.sparkSession)
    if as_laid_out:
        file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), file.alias("file"), F.col("_metadata.row_index").alias("place"))
    else:
        rows = texts(docs).select("doc_id", "text", F.lit(None).cast("long").alias("file"), F.lit(None).cast("long").alias("place"))
    encoded = materialise(encode(rows, path), "ids", "zstd")
    ranks = ranking(encoded)
    out = out or scratch_path(spark, "tokens")
    write(encoded, ranks, out, ["file", "place"] if as_laid_out else None)
    drop_scratch(encoded)
    return read(spark, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


NAME, ORACLE = "op6_token_ids", None
