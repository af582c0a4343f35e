"""SentencePiece encoding and decoding by a table of each prefix's last token.

Byte-pair merging gives every text one sequence of tokens, and a sequence is that one exactly if each two neighbours are
what their own two texts merge to. So every prefix of a text has one last token: among the pieces that an automaton finds to
end there, the one that is compatible with the last token of the prefix before it. The table is filled from left to
right, many pieces of text side by side in numpy, and the ids are read off it backwards.

Whether two tokens are compatible follows from how each is merged: going back in time from the two whole tokens, the later
merge at the border is undone, and at each state no merge over the border may come before what consumes either side.
Ties of the score go to the left, as in the library.

A text is cut where two bytes meet that stand side by side in no piece; the distinct runs between are encoded once per worker
and told apart by their bytes. Characters that no piece holds become byte tokens. Models must be merged by score (BPE), have
byte fallback, a leading space and no normalisation; another one is refused.

Null texts are empty, and hold the begin and the end id alone. U+2581 is a space, as in the library. A very long text is
worked on by itself; its runs of over LONG characters one after another, in linear time. Repeated rows and null doc_ids give a row
each. No rows give no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import lean, table, texts, tuned
from .token_ids import Pieces

#: Characters of a run up to which many are encoded side by side, and runs of one such call.
LONG, TOGETHER = 64, 8192
#: Pairs of tokens whose compatibility a worker keeps, as a power of two.
PAIR_BITS = 20
_NEVER = np.int64(1 << 40)
#: A character put between runs that are searched together; no piece of several characters may hold it.
_APART = "\ue000"
#: What a model must encode as the library does before it is used.
PROBES = ["", " ", "  a", "a  b ", "Hello, world! 1234", "\n\tx\r\n", "naïve café 你好 \U0001f600", "aaaaaaaaaaaaaaaaa", "ﬁ １", "<s> </s> <0x0A>"]


def model(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


class Vocabulary:
    """Pieces, how each is merged, and which of them may stand side by side."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), n
        byte_ids = [i for i in range(n) if sp.is_byte(i)]
        if len(byte_ids) != 256 or min(self.begin, self.end) < 0:
            raise ValueError("the model needs byte fallback, a begin and an end id")
        self.byte_id = np.zeros(256, np.int64)
        self.byte_id[[int(sp.id_to_piece(i)[3:5], 16) for i in byte_ids]] = byte_ids
        special = {*byte_ids, *(i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.id = {sp.id_to_piece(i).replace("▁", " "): i for i in range(n) if i not in special}
        if any(c not in self.id or c == _APART for p in self.id if len(p) > 1 for c in p):
            raise ValueError("a piece holds a character that is no piece, or U+E000")
        self.rank = np.zeros(n + 1, np.int64)
        self.rank[:n] = np.unique([-sp.get_score(i) for i in range(n)], return_inverse=True)[1]
        self._derive(n)
        self._pairs(n)
        self._surfaces(n, byte_ids)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.whole[i]:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.seen_key, self.seen = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.seen_one: dict[int, bool] = {}
        self.known = Pieces(np.uint16 if n <= 1 << 16 else np.uint32)
        for t in PROBES:
            if self.ids(t) != sp.encode(t, add_bos=True, add_eos=True):
                raise ValueError("the model is not merged by score, or normalises texts")

    def merged(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """(symbols that a text merges to, the halves of the last merge): best score first, ties to the left."""
        symbols, last = list(text), ("", "")
        while True:
            found = [(self.rank[i], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if (i := self.id.get(a + b)) is not None]
            if not found:
                return symbols, last
            k = min(found)[1]
            last = (symbols[k], symbols[k + 1])
            symbols[k : k + 2] = [last[0] + last[1]]

    def _derive(self, n: int) -> None:
        """birth: rank of the merge that makes a token, -1 if none does; left and right: its halves; whole: whether its own text becomes it."""
        self.birth, self.left, self.right = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.whole, self.odd, self.length = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.ones(n + 1, np.int64)
        self.text: dict[int, str] = {i: p for p, i in self.id.items()}
        for p, i in sorted(self.id.items(), key=lambda x: len(x[0])):
            symbols, halves = self.merged(p)
            self.whole[i], self.length[i] = symbols == [p], len(p)
            if self.whole[i] and len(p) > 1:
                a, b = (self.id[x] for x in halves)
                self.birth[i], self.left[i], self.right[i] = self.rank[i], a, b
                # a token older than its parts breaks the order in time, so such tokens are merged to see
                self.odd[i] = self.odd[a] or self.odd[b] or max(self.birth[a], self.birth[b]) > self.birth[i]

    def _pairs(self, n: int) -> None:
        found = {}
        for p, i in self.id.items():
            for k in range(1, len(p)):
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                if a is not None and b is not None:
                    found[a * (n + 1) + b] = self.rank[i]
        self.size = n + 1
        self.pair = np.array(sorted(found) or [-1], np.int64)
        self.pair_rank = np.array([found.get(int(k), _NEVER) for k in self.pair], np.int64)

    def _surfaces(self, n: int, byte_ids: list[int]) -> None:
        """Bytes that ids stand for, and which two bytes stand side by side in a piece."""
        surface = [b""] * n
        self.joined = np.zeros((256, 256), bool)
        for p, i in self.id.items():
            surface[i] = p.encode()
            for a, b in zip(surface[i], surface[i][1:]):
                self.joined[a, b] = True
        self.joined[:, 0x80:0xC0] = True  # inside a character
        for i in byte_ids:
            surface[i] = bytes([int(self.library.id_to_piece(i)[3:5], 16)])
        self.bytes_ = np.frombuffer(b"".join(surface), np.uint8)
        self.byte_count = np.array([len(s) for s in surface], np.int64)
        self.byte_from = np.cumsum(self.byte_count) - self.byte_count

    # ---- compatibility ---------------------------------------------------------------------------------------

    def _walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        live, x, y = np.arange(len(a)), a.copy(), b.copy()
        eaten_x, eaten_y = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(live):
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            rank = np.where(self.pair[at] == key, self.pair_rank[at], _NEVER)
            crossed = (rank < eaten_x) & (rank <= eaten_y) & (rank < _NEVER)
            ok[live[crossed]] = False
            bx, by = self.birth[x], self.birth[y]
            go = ~crossed & ((bx >= 0) | (by >= 0))
            later_y = by >= bx
            eaten_x, eaten_y = np.where(later_y, eaten_x, bx), np.where(later_y, by, eaten_y)
            x, y = np.where(later_y, x, self.right[x]), np.where(later_y, self.left[y], y)
            live, x, y, eaten_x, eaten_y = live[go], x[go], y[go], eaten_x[go], eaten_y[go]
        for i in np.flatnonzero(self.odd[a] | self.odd[b]).tolist():
            p, q = self.text[int(a[i])], self.text[int(b[i])]
            ok[i] = self.merged(p + q)[0] == [p, q]
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the texts of a and b, put together, merge to a and b."""
        key = a * self.size + b
        slot = (K.mix(key.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.seen[slot]
        miss = np.flatnonzero(self.seen_key[slot] != key)
        if len(miss):
            one, at = np.unique(key[miss], return_inverse=True)
            new = self._walk(one // self.size, one % self.size)
            out[miss] = new[at]
            # pairs that share a slot: each array must end up with the same one of them
            slots, last = np.unique(slot[miss][::-1], return_index=True)
            who = miss[len(miss) - 1 - last]
            self.seen_key[slots], self.seen[slots] = key[who], out[who]
        return out

    def _fits(self, a: int, b: int) -> bool:
        key = a * self.size + b
        if (ok := self.seen_one.get(key)) is None:
            ok = bool(self._walk(np.array([a]), np.array([b]))[0])
            if len(self.seen_one) < 1 << PAIR_BITS:
                self.seen_one[key] = ok
        return ok

    # ---- tables of prefixes ------------------------------------------------------------------------------------

    def _alone(self, run: str) -> list[int]:
        """Ids of one run of characters, however long."""
        last, length = np.full(len(run), self.unknown, np.int32), self.length.tolist()
        for end, t in self.automaton.iter(run):
            before = end - length[t]
            if before < 0 or self._fits(int(last[before]), t):
                last[end] = t
        out, at = [], len(run) - 1
        while at >= 0:
            t = int(last[at])
            out += [t] if t != self.unknown else self.byte_id[[*run[at].encode()]][::-1].tolist()
            at -= length[t]
        return out[::-1]

    def _beside(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids on end, ids of each) of many short runs: their tables are filled place by place, all at once."""
        text = _APART.join(runs) + _APART
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        start = np.cumsum(size + 1) - size - 1
        found = np.fromiter(self.automaton.iter(text), [("end", "i8"), ("t", "i8")])
        end, t = found["end"], found["t"]
        run_of = np.repeat(np.arange(len(runs)), size + 1)
        place = end - start[run_of[end]]
        before = end - self.length[t]
        first = self.length[t] > place
        last = np.full(len(text), self.unknown, np.int64)
        order = np.argsort(place, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            if len(at):
                ok = first[at]
                more = at[~ok]
                ok[~ok] = self.compatible(last[before[more]], t[more])
                last[end[at[ok]]] = t[at[ok]]
        tokens, places, of, cur, live = [], [], [], start + size - 1, np.flatnonzero(size > 0)
        while len(live):
            now = last[cur[live]]
            tokens.append(now)
            places.append(cur[live])
            of.append(live)
            cur[live] -= self.length[now]
            live = live[cur[live] >= start[live]]
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(len(runs), np.int64)
        token, where, of_ = (np.concatenate(x) for x in (tokens, places, of))
        back = np.argsort(where)
        token, where, of_ = token[back], where[back], of_[back]
        if (unknown := np.flatnonzero(token == self.unknown)).size:
            spelt = [self.byte_id[[*text[i].encode()]] for i in where[unknown].tolist()]
            n = np.ones(len(token), np.int64)
            n[unknown] = [len(s) for s in spelt]
            fresh = np.repeat(token == self.unknown, n)
            token, of_ = np.repeat(token, n), np.repeat(of_, n)
            token[fresh] = np.concatenate(spelt)
        return token, np.bincount(of_, minlength=len(runs))

    def runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids on end, ids of each) of runs of characters that no token crosses the ends of."""
        short = [i for i, r in enumerate(runs) if len(r) <= LONG]
        parts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(runs)
        for k in range(0, len(short), TOGETHER):
            some = short[k : k + TOGETHER]
            ids, n = self._beside([runs[i] for i in some])
            for i, x in zip(some, np.split(ids, np.cumsum(n)[:-1])):
                parts[i] = x
        for i, r in enumerate(runs):
            if len(r) > LONG:
                parts[i] = np.array(self._alone(r))
        return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array([len(p) for p in parts], np.int64)

    # ---- whole texts -------------------------------------------------------------------------------------------

    def ids(self, text: str) -> list[int]:
        """Ids of one text, begin and end included."""
        t = text.replace("▁", " ")
        return [self.begin, *(self._alone(" " + t) if t else []), self.end]

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text (with its leading space), begin and end id included, as 32-bit numbers."""
        begin, end = np.array([self.begin], "<u4"), np.array([self.end], "<u4")
        if not len(data):
            return [np.concatenate([begin, end]) for _ in offsets[1:]]
        cut = np.empty(len(data) + 1, bool)
        cut[1:-1] = ~self.joined[data[:-1], data[1:]]
        cut[offsets] = True
        cuts = np.flatnonzero(cut)
        a, b = cuts[:-1], cuts[1:]
        at, keys = self.known.find(data, a, b)
        had = len(self.known.size)
        if (miss := np.flatnonzero(at < 0)).size:
            raw = data.tobytes()
            new: dict[bytes, list[int]] = {}
            for i, x, y in zip(miss.tolist(), a[miss].tolist(), b[miss].tolist()):
                run = raw[x:y]
                if (e := self.known.other.get(run)) is not None:
                    at[i] = e
                else:
                    new.setdefault(run, []).append(i)
            if new:
                runs = list(new)
                ids, n = self.runs([r.decode() for r in runs])
                head = np.array([x[0] for x in new.values()])
                entries = self.known.put(ids, n, tuple(k[head] for k in keys), runs.__getitem__)
                at[np.fromiter((i for x in new.values() for i in x), np.int64)] = np.repeat(entries, [len(x) for x in new.values()])
        n = self.known.size[at].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.known.flat[np.repeat(self.known.first[at] - (ends - n), n) + np.arange(ends[-1])].astype("<u4")
        self.known.cut(had)
        row = np.concatenate([[0], ends])[np.searchsorted(a, offsets)]
        return [np.concatenate([begin, ids[x:y], end]) for x, y in zip(row[:-1].tolist(), row[1:].tolist())]

    def decoded(self, ids: np.ndarray) -> str:
        """What the library's decode(ids) gives: surfaces on end without the leading space; bytes that are no UTF-8 are left to it."""
        ids = np.asarray(ids, np.int64)
        n = self.byte_count[ids]
        ends = np.cumsum(n)
        flat = self.bytes_[np.repeat(self.byte_from[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        try:
            if not (ids == self.library.unk_id()).any():
                return flat.decode().removeprefix(" ")
        except UnicodeDecodeError:
            pass
        return self.library.decode(ids.tolist())


_known: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _known:
        _known[path] = Vocabulary(path)
    return _known[path]


def encode(docs: DataFrame, path: str | None = None, decode: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers, begin and end included) of each row of docs; if decode, their text too."""
    path = model(path)
    tuned(docs.sparkSession)
    text = F.replace("text", F.lit("▁"), F.lit(" "))
    spaced = texts(docs).select("doc_id", F.when(F.col("text") == "", "").otherwise(F.concat(F.lit(" "), text)).alias("text"))
    names = ["doc_id", "n_tokens", "ids"] + ["decoded"] * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column(1)):
                ids = v.rows(data, offsets)
                out = [batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(out + [pa.array([v.decoded(x) for x in ids], pa.string())] * decode, names)

    return spaced.mapInArrow(lean(run), "doc_id long, n_tokens long, ids binary" + ", decoded string" * decode)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and decoded text of each row of encoded(doc_id, ids); null ids are none, and decode to the empty text."""
    path = model(path)
    tuned(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            out = [v.decoded(np.frombuffer(x or b"", "<u4").astype(np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(lean(run), "doc_id long, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents"), decode=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


NAME, ORACLE = "op11_pieces", None
