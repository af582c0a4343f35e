"""Personal data: base patterns, and a linear-chain conditional random field over word shapes that adds to them.

The field is trained on the driver, from a small labelled table that labelled() makes by rule, by gradient ascent on
the exact log-likelihood (forward-backward in numpy). It is decoded by Viterbi in numpy batches, over whole texts: the
stretches that provably hold no span of the best path are left out. Its spans are added where they overlap no base span. Offsets count code points, the end exclusive. Null and empty
texts have no spans; each row is judged by itself, so repeated rows give the same answer; of spans that tie or overlap the
base one stays, else the one that begins first. Very long texts are decoded whole. No rows give no rows; other columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table, texts, tuned

KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# ---- the field ------------------------------------------------------------------------------------------------------

STATES = ["O", *(f"{b}-{k}" for k in ("email", "phone", "secret") for b in "BI")]
#: Tokens of the texts that are looked at together, and of the sequences that are decoded together.
BUCKETS, TOKENS, PADDED = 1 << 12, 100_000, 200_000
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
#: words whose identity, not only their shape, is a feature
CUES = {"at", "dot", "token", "key", "password", "secret", "api", "call", "phone", "tel", "mobile", "fax", "mail", "email", "contact", "pwd", "ext"}


def shape(w: str) -> str:
    if w[0].isdigit():
        return f"d{min(len(w), 8)}"
    if not w[0].isalpha():
        return w
    return ("x" if w.islower() else "X" if w.isupper() else "Xx" if w[0].isupper() else "xX") + str(min(len(w), 6)) + ("h" if all(c in "abcdefABCDEF" for c in w) else "")


#: The mark of each piece (a token and the space before it): hash of the shape, hash of the cue word, glued, length of the space, of all.
class Marks(dict):
    def __missing__(self, piece: str) -> tuple[int, int, int, int, int]:
        w = piece.lstrip()
        cue = w.lower() if len(w) < 9 and w.lower() in CUES else ""
        mark = (_code(shape(w)), _code(cue), len(w) == len(piece), len(piece) - len(w), len(piece))
        if len(self) >= 500_000:
            self.clear()
        self[piece] = mark
        return mark


@functools.lru_cache(4096)
def _code(x: str) -> int:
    return zlib.crc32(x.encode()) << 31 | zlib.crc32(x.encode() + b"+") >> 1


PIECE = re.compile(r"\s*(?:" + TOKEN.pattern + ")")
PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
MARKS = Marks()
EDGE = [(_code("^"), _code(""), 0, 0, 0)] * 2, [(_code("$"), _code(""), 0, 0, 0)] * 2


def _bucket(j: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), j, np.uint64)
    for p, x in zip(PRIMES, parts):
        h = (h ^ x) * p
        h ^= h >> np.uint64(29)
    return ((h * PRIMES[0]) >> np.uint64(32)).astype(np.int64) % BUCKETS


def features(marks: np.ndarray) -> np.ndarray:
    """Buckets of the features of each token between two edge marks on either side: shapes around it, cue words around it, whether space is before it."""
    s, c, g = (marks[:, k].astype(np.uint64) for k in range(3))
    n = len(marks) - 4
    S, C, G = (lambda d, x=x: x[2 + d : 2 + d + n] for x in (s, c, g))
    f = [(S(0),), (S(-1), G(0), S(0)), (S(0), G(1), S(1)), (S(-2), S(-1), G(0), S(0)), (S(0), G(1), S(1), S(2)), (C(0),), (C(-1), C(-2)), (C(1), C(2)), (G(0), S(0), G(1))]
    return np.stack([_bucket(j, *x) for j, x in enumerate(f)], 1)


def feature_ids(tokens: list[str], glued: list[bool]) -> np.ndarray:
    """features() of tokens."""
    marks = [MARKS[t if x else " " + t] for t, x in zip(tokens, glued)]
    return features(np.array([*EDGE[0], *marks, *EDGE[1]], np.int64))


def tokenise(text: str) -> tuple[list[str], list[tuple[int, int]], list[bool]]:
    spans = [m.span() for m in TOKEN.finditer(text)]
    return [text[a:b] for a, b in spans], spans, [i > 0 and spans[i - 1][1] == a for i, (a, _) in enumerate(spans)]


def labelled(n: int = 220, seed: int = 7) -> list[list[tuple[str, str]]]:
    """The small labelled table: sentences as (piece of text, kind or 'O')."""
    r = random.Random(seed)
    syllables = "on er the st an in re ou ti ea ha nd le ment eau qui ung sch lich os ar ci de la".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    some = lambda: " ".join(word() for _ in range(r.randint(1, 5)))
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    make = {
        "phone": lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}"]),
        "email": lambda: r.choice([f"{word()} at {word()} dot com", f"{word()}{d(2)} (at) {word()}.org", f"{word()}.{d(2)} at {word()}{d(1)} dot example dot com", f"{word()} @ {word()}.com"]),
        "secret": lambda: f'"{"".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64])))}"',
        "O": lambda: r.choice([some(), some(), f"{r.randint(1900, 2030)}", f"{d(2)} %", f"{d(1)}.{d(2)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(16)}", f"{d(3)}.{d(2)}.{d(3)}.{d(2)}", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"{word()}.{d(2)}@mail{d(1)}.example.com", f"{d(1)},{d(3)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"item {d(3)}", f"{d(4)} {d(4)}", f"{d(3)} {some()}", f"v{d(1)}.{d(1)}.{d(2)}"]),
    }
    cue = {"phone": ["", "call ", "tel: ", "phone "], "email": ["", "mail ", "contact "], "secret": ["token = ", "key = ", "api key: ", "password = "], "O": [""]}
    out = []
    for _ in range(n):
        kinds = [r.choice(["O", "O", "phone", "email", "secret"]) for _ in range(r.randint(1, 2))]
        s = [(some(), "O")]
        for k in kinds:
            s += [(r.choice(cue[k]), "O"), (make[k](), k), (r.choice(["", ".", ",", "###", "!!"]) + " " + some() + r.choice([".", ""]), "O")]
        out.append([(x, k) for x, k in s if x])
    # whole texts are mostly prose, in which cue words, names and quotes stand without personal data; some holds an address in words
    cues = sorted(CUES)
    part = lambda: r.choice([word, word, word, word, word, lambda: word().title(), lambda: word().title(), lambda: "é" + word(), lambda: word() + "ç" + word(), lambda: word() + ",", lambda: word() + ".", lambda: word() + ":", lambda: f'"{word()}"', lambda: r.choice(cues), lambda: "at " + r.choice(["the " + word(), word(), word() + ".", "all"]), lambda: r.choice("aio"), lambda: word() + "-" + word(), lambda: word().upper(), lambda: f"{r.choice(cues)} {word()} {r.choice(cues)}"])()
    prose = lambda: " ".join(part() for _ in range(r.randint(2, 25)))
    for i in range(2 * n):
        out.append([(prose(), "O")] if i % 4 else [])
        if i % 4 < 2:
            out[-1] += [(f"{word()}{r.choice(['', '.' + word()])} {r.choice(['at', 'at', '(at)'])} {r.choice([word(), word(), 'mail', 'email'])}{r.choice([' dot ' + word(), ''])} dot {r.choice(['com', 'org', 'net', word()])}", "email"), (r.choice(["", ".", ","]) + " " + prose(), "O")]
    return out


def _examples(rows: list[list[tuple[str, str]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for row in rows:
        text, marks = "", []
        for piece, kind in row:
            if text and not text.endswith(" ") and piece[0].isalnum() or kind != "O" and text and not text.endswith(" "):
                text += " "
            if kind != "O":
                marks.append((len(text), len(text) + len(piece), kind))
            text += piece
        tokens, spans, glued = tokenise(text)
        y = np.zeros(len(tokens), np.int64)
        for a, b, kind in marks:
            inside = [i for i, (x, z) in enumerate(spans) if a <= x and z <= b]
            for j, i in enumerate(inside):
                y[i] = STATES.index(("I-" if j else "B-") + kind)
        out.append((feature_ids(tokens, glued), y))
    return out


def _pad(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, seqs))
    f = np.full((len(seqs), n, seqs[0].shape[1]), BUCKETS, np.int64)
    for i, s in enumerate(seqs):
        f[i, : len(s)] = s
    return f, np.array([len(s) for s in seqs])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train(rows: list[list[tuple[str, str]]], steps: int = 70) -> dict[str, np.ndarray]:
    """Emission and transition weights that maximise the penalised log-likelihood of the labelled rows."""
    data = _examples(rows)
    f, n = _pad([x for x, _ in data])
    b, t, s = len(data), f.shape[1], len(STATES)
    y = np.full((b, t), -1)
    for i, (_, z) in enumerate(data):
        y[i, : len(z)] = z
    inside = np.arange(t) < n[:, None]
    e, a = np.zeros((BUCKETS + 1, s)), np.zeros((s, s))
    state = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in (("e", e), ("a", a))}
    seen = np.zeros_like(e)
    hot = np.eye(s)
    gold = np.where(inside[..., None], hot[y], 0)
    for k in range(f.shape[2]):
        np.add.at(seen, f[..., k][inside], gold[inside])
    places = f[inside].ravel()
    pairs = inside[:, 1:]
    seen_a = np.zeros_like(a)
    np.add.at(seen_a, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    for step in range(1, steps + 1):
        u = e[f].sum(2)
        alpha = np.empty((b, t, s))
        beta = np.zeros((b, t, s))
        alpha[:, 0] = u[:, 0]
        for i in range(1, t):
            new = _lse(alpha[:, i - 1, :, None] + a, 1) + u[:, i]
            alpha[:, i] = np.where(inside[:, i, None], new, alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            new = _lse(a + (u[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(inside[:, i + 1, None], new, 0)
        z = _lse(alpha[:, -1], 1)
        p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * inside[..., None]
        ge, ga = seen - 0.05 * e, seen_a - 0.05 * a
        flat = p[inside]
        for j in range(s):
            ge[:, j] -= np.bincount(places, np.repeat(flat[:, j], f.shape[2]), BUCKETS + 1)
        both = alpha[:, :-1, :, None] + a + (u[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        ga -= (np.exp(np.minimum(both, 0)) * pairs[..., None, None]).sum((0, 1))
        for key, w, g in (("e", e, ge / b), ("a", a, ga / b)):
            m, v = state[key]
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g**2
            w += 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        e[BUCKETS] = 0
    for i, q in enumerate(STATES):
        if q[0] == "I":
            a[[j for j, x in enumerate(STATES) if x[1:] != q[1:]], i] = -1e4
    return {"e": e, "a": a, "first": np.array([-1e4 if q[0] == "I" else 0.0 for q in STATES])}


def viterbi(model: dict[str, np.ndarray], seqs: list[np.ndarray]) -> list[np.ndarray]:
    """The best states of each sequence of feature rows."""
    n = np.array([len(f) for f in seqs], np.int64)
    if not n.sum():
        return [np.zeros(0, np.int64) for _ in seqs]
    y = decode(model, np.concatenate([model["e"][f].sum(1) for f in seqs if len(f)]), n)
    return np.split(y, np.cumsum(n)[:-1])


def decode(model: dict[str, np.ndarray], u: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best states of sequences of n emissions that stand on end in u; sequences of like length are decoded together."""
    out = np.zeros(len(u), np.int64)
    first = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    lo = 0
    while lo < len(order):
        part = order[lo : lo + max(1, min(1024, PADDED // int(n[order[lo]])))]
        lo += len(part)
        size, t = n[part], int(n[part[0]])
        b, s = len(part), u.shape[1]
        at = np.minimum(first[part][:, None] + np.arange(t), len(u) - 1)
        score, back = u[at[:, 0]] + model["first"], np.zeros((t, b, s), np.int8)
        live = b  # lengths fall: those that go on come first
        for i in range(1, t):
            live = int(np.searchsorted(-size, -i, "left"))
            m = score[:live, :, None] + model["a"]
            back[i, :live] = m.argmax(1)
            score[:live] = m.max(1) + u[at[:live, i]]
        state = score.argmax(1)
        rows = np.arange(b)
        for i in range(t - 1, -1, -1):
            live = int(np.searchsorted(-size, -i, "left"))
            out[at[:live, i]] = state[:live]
            if i:
                state[:live] = back[i, rows[:live], state[:live]]
    return out


def stretches(model: dict[str, np.ndarray], u: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches of tokens outside which the best path is O all along, so that whole texts need not be decoded.

    A span beats O by the sum over its tokens of emission and incoming transition over those of O, and its way out. With
    the best state and transition taken for each token, a token can be in a span that wins only if the best sum over
    some range around it is above 0. Tokens that aren't real (the edges of texts) end every range."""
    a = model["a"]
    inward = np.maximum(a[:, 1:].max(0) - a[0, 0], 0)
    out = max(0.0, float((a[1:, 0] - a[0, 0]).max()))
    gain = np.where(real, (u[:, 1:] + inward).max(1) - u[:, 0], -1e4)
    total = np.concatenate([[0.0], np.cumsum(gain)])
    best = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
    live = np.concatenate([[False], real & (best + out > -1e-6), [False]])
    return np.flatnonzero(live[1:] & ~live[:-1]), np.flatnonzero(live[:-1] & ~live[1:])


def added(model: dict[str, np.ndarray], rows: list[str], known: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to the base spans of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in rows]
    low = 0
    while low < len(rows):
        marks, starts, high = [*EDGE[0]], [], low
        while high < len(rows) and len(marks) < TOKENS:
            starts.append(len(marks))
            marks += map(MARKS.__getitem__, PIECE.findall(rows[high]))
            marks += EDGE[1] + EDGE[0]
            high += 1
        first = np.array(starts)
        m = np.array([*marks, *EDGE[1]], np.int64)
        m[first, 2] = 0
        e, u = model["e"], np.zeros((len(m), len(STATES)))
        for column in features(m).T:
            u[2:-2] += e[column]
        real = m[:, 4] > 0
        ends = np.cumsum(m[:, 4])
        begins = ends - m[:, 4] + m[:, 3]
        a, b = stretches(model, u, real)
        # the neighbours inside the text are O
        before, after = real[a - 1], real[b]
        x = a - before
        n = b + after - x
        stop = np.cumsum(n)
        at = np.repeat(x - (stop - n), n) + np.arange(int(n.sum()))
        v = u[at]
        v[(stop - n)[before], 1:] -= 1e6
        v[(stop - 1)[after], 1:] -= 1e6
        y = decode(model, v, n)
        inside = np.array([q[0] == "I" for q in STATES])[y]
        opens = np.flatnonzero((y > 0) & ~inside)
        if len(opens):
            others = np.append(np.flatnonzero(~inside), len(y))  # a span ends before the next token that doesn't carry it on
            close = others[np.searchsorted(others, opens, "right")] - 1
            row = np.searchsorted(first, at[opens], "right") - 1
            base_at = ends[first[row] - 1]
            kinds = np.array([KINDS.index(q[2:]) if q != "O" else 0 for q in STATES])[y[opens]]
            for r, start, k, end in zip(row.tolist(), (begins[at[opens]] - base_at).tolist(), kinds.tolist(), (ends[at[close]] - base_at).tolist()):
                out[low + r].append((start, k, end))
        low = high
    result = []
    for new, old in zip(out, known):
        ends = sorted((s, e) for s, _, e in old)
        kept = []
        for s, k, e in sorted(set(new)):
            if all(y <= s or x >= e for x, y in ends) and (not kept or kept[-1][2] <= s):
                kept.append((s, k, e))
        result.append(kept)
    return result


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal(docs: DataFrame, rows: list[list[tuple[str, str]]] | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (base and added), n_added for each row of docs."""
    spark = tuned(docs.sparkSession)
    model = spark.sparkContext.broadcast(train(rows or labelled()))
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", "n_added"]
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts_ = b.column(1).to_pylist()
            found = [base(t) if TRIGGER.search(t) else [] for t in texts_]
            more = added(model.value, texts_, found)
            counts = [pa.array([sum(k == j for _, k, _ in f) for f in found], pa.int64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([hashlib.sha256(joined(f).encode()).hexdigest() if f else empty for f in found]), pa.array([joined(sorted(f + m)) for f, m in zip(found, more)]), pa.array([len(m) for m in more], pa.int64())], names)

    return texts(docs).mapInArrow(lean(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal(table(spark, sf_dir, "documents"))


NAME, ORACLE = "op2_pii", None
