"""Vectorised work on the bytes of whole texts: words, hashes, windows. All numpy, no per-word Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that one kernel call works on; a longer text is one call by itself.
CHUNK = 1 << 20
#: The white space of the contracts: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20_240_101)
#: A random 64-bit value for each byte.
BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers, one for each place in a window of words.
PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_UNBASE = pow(BASE, -1, 1 << 64)
_pow = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept and grown by doubling."""
    p = _pow.get(base, np.ones(1, np.uint64))
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
    _pow[base] = p
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; nulls must be gone."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows of about `most` bytes."""
    data, offsets = buffers(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of all words, and by row the index of its first word (one more entry at the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    n = len(data)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    at = offsets[:-1]
    before[at[at < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    at = offsets[1:] - 1
    after[at[at >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray, key: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial sum of the first i bytes; a range's hash is (P[e] - P[s]) / BASE ** s.

    Texts can be made that collide whatever the base (Thue-Morse strings do), so this serves only where equal hashes
    of unlike bytes do no harm."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(key[data] * _powers(BASE, len(data)), out=out[1:])
    return out


#: Ranges up to SHORT bytes are hashed in steps of eight by numpy, longer ones one by one.
SHORT = 64
_LENGTH_KEY, _STEP_KEY = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there on as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(SHORT + 8, np.uint8)])
    return np.ndarray(len(data) + SHORT, "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, unlike for unlike bytes but by chance: each step of eight bytes is mixed with all before it.

    Ranges of one length up to eight never collide."""
    size = ends - starts
    at = eights(data)
    h = mix((at[starts] & _MASK[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _LENGTH_KEY + np.uint64(salt)))
    left = np.flatnonzero(size > 8)
    k = 8
    while len(left) and k < SHORT:
        h[left] = mix(h[left] * _STEP_KEY + (at[starts[left] + k] & _MASK[np.minimum(size[left] - k, 8)]))
        k += 8
        left = left[size[left] > k]
    if len(left):
        raw = data.tobytes()
        for i in left.tolist():
            h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]], seed=salt)
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, index of each row's first word and the number of words at the end)."""
    s, e, first = words(data, offsets)
    return (span_hash(LOWER[data], s, e, salt) if len(s) else np.zeros(0, np.uint64)), first


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i : i + k] for each i that has k words after it; rows are not told apart."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * PLACE[j]
    return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; np.unique hashes them first, which costs more than the sort."""
    x = np.sort(x)
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5, salt: int = 0) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each row; with fewer words the whole sequence is one; without words none."""
    h, first = word_hashes(data, offsets, salt)
    w = window_hashes(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(distinct(w[a : b - k + 1]))
        elif b > a:
            out.append(mix((h[a:b] * PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
