"""The ten operators on small tables: brute force, round trips, and the cases that inputs can hold."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import decontamination, hnsw, jaccard, katz, mixing, pii, quality, suffix_dedup, token_ids, toxicity
from lumenlake.llm.common import components, table
from lumenlake.llm.queries import QUERIES

D = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^ \t\n\v\f\r]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, cls string, spans string"
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
ODD = [(1, "the same short text of nine words in all", "en", "a", 1, 1, "x", "y"), (1, "the same short text of nine words in all", "en", "a", 1, 1, "x", "y"), (2, None, None, None, None, None, None, None), (3, "", "en", "b", 0, 0, "", ""), (None, "a text without an id but with words", "en", "b", 0, 0, "", ""), (5, LONG, "en", "a", 1, 1, "", ""), (6, LONG + " end", "en", "a", 1, 1, "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, D, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


OPERATORS = {
    "suffix": lambda s, d: suffix_dedup.dedup(d), "pii": lambda s, d: pii.personal(d), "jaccard": lambda s, d: jaccard.similar(d),
    "quality": lambda s, d: quality.quality(d, table(s, D, "labels")), "tokens": lambda s, d: token_ids.token_ids(d),
    "katz": lambda s, d: katz.katz(d, F.coalesce(F.col("doc_id") == 3, F.lit(False))), "mixing": lambda s, d: mixing.mix(d),
    "decontamination": lambda s, d: decontamination.decontaminate(d, table(s, D, "benchmark")), "toxicity": lambda s, d: toxicity.toxicity(d, table(s, D, "labels").withColumn("low_quality", 1 - F.col("quality"))),
}


def _by_id(rows, *names):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.doc_id].append(tuple(r[n] for n in names) if len(names) > 1 else r[names[0]])
    return dict(out)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    """Nulls, empty and very long texts, repeated rows and clashing columns have the results that the docstrings state."""
    out = OPERATORS[name](spark, spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(out) == (len(ODD) - 1 if name == "decontamination" else len(ODD))
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0
    size = {i: len((t or "").encode()) for i, t, *_ in ODD}
    if name == "suffix":
        got = _by_id(out, "n_bytes", "kept")
        assert {i: x[0][0] for i, x in got.items()} == size and [bytes(k) for _, k in got[1]] == [ODD[0][1].encode()] * 2
        assert len(got[5][0][1]) < 400 and len(got[6][0][1]) < 400
    elif name == "pii":
        assert _by_id(out, "spans") == {1: ["", ""], 2: [""], 3: [""], None: [""], 5: [""], 6: [""]}
    elif name == "jaccard":
        got = _by_id(out, "n_shingles", "component_id")
        assert (got[1], got[2], got[3]) == ([(5, 1), (5, 1)], [(0, 2)], [(0, 3)]) and got[5][0][1] == got[6][0][1] == 5 and got[None][0][1] is None
    elif name == "quality":
        got = _by_id(out, "score", "predicted")
        assert got[1][0] == got[1][1] and got[2] == got[3] and all(0 <= s <= 1 and p == (s >= 0.7) for x in got.values() for s, p in x)
    elif name == "tokens":
        got = sorted(out, key=lambda r: r.start)
        assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 5, 6] and [r.n_tokens for r in got[3:5]] == [1, 1]
        assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:])) and got[3].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())
    elif name == "katz":
        got = _by_id(out, "held_out", "n_tokens", "n_known", "score")
        assert got[1][0] == got[1][1] and got[2][0][:3] == (False, 1, 1) and got[3][0][:3] == (True, 1, 1) and got[5][0][1] == 40_001
    elif name == "mixing":
        assert {r.source for r in out} == {"", "a", "b"} and sorted(r.slot for r in out)[0] == 0 and all(r.block >= 0 for r in out)
    elif name == "decontamination":
        assert all(r.n_items == 0 and not r.contaminated for r in out)
    elif name == "toxicity":
        got = _by_id(out, "score", "predicted")
        assert got[1][0] == got[1][1] and got[2] == got[3] and all(0 <= s <= 1 for x in got.values() for s, _ in x)


def test_results_on_texts_longer_than_a_chunk(spark):
    """One text over the megabyte that kernels work on at a time, its copy, and one that ends otherwise."""
    r = np.random.default_rng(12)
    words = ["".join(map(chr, r.integers(97, 123, r.integers(3, 9)))) for _ in range(3000)]
    long = " ".join(words[i] for i in r.integers(0, 3000, 260_000))
    assert len(long) > 1 << 20
    d = spark.createDataFrame([(1, long), (2, long), (3, long + " and an end"), (4, "short")], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in jaccard.similar(d).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    from tokenizers import Tokenizer

    want = {i: len(Tokenizer.from_file(token_ids.vocabulary()).encode(t, add_special_tokens=False).ids) + 1 for i, t in ((1, long), (4, "short"))}
    got = {x.doc_id: x.n_tokens for x in token_ids.token_ids(d).collect()}
    assert (got[1], got[2], got[4]) == (want[1], want[1], want[4])
    assert {x.doc_id: (len(x.kept) < 400, x.n_bytes) for x in suffix_dedup.dedup(d).collect()} == {1: (True, len(long)), 2: (True, len(long)), 3: (True, len(long) + 11), 4: (True, 5)}


def test_mixing_against_brute_force(spark):
    """Places of texts by running totals in the order of the hash, slots by the schedule of the whole."""
    r = np.random.default_rng(4)
    rows = [(i, "x" * int(r.integers(0, 900)), "abc"[int(r.integers(0, 12)) % 3 if i % 3 else 0]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = {x.doc_id: x for x in mixing.mix(d, weights, block=2000).collect()}
    h = {x.doc_id: x.h for x in d.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    slots = mixing.shares(weights)
    plan = mixing.schedule(slots)
    last = {}
    for s in "abc":
        total = 0
        for i, t, _ in sorted((x for x in rows if x[2] == s), key=lambda x: h[x[0]]):
            block = total // 2000
            want = block // slots[s] * sum(slots.values()) + plan[s][block % slots[s]]
            assert (got[i].source, got[i].block, got[i].slot) == (s, block, want), i
            total += len(t) + 1
        blocks = -(-total // 2000)
        last[s] = blocks // slots[s] * sum(slots.values()) + plan[s][blocks % slots[s]]
    assert all(x.in_mix == (x.slot < min(last.values())) for x in got.values())


def test_base_spans_against_an_independent_scan(spark):
    """Base spans of all texts of the small table, scanned by other means: candidates by characters, judged one by one."""
    d = "/root/testdata/sf0.01"
    found = {}
    for r in pii.personal(table(spark, d, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone").collect():
        found[r.doc_id] = (r.n_email, r.n_ip, r.n_card, r.n_phone)

    def ends(text, start, ok):
        while start < len(text) and text[start] in ok:
            start += 1
        return start

    digits = set("0123456789")
    for r in table(spark, d, "documents").select("doc_id", "text").collect():
        t, n = r.text or "", [0, 0, 0, 0]
        name, host = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
        at = 0
        while (k := t.find("@", at)) >= 0:
            e = ends(t, k + 1, host)
            parts = 0
            while e > k + 1 and e < len(t) and t[e] == "." and ends(t, e + 1, host) > e + 1:
                e, parts = ends(t, e + 1, host), parts + 1
            n[0] += k > at and t[k - 1] in name and parts > 0
            at = e if k > at and t[k - 1] in name and parts else k + 1
        at = 0
        while at < len(t):  # numbers of four parts
            if t[at] not in digits:
                at += 1
                continue
            e, parts = ends(t, at, digits), [at]
            first = e
            while len(parts) < 4 and e + 1 < len(t) and t[e] == "." and t[e + 1] in digits:
                parts.append(e + 1)
                e = ends(t, e + 1, digits)
            if len(parts) == 4:
                n[1] += all(int(t[a : ends(t, a, digits)]) <= 255 for a in parts)
            at = e if len(parts) == 4 else first
        at = 0
        while at < len(t):  # digits with single spaces or hyphens between
            if t[at] not in digits:
                at += 1
                continue
            e = at + 1
            while e < len(t) and (t[e] in digits or t[e] in " -" and e + 1 < len(t) and t[e + 1] in digits):
                e += 1 if t[e] in digits else 2
            number = [int(c) for c in t[at:e] if c in digits]
            double = [2 * x - 9 * (2 * x > 9) for x in number[-2::-2]]
            n[2] += 14 <= len(number) <= 19 and (sum(double) + sum(number[::-2])) % 10 == 0
            at = e
        at = 0
        while (k := t.find("+", at)) >= 0:
            at = k + 1
            if k + 1 < len(t) and t[k + 1] in digits:
                e = ends(t, k + 2, digits | set(" ().-"))
                while e > k + 2 and t[e - 1] not in digits:
                    e -= 1
                if e - 1 > k + 2:
                    n[3] += 10 <= sum(c in digits for c in t[k:e]) <= 15
                    at = e
        assert found[r.doc_id] == tuple(n), r.doc_id


def test_toxicity_by_class_and_files_of_shards(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.toxic for r in table(spark, d, "labels").collect()}
    got = {r.doc_id: r.predicted for r in QUERIES["op10_toxicity"](spark, d).collect()}
    toxic, clean = [i for i, t in marks.items() if t and i in got], [i for i, t in marks.items() if not t and i in got]
    assert np.mean([got[i] for i in toxic]) > 0.6 and np.mean([got[i] for i in clean]) < 0.03
    blob = token_ids.shard([7, None, 9], [3, 0, 2], np.array([1, 300, 70_000, 2, 5], np.uint32))
    row = type("Row", (), {"payload": blob})
    token_ids.export_shard(row, str(tmp_path / "shard"))
    ids, lengths, ranks = token_ids.unshard((tmp_path / "shard").read_bytes())
    assert (ids, lengths.tolist(), ranks.tolist()) == ([7, None, 9], [3, 0, 2], [1, 300, 70_000, 2, 5])


def test_vectors_odd_and_empty(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [1.0, None], 0), (6, [1.0, float("nan")], 0), (None, [1.0, 0.0], 0), (7, [1.0, 0.0, 0.0], 0), (1, [1.0, 0.0], 0), (8, [0.0, 1.0], 0)]
    schema = "vec_id long, embedding array<float>, label int"
    out = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in hnsw.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert out == [(0, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8)]
    assert hnsw.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    e = rng.integers(0, 400, (300, 2)).tolist() + [[500 + i, 501 + i] for i in range(60)]
    low = {x: x for p in e for x in p}
    for _ in range(len(low)):
        for a, b in e:
            low[a] = low[b] = min(low[a], low[b])
    want = {x: c for x, c in low.items() if any(x in p and p[0] != p[1] for p in e)}
    assert {r.node: r.component for r in components(spark.createDataFrame(e, "a long, b long")).collect()} == want


def test_factor_arrays():
    rng = np.random.default_rng(1)
    for _ in range(40):
        t = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 50)).astype(np.uint8)
        b = t.tobytes()
        sa, _, lpf = suffix_dedup.suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        for i in range(len(b)):
            assert lpf[i] == max([0, *(next((k for k in range(len(b) - i) if b[i + k] != b[j + k]), len(b) - i) for j in range(i))])


def _covered(b, size, repeated):
    """Bytes of b in a window of `size` that `repeated` says is one."""
    gone = np.zeros(len(b) + 1, int)
    for i in range(len(b) - size + 1):
        if repeated(b[i : i + size]):
            gone[i] += 1
            gone[i + size] -= 1
    return np.cumsum(gone[:-1]) > 0


@pytest.mark.parametrize("keep,hot,report", [("none", 2000, None), ("none", 1, 300), ("first", 2000, 300), ("none", 2000, 300)])
def test_suffix_dedup(spark, docs, rows, monkeypatch, keep, hot, report):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = {r.doc_id: (bytes(r.kept), r.n_repeated) for r in suffix_dedup.dedup(docs, keep=keep, report=report).collect()}
    count, short, seen = collections.Counter(), collections.Counter(), set()
    for _, t in rows:
        b = t.encode()
        count.update(b[i : i + 400] for i in range(len(b) - 399))
        short.update(b[i : i + (report or 400)] for i in range(len(b) - (report or 400) + 1))
    for doc, t in sorted(rows):
        b = t.encode()

        def repeated(w):
            old = w in seen
            seen.add(w)
            return count[w] > 1 if keep == "none" else old

        kept = bytes(np.frombuffer(b, np.uint8)[~_covered(b, 400, repeated)])
        assert got[doc][0] == kept, doc
        if report or keep == "none":
            assert got[doc][1] == _covered(b, report or 400, lambda w: short[w] > 1).sum(), doc


def test_suffix_dedup_of_a_hot_passage_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 3000)
    monkeypatch.setattr(suffix_dedup.K, "CHUNK", 2500)
    r = np.random.default_rng(8)
    words = lambda n: " ".join("".join(map(chr, r.integers(97, 123, r.integers(2, 9)))) for _ in range(n))
    passage, other, short = words(90), words(75), words(55)[:330]
    texts = [words(30) + passage[: len(passage) - i % 7] + words(40) if i % 3 == 0 else words(60) for i in range(60)]
    texts += [words(2000) + other + words(700) + passage + words(900), other + words(20), words(9) + short + words(12), short, "", passage, passage]
    rows = list(enumerate(texts))
    got = {x.doc_id: (bytes(x.kept), x.n_repeated) for x in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), report=300).collect()}
    for size, check in ((400, lambda b, c, g: bytes(np.frombuffer(b, np.uint8)[~c]) == g[0]), (300, lambda b, c, g: c.sum() == g[1])):
        count = collections.Counter(t[i : i + size] for _, t in rows for i in range(len(t) - size + 1))
        for doc, t in rows:
            assert check(t.encode(), _covered(t.encode(), size, lambda w: count[w.decode()] > 1), got[doc]), (size, doc)


# words of the Thue-Morse sequence and its complement: a polynomial hash modulo 2 ** 64 takes them for one
def _thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_hashes_tell_thue_morse_words_apart(spark, n):
    x, y = _thue_morse(n)
    assert len({int(h) for h in token_ids.K.word_hashes(*token_ids.K.buffers(pa.array([x, y])))[0]}) == 2
    rows = [(1, x), (2, y), (3, f"{x} {x}"), (4, f"{y} {x}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.similar(d).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    known = {r.doc_id: r.n_known for r in katz.katz(d.where("doc_id < 3"), F.col("doc_id") == 2).collect()}
    assert known == {1: 2, 2: 1}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_ids.vocabulary())
    got = {r.doc_id: r.ids_crc32 for r in token_ids.token_ids(d).collect()}
    assert got == {i: zlib.crc32(np.array([*t.encode(s, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, s in rows}
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(d).collect()}
    count = collections.Counter(s[i : i + 400] for _, s in rows for i in range(len(s) - 399))
    for i, s in rows:
        assert kept[i] == bytes(np.frombuffer(s.encode(), np.uint8)[~_covered(s.encode(), 400, lambda w: count[w.decode()] > 1)])


def test_jaccard(spark, docs, rows):
    got = {r.doc_id: r for r in jaccard.similar(docs).collect()}
    sets = {}
    for doc, t in rows:
        w = WORD.findall(t.translate(LOW))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    low = {d: d for d in sets}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    assert all((got[d].n_shingles, got[d].component_id) == (len(sets[d]), low[d]) for d in ids)


def test_tokens_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(token_ids.vocabulary()), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_ids.token_ids(docs).collect()}
    for doc, text in sorted(rows):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert got[doc] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    odd = ["", "  ", "a  b\n\n c \n", "don't 'tis ''s 3.14., x).. \u201cq\u201d.,", "<|endoftext|> hi", "a\u00a0 b\u2003c", "\u00e9. \u00d7. \u65e5\u672c \u8a9e\u3002 ,., ."]
    _, _, data, offsets = next(token_ids.K.chunks(pa.array(odd)))
    assert [r.tolist() for r in token_ids.encoder(token_ids.vocabulary()).rows(data, offsets)] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in odd]
    v = np.random.default_rng(2).integers(0, 2**32, 1001, dtype=np.uint64) >> np.random.default_rng(3).integers(0, 32, 1001).astype(np.uint64)
    control, body = token_ids.pack(v)
    assert (token_ids.unpack(np.frombuffer(control, np.uint8), np.frombuffer(body, np.uint8), len(v)) == v).all()


def test_katz_against_brute_force(spark):
    texts = ["a b c a b d", "a b a b c", "b c d d d a", "c a", "", "A b zz", "d d d d d d d d d"]
    got = katz.katz(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("doc_id") == 5).collect()
    tokens = {i: [*WORD.findall(t.translate(LOW)), "</s>"] for i, t in enumerate(texts)}
    uni, pair = collections.Counter(), collections.Counter()
    for i, w in tokens.items():
        if i != 5:
            uni.update(w)
            pair.update(zip(["<s>", *w[:-1]], w))
    n = sum(uni.values())
    d = katz.discounts(np.array([sum(c == k for c in pair.values()) for k in range(1, katz.CUT + 2)]))
    p1 = lambda w: (uni[w] + 1) / (n + len(uni) + 1)
    kept = lambda c: c * (d[c - 1] if c <= katz.CUT else 1)

    def p(w, h):
        seen = {x: c for (g, x), c in pair.items() if g == h}
        if not seen:
            return p1(w)
        total, mass = sum(seen.values()), sum(map(kept, seen.values()))
        total += mass >= total - 1e-9
        return kept(seen[w]) / total if w in seen else (1 - mass / total) / (1 - sum(map(p1, seen))) * p1(w)

    for h in ["<s>", "a", "b", "c", "d", "never"]:
        assert abs(sum(p(w, h) for w in [*uni, "one unknown word"]) - 1) < 1e-9
    for r in got:
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in uni for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10(p1(x)) for x in w))
        assert r.score == pytest.approx(sum(np.log10(p(x, h)) for h, x in zip(["<s>", *w[:-1]], w)))


@pytest.mark.parametrize("order", [1, 3, 4])
def test_katz_of_any_order(spark, order):
    texts = ["a b c a b d", "a b a b c", "b c d d d a", "c a", "", "A b zz", "d d d d d d d d d", "a b c a b c a b d"]
    got = katz.katz(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("doc_id") == 5, order).collect()
    tokens = {i: [*["<s>"] * (order - 1), *WORD.findall(t.translate(LOW)), "</s>"] for i, t in enumerate(texts)}
    grams = [collections.Counter(tuple(w[i - m : i + 1]) for j, w in tokens.items() if j != 5 for i in range(order - 1, len(w))) for m in range(order)]
    d = [katz.discounts(np.array([sum(c == k for c in g.values()) for k in range(1, katz.CUT + 2)])) for g in grams]
    uni, n = grams[0], sum(grams[0].values())

    def p(w, h):
        if not h:
            return (uni[w,] + 1) / (n + len(uni) + 1)
        seen = {g[-1]: c for g, c in grams[len(h)].items() if g[:-1] == h}
        if not seen:
            return p(w, h[1:])
        kept = {x: c * (d[len(h)][c - 1] if c <= katz.CUT else 1) for x, c in seen.items()}
        total, mass = sum(seen.values()), sum(kept.values())
        total += mass >= total - 1e-9
        return kept[w] / total if w in seen else (1 - mass / total) / (1 - sum(p(x, h[1:]) for x in seen)) * p(w, h[1:])

    for g in {g[:-1] for g in grams[-1]}:
        assert abs(sum(p(w, g) for w in [*(x for x, in uni), "one unknown word"]) - 1) < 1e-9
    for r in got:
        w = tokens[r.doc_id]
        assert r.score == pytest.approx(sum(np.log10(p(w[i], tuple(w[i - order + 1 : i]))) for i in range(order - 1, len(w))))


def test_pii(spark):
    t = "mail a.b@c.example.com, ip 10.0.0.256 and 10.0.0.25, card 4111 1111 1111 1111, call +1 (743) 555-3824 now"
    got = pii.personal(spark.createDataFrame([(1, t), (2, "no data here in 1999")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone) == (1, 1, 1, 1)
    want = ",".join(f"{k}:{t.index(x)}:{t.index(x) + len(x)}" for k, x in [("email", "a.b@c.example.com"), ("ip", "10.0.0.25,"[:-1]), ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824")])
    want = want.replace(f"ip:{t.index('10.0.0.25')}:{t.index('10.0.0.25') + 9}", f"ip:{t.rindex('10.0.0.25')}:{t.rindex('10.0.0.25') + 9}")
    assert got[0].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[1].spans == ""
    held = pii._examples(pii.labelled(80, seed=99))
    found = pii.viterbi(pii.train(pii.labelled()), [f for f, _ in held])
    assert np.mean(np.concatenate([a == b for a, (_, b) in zip(found, held)])) > 0.97


def test_pii_of_whole_texts():
    model = pii.train(pii.labelled())
    rows = ["we met at noon in the park and looked at the dog", "write to jane at mail dot com please", "", *(f"{'12.5 ' * k}call 555-123-4567 now" for k in range(60, 72)), "é  one\u2003at two\n three "]
    got = pii.added(model, rows, [[]] * len(rows))
    assert got[0] == [] and [rows[1][a:b] for a, _, b in got[1]] == ["jane at mail dot com"]
    for text, spans in zip(rows, got):
        assert "555" not in text or "555-123-4567" in [text[a:b] for a, _, b in spans]
    # what is left out of decoding changes nothing
    texts = [*rows, *("".join(x for x, _ in row) for row in pii.labelled(60, seed=5))]
    for text, spans in zip(texts, pii.added(model, texts, [[]] * len(texts))):
        tokens, at, glued = pii.tokenise(text)
        y = pii.viterbi(model, [pii.feature_ids(tokens, glued)])[0]
        begins = [i for i, k in enumerate(y) if pii.STATES[k][0] == "B"]
        assert [a for a, _, _ in spans] == [at[i][0] for i in begins]


def test_classifiers_held_out(spark):
    d = "/root/testdata/sf0.01"
    marks = {r.doc_id: r for r in table(spark, d, "labels").collect()}
    held = [r for r in QUERIES["op5_quality"](spark, d).collect() if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id].quality for r in held]) > 0.9
    held = [r for r in QUERIES["op10_toxicity"](spark, d).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id].toxic for r in held]) > 0.9


def test_schedule_within_a_block():
    slots = mixing.shares({"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, 128)
    plan = mixing.schedule(slots)
    assert sum(slots.values()) == 128 and sorted(t for s in plan.values() for t in s) == list(range(128))
    for s, n in slots.items():
        for t in range(129):
            assert abs(sum(x < t for x in plan[s]) - t * n / 128) < 1


def test_decontamination(spark):
    item = "If the train to Paris with Alice leaves at 9 and travels 120 km in 2 hours what is its mean speed over the whole way"
    again = "Well. " + item.replace("Paris", "London").replace("Alice", "Bob").replace("120", "450").replace("9", "7") + " ok"
    mixed = "So. " + "If the train to Paris with Paris leaves at 9 and travels 9 km in 2 hours what is its mean price over the whole way"
    docs = spark.createDataFrame([(1, "x " + item), (2, again), (3, mixed), (4, "a clean text about trains and other things that nobody has asked")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    assert {r.doc_id: r.item_ids for r in decontamination.decontaminate(docs, bench).collect()} == {1: [7], 2: [7], 3: [], 4: []}


def test_decontamination_splits_runs():
    value = lambda s: np.array([int(c) for c in s], np.uint64)
    r = np.random.default_rng(3)
    for _ in range(300):
        x, y = r.integers(0, 4, (2, int(r.integers(1, 14)))).astype(np.uint64)
        ok = lambda a, b: len({*zip(x[a:b], y[a:b])} - {(0, 0)}) == len({u for u, v in zip(x[a:b], y[a:b]) if u or v}) == len({v for u, v in zip(x[a:b], y[a:b]) if u or v})  # noqa: B023, E731
        assert decontamination._longest(x, y) == max(b - a for a in range(len(x)) for b in range(a + 1, len(x) + 1) if ok(a, b))
    assert decontamination._longest(value("500005"), value("500006")) == 5


def test_decontamination_of_one_changed_place(spark):
    head, tail = "we all know that each of these boxes holds many red and blue pens and", "so how many pens are there in the boxes when nobody takes any of them away"
    item = f"{head} 5 pens weigh less than 5 books {tail}"
    docs = spark.createDataFrame([(1, f"see {head} 6 pens weigh less than 5 books {tail}"), (2, f"see {head} 7 pens weigh less than 7 books {tail}"), (3, "so how many pens are there in that box of 5 books")], "doc_id long, text string")
    got = {r.doc_id: (r.item_ids, r.longest_run) for r in decontamination.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    whole = len(item.split())
    assert got == {1: ([7], whole - 1 - len(head.split())), 2: ([7], whole), 3: ([], 0)}


def test_decontamination_word_for_word(spark):
    items = {
        1: "What is 12 + 7 * 3 - 4", 2: "Quixotic zebras", 3: "Compute the total of all these given long rows now", 4: "Plain words begin here and then come 1 2 3 4 5 6 7 8 9",
        5: "7 8 15 16 23 42 108 4 8 15 16 23 42 99 98 97",
    }
    texts = {
        1: "he asked What is 12 + 7 * 3 - 4 of us", 2: "there are quixotic ZEBRAS here", 3: "we were told Compute the total of all these given long rows now ok",
        4: "so plain words begin here and then come 1 2 3 4 5 6 7 8 9 and 10", 5: "see 8 15 16 23 42 108 4 8 15 16 23 42 99 or not", 6: "what is 12 + 7 * 3 - 5", 7: "quixotic and zebras", 8: "see 15 16 23 42 108 4 8 15 16 23 42 99 or",
    }
    got = decontamination.decontaminate(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {r.doc_id: r.item_ids for r in got} == {1: [1], 2: [2], 3: [3], 4: [4], 5: [5], 6: [], 7: [], 8: []}


def test_hnsw_against_brute_force(spark):
    r = np.random.default_rng(7)
    x = r.standard_normal((3000, 32))
    x[:700] = x[0] + 0.1 * r.standard_normal((700, 32))  # a large group, not all of it linked
    for i in range(1000, 1400, 4):
        x[i + 1 : i + 4] = x[i] + r.uniform(0, 0.35, (3, 1)) * r.standard_normal((3, 32))
    x = x.astype(np.float32)
    e = spark.createDataFrame([(i + 5, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {q.vec_id: q for q in hnsw.near_duplicates(e).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    n = link.sum(1) - 1
    links = np.array([got[i + 5].n_links for i in range(len(x))])
    assert (links <= n).all() and links.sum() >= 0.99 * n.sum() > 1000
    small = n < 20
    assert links[small].sum() >= 0.99 * n[small].sum() > 100
    low = np.arange(len(x))
    while (new := np.where(link, low, len(x)).min(1)).tolist() != low.tolist():
        low = new
    assert np.mean([got[i + 5].component_id == low[i] + 5 for i in range(len(x))]) > 0.999
    assert all(q.kept == (q.component_id == i) and q.audited_recall >= hnsw.AUDIT for i, q in got.items())


def test_hnsw_audit_sees_small_groups():
    r = np.random.default_rng(1)
    x = r.standard_normal((3000, 24))
    x[:1000] = x[0] + 0.01 * r.standard_normal((1000, 24))  # a third of the rows are near copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    class Narrow:  # finds the links of rows outside the large group at wide beams only
        def __init__(self):
            self.exact = x

        def near(self, q, threshold, beam):
            row, hit = np.nonzero(q @ x.T >= threshold)
            some = (hit < 1000) | (beam >= 100)
            return row[some], hit[some]

    assert hnsw.audit(Narrow(), 0.95) == (192, 1.0)
    # a shard whose rows have no links among themselves is audited too
    y = r.standard_normal((500, 24))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert hnsw.audit(type("Blind", (), {"exact": y, "near": lambda self, q, t, beam: (np.zeros(0, int),) * 2})(), 0.95) == (500, 0.0)


def test_pipeline(spark):
    import corpus_pipeline as C

    out = C.run(spark, D).collect()
    assert out and len({r.doc_id for r in out}) == len(out) < 200
    docs = spark.createDataFrame(ODD, SCHEMA)
    from lumenlake.llm.common import materialise

    for _, f in C.STAGES[:-1]:
        docs = materialise(f(spark, docs, D), "stage")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    C.STAGES[-1][1](spark, docs, D).collect()
