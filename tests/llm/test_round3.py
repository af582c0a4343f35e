"""Pieces, divergence, codes, and the pipeline's stages by rows: brute force, the library, and the cases that inputs can hold."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from lumenlake.llm import codes, divergence, prefix_pieces
from lumenlake.llm.common import table

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids binary, decoded string, cls string"
ODD = [(1, "a short text", "en", "a", 1, None, "x", "y"), (1, "a short text", "en", "a", 1, None, "x", "y"), (2, None, None, None, None, None, None, None), (3, "", "en", "b", 0, None, "", ""), (None, "no id", "en", "b", 0, None, "", ""), (5, "wörter " * 40_000, "de", "a", 1, None, "", ""), (6, "x" * 100_000 + " 你\U0001f600" * 50 + "\n\t ", "zh", "a", 1, None, "", "")]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=prefix_pieces.model())


def test_pieces_against_the_library(spark, library):
    """All texts of a table, odd ones too: ids and texts are the library's; query and operators agree."""
    rows = [(r.doc_id, r.text or "") for r in table(spark, D, "documents").select("doc_id", "text").collect()]
    want = {i: library.encode(t, add_bos=True, add_eos=True) for i, t in rows}
    got = {r.doc_id: r for r in prefix_pieces.query(spark, D).collect()}
    assert len(got) == len(rows)
    for i, ids in want.items():
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_odd_rows(spark, library):
    out = prefix_pieces.encode(spark.createDataFrame(ODD, DOCS), decode=True).collect()
    assert len(out) == len(ODD) and prefix_pieces.encode(spark.createDataFrame([], DOCS), decode=True).count() == 0
    texts = collections.defaultdict(list)
    for i, t, *_ in ODD:
        texts[i].append(t or "")
    for r in out:
        want = library.encode(texts[r.doc_id][0], add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == library.decode(want) and r.n_tokens == len(want)
    loose = [(1, [5, 200, 201]), (2, []), (3, [1, 259, 2]), (4, [0, 5]), (5, None), (6, library.encode("café"))]
    given = spark.createDataFrame([(i, None if x is None else np.array(x, "<u4").tobytes()) for i, x in loose], "doc_id long, ids binary")
    assert {r.doc_id: r.decoded for r in prefix_pieces.decode(given).collect()} == {i: library.decode(x or []) for i, x in loose}


def test_prefix_tables_on_random_runs(library):
    """Random characters, pieces put together, runs of blanks and of one letter: side by side, alone, and in whole texts."""
    v = prefix_pieces.vocabulary(prefix_pieces.model())
    r = random.Random(3)
    alphabet = " ▁\n\t.,!?abcdeeeeeéñ你好ß\U0001f600́​xyzABC0129<>-_=\"'"
    pieces = list(v.id)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(50))) for _ in range(1500)] + ["".join(r.choice(pieces) for _ in range(20)) for _ in range(500)] + [c * k for c in " a=" for k in (1, 2, 15, 16, 17, 33, 100)]
    for t in texts:
        assert v.ids(t) == library.encode(t, add_bos=True, add_eos=True), t
    short = [t.replace("▁", " ")[: prefix_pieces.LONG] for t in texts if t]
    ids, n = v._beside(short)
    for t, x in zip(short, np.split(ids, np.cumsum(n)[:-1])):
        assert x.tolist() == v._alone(t), t


def test_compatibility_is_what_merging_says():
    v = prefix_pieces.vocabulary(prefix_pieces.model())
    r = np.random.default_rng(1)
    halves = [(v.id[p[:k]], v.id[p[k:]]) for p in list(v.id)[::40] for k in range(1, len(p)) if p[:k] in v.id and p[k:] in v.id]
    blank = [i for p, i in v.id.items() if not p.strip(" ")]
    a, b = (np.concatenate([[x[j] for x in halves], r.choice(list(v.id.values()), 1500), r.choice(blank, 200)]) for j in (0, 1))
    got = v.compatible(a, b)
    assert got.tolist() == [v.merged(v.text[x] + v.text[y])[0] == [v.text[x], v.text[y]] for x, y in zip(a.tolist(), b.tolist())]
    assert (v.compatible(a, b) == got).all() and 0.1 < got.mean() < 0.9


def audit(rows, least):
    """The contract of the divergence, spelt out in whole numbers."""
    found, df, groups = collections.Counter(), collections.Counter(), set()
    for lang, source, text in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups.add((lang or "", source or ""))
        found.update((lang or "", source or "", t) for t in terms)
        df.update((lang or "", t) for t in set(terms))
    out = []
    for lang, source in groups:
        kept = [t for (x, t), n in df.items() if x == lang and n >= least]
        others = [s for x, s in groups if x == lang]
        n = {s: sum(found[lang, s, t] for t in kept) for s in others}
        p = lambda s, t: 1 + 10**9 * (found[lang, s, t] + 2) // (n[s] + 2 * len(kept))
        whole = lambda t: 1 + 10**9 * (sum(found[lang, s, t] for s in others) + 2) // (sum(n.values()) + 2 * len(kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pair = [(o, sum(f(p(source, t), p(o, t)) for t in kept)) for o in others if o != source]
        term = [(t, f(p(source, t), whole(t))) for t in kept if found[lang, source, t] and p(source, t) > whole(t)]
        for part, items, most in (("pair", pair, None), ("term", term, 10)):
            out += [(lang, source, part, i, x, k + 1) for k, (i, x) in enumerate(sorted(items, key=lambda y: (-y[1], y[0].encode()))[:most])]
    return sorted(out)


def test_divergence_against_brute_force(spark, monkeypatch):
    """Random texts with ties, groups without terms, nulls, clashing columns; blocks and groups of sources of the smallest sizes too."""
    r = random.Random(8)
    word = lambda: r.choice(["The", "the", "café", "naïve", "Über", "über", "a", "z", "你", "it's", "x1y", "--", "\U0001f600"]) + r.choice(["", "", "", "s"])
    rows = [(r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "é", "Z", None]), r.choice([None, ""]) if r.random() < 0.1 else " ".join(word() for _ in range(r.randrange(1, 30)))) for _ in range(120)]
    rows += [("en", "bare", "123 --"), ("xx", "one", "éé"), ("xx", "two", None)]
    docs = spark.createDataFrame([(i, *x, 1, "clash", 2) for i, x in enumerate(rows)], "doc_id long, lang string, source string, text string, n long, term string, d int")
    got = lambda **o: sorted(tuple(x) for x in divergence.divergence(docs, **o).collect())
    assert got(least=10) == audit(rows, 10)
    for name, value in (("TERMS", 2), ("SOURCES", 2), ("HELD", 5), ("CHUNK", 64)):
        monkeypatch.setattr(divergence, name, value)
    assert got(least=3) == audit(rows, 3)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_shares_are_exact():
    r = random.Random(2)
    for total in (0, 7, 10**6, 10**12, 8 * 10**15):
        c = np.array([r.randrange(total + 1) for _ in range(50)], np.int64)
        assert divergence.share(c, total, 3).tolist() == [1 + 10**9 * (x + 2) // (total + 6) for x in c.tolist()]


def coded(rows, parts=8, entries=16, rounds=6):
    """The contract of the codes, vector by vector."""
    kept = [(i, lab, [math.floor(4096 * float(np.float32(x))) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, v: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            of = collections.defaultdict(list)
            for _, _, v in kept:
                of[near(p, v)[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(of[k]) for x in zip(*of[k])] if k in of else e for k, e in enumerate(books[p])]
    out, by = [], collections.Counter()
    for i, lab, v in kept:
        found = [near(p, v) for p in range(parts)]
        e = sum(d for d, _ in found)
        by[lab] += e
        out.append((i, "".join(f"{k:02x}" for _, k in found), e, lab))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return collections.Counter((i, c, e, by[lab], digest) for i, c, e, lab in out)


@pytest.mark.parametrize("share", [1000, 3])
def test_codes_against_brute_force(spark, tmp_path, monkeypatch, share):
    """Repeated vectors and parts, a hot one, ties, null and repeated ids, null labels, vectors that are dropped, other columns."""
    monkeypatch.setattr(codes, "SHARE", share)
    r = np.random.default_rng(5)
    base = np.round(r.normal(size=(30, 16)), 1)
    rows = [(int(i), base[0 if i % 3 == 0 else r.integers(30)].tolist(), int(i) % 5 if i % 7 else None) for i in r.permutation(150)]
    rows += [(None, base[1].tolist(), 1), (3, base[2].tolist(), 2), (7, None, 1), (8, [None] + [0.0] * 15, 1), (9, [float("nan")] + [0.0] * 15, 1), (10, [float("inf")] + [0.0] * 15, None), (11, [-0.00001] * 16, 3)]
    spark.createDataFrame([(*x, 1, "y") for x in rows], "vec_id long, embedding array<float>, label int, row int, weight string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = collections.Counter((x.vec_id, x.code, x.error, x.label_error, x.codebooks_sha256) for x in codes.query(spark, str(tmp_path)).collect())
    assert got == coded(rows)


def test_codes_of_few_and_of_unfit_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    frame = lambda *rows: spark.createDataFrame(list(rows), kind)
    assert codes.compress(frame())[0].count() == 0
    out, books = codes.compress(frame((1, [0.5] * 8, 1), (2, [0.5] * 8, 1)))
    assert [(x.vec_id, x.codes, x.error) for x in out.orderBy("vec_id").collect()] == [(1, [0] * 8, 0), (2, [0] * 8, 0)] and books.shape == (8, 2, 1)
    for bad in ([0.5] * 7, [], [1e6] * 8):
        with pytest.raises(ValueError):
            codes.compress(frame((1, bad, 1)))
    with pytest.raises(ValueError):
        codes.compress(frame((1, [0.5] * 8, 1), (2, [0.5] * 16, 1)))


# ---- the pipeline ---------------------------------------------------------------------------------------------------------

SHORT = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_go_by_rows(spark):
    """Rows with one doc_id and unlike texts stay, copies go whatever their ids; against all pairs."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(40)) for _ in range(6)]
    edit = lambda t: " ".join(w if r.random() > 0.01 else "edit" for w in t.split())
    for ids in (lambda k: k, lambda k: r.choice([1, 2, 3, None])):
        rows = [(ids(k), r.choice([edit(r.choice(texts)), " ".join(r.choice(words) for _ in range(12)), None, ""]), "en", "a", k) for k in range(60)]
        sets, root = [shingles(x[1]) for x in rows], list(range(60))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(60):
            for j in range(i):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    root[top(i)] = top(j)
        groups = collections.defaultdict(list)
        for i in range(60):
            groups[top(i)].append(i)
        kept = [x.n_chars for x in C.near_duplicate_stage(spark, spark.createDataFrame(rows, SHORT), D).collect()]
        assert len(kept) == len(set(kept)) == len(groups)
        for g in groups.values():
            (one,) = set(g) & set(kept)
            best = min((rows[i][0] is None, rows[i][0] or 0) for i in g)
            assert (rows[one][0] is None, rows[one][0] or 0) == best


def test_stages_keep_rows_without_a_model_and_empty_tables(spark, tmp_path):
    docs = table(spark, D, "documents").limit(12)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, D, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    table(spark, D, "benchmark").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.quality_stage(spark, docs, str(tmp_path)).count() == 12 == C.decontamination_stage(spark, docs, str(tmp_path)).count()
    assert C.quality_stage(spark, docs.limit(0), D).count() == C.near_duplicate_stage(spark, docs.limit(0), D).count() == 0
    assert C.run(spark, str(tmp_path)).count() == C.near_duplicate_stage(spark, docs, D).count()


def test_null_and_repeated_ids_are_judged_by_their_texts(spark):
    item = next(r.text for r in table(spark, D, "benchmark").collect() if r.text and len(r.text.split()) >= 13)
    rows = [(None, f"before it {item} after it", "en", "a", 1), (None, "clean words that nobody asked about at all", "en", "a", 2), (7, f"again {item}", "en", "a", 3), (7, "other clean words of the same id here", "en", "a", 4)]
    kept = C.decontamination_stage(spark, spark.createDataFrame(rows, SHORT), D).collect()
    assert sorted(r.n_chars for r in kept) == [2, 4] and kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
    larger = "/root/testdata/sf0.01"
    docs, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    worst = C.quality(docs, labels).join(docs.select("doc_id", "text"), "doc_id").where("text <> ''").orderBy("score").first()
    docs = docs.union(spark.createDataFrame([(None, worst.text, "en", "a", -1)], SHORT))
    kept = C.quality_stage(spark, docs, larger)
    assert worst.predicted == 0 and kept.where("n_chars = -1").count() == 0 and kept.where(F.col("doc_id") == worst.doc_id).count() == 0
    assert kept.count() == C.quality(docs, labels).where("predicted = 1").count()
