"""Toxicity by classifier chains.

Categories are predicted in order; each linear model sees, besides the words, the probabilities of the categories
before it. While training, those are out-of-fold predictions, so that a later model learns how reliable an earlier one
is on texts it hasn't seen. Words count by presence: a word and its first 4 to 8 bytes are hashed, and the SELECTED
hashes that tell the categories apart best (by a signed G statistic over the training sample) become inputs, beside
the shares that the quality classifier uses.

The labelled table marks low quality and toxicity only, so the registered chain is low_quality, then toxic; any list
of 0/1 columns can be given. The models are fitted on the SAMPLE labelled rows of least hash at most; every text is
scored. Null texts count as empty. Rows of a repeated doc_id are each scored; null labels are ignored, of repeated
labels the highest holds. A category without both kinds of examples gets its share as a constant (0 without labels).
A score of exactly 0.5 counts as toxic. Very long texts are read whole. No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import quality as Q
from .common import crc_mod, lean, materialise, per_batch, table, texts, tuned

SAMPLE, SELECTED, BITS, FOLDS = 8_000, 768, 18, 3
PREFIXES = (4, 5, 6, 7, 8)
CHAIN = ("low_quality", "toxic")


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and of its prefixes; words are runs of letters, Latin capitals folded."""
    low = K.LOWER[data]
    if len(low) > 1:
        accent = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][accent] += 32
    s, e, first = K.words(np.where(Q.LETTER[low] | (low >= 128), low, np.uint8(32)), offsets)
    if not len(s):
        z = np.zeros(0, np.int64)
        return z, z
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows, out = [row], [K.span_hash(low, s, e)]
    start = K.eights(low)[s]
    for n in PREFIXES:
        longer = e - s > n
        rows.append(row[longer])
        out.append(K.mix(start[longer] << np.uint64(64 - 8 * n) ^ np.uint64(n)))
    return np.concatenate(rows), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def _present(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, h = hashed(data, offsets)
    both = np.unique(row << BITS | h)
    return both >> BITS, both & ((1 << BITS) - 1)


def select(rows: DataFrame, names: list[str]) -> np.ndarray:
    """The hashes that separate the categories best. Counts are tables of a fixed size, added up by partition."""
    k = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((k + 1, 1 << BITS), np.int32)
        for b in batches:
            y = np.array([b.column(2 + j).to_numpy() for j in range(k)]).reshape(k, -1) == 1
            for a, z, d, o in K.chunks(b.column(1)):
                row, h = _present(d, o)
                c[k] += np.bincount(h, minlength=1 << BITS).astype(np.int32)
                for j in range(k):
                    c[j] += np.bincount(h[y[j][a:z][row]], minlength=1 << BITS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary())], ["c"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((k + 1, 1 << BITS), np.int32)
        for b in batches:
            for x in b.column(0).to_pylist():
                c += np.frombuffer(x, np.int32).reshape(k + 1, -1)
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary())], ["c"])

    part = rows.select("doc_id", "text", *names).mapInArrow(lean(count), "c binary").coalesce(4).mapInArrow(lean(total), "c binary")
    c = sum(np.frombuffer(r.c, np.int32).reshape(k + 1, -1).astype(np.int64) for r in part.collect())
    n = np.array(rows.agg(F.count("*"), *(F.sum(x) for x in names)).first()).astype(float)
    chosen = []
    for j in range(k):
        with np.errstate(divide="ignore", invalid="ignore"):
            a, m, p = c[j].astype(float), c[k].astype(float), n[1 + j] / n[0]
            g = a * np.log(a / (m * p)) + (m - a) * np.log((m - a) / (m * (1 - p)))
            g = np.where(a == 0, m * np.log(1 / (1 - p)), np.where(a == m, m * np.log(1 / p), g))
        g = np.where(m >= 3, np.nan_to_num(g, nan=0, posinf=0, neginf=0), 0)
        best = np.argsort(-g, kind="stable")[: SELECTED // k]
        chosen.append(best[g[best] > 0])
    return np.unique(np.concatenate(chosen))


def inputs(data: np.ndarray, offsets: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Presence of the selected hashes, then the shares."""
    row, h = hashed(data, offsets)
    at = place[h]
    out = np.zeros((len(offsets) - 1, n), np.float32)
    hit = at >= 0
    out[row[hit], at[hit]] = 1
    return np.concatenate([out, Q.widen(Q.features(data, offsets)).astype(np.float32)], 1)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.3, steps: int = 200) -> np.ndarray:
    """Weights and bias of a ridge logistic regression, by accelerated gradient steps with restarts."""
    x = np.append(x, np.ones((len(x), 1), x.dtype), 1)
    n = len(x)
    v = np.random.default_rng(0).normal(size=x.shape[1]).astype(x.dtype)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * float(np.linalg.norm(x @ v)) ** 2 * 1.1 / n + l2 / n)
    w = np.zeros(x.shape[1], x.dtype)
    z, t = w.copy(), 1.0
    for _ in range(steps):
        g = x.T @ ((1 / (1 + np.exp(-np.clip(x @ z, -30, 30))) - y) / n).astype(x.dtype) + l2 / n * z
        new = (z - step * g).astype(x.dtype)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if g @ (new - w) > 0:
            t2, z = 1.0, new
        else:
            z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def apply(models: list[dict], x: np.ndarray) -> np.ndarray:
    """A column of probabilities for each link of the chain."""
    z = (x - models[0]["mean"]) / models[0]["scale"] if len(models) and "mean" in models[0] else x
    done: list[np.ndarray] = []
    for m in models:
        if "w" not in m:
            done.append(np.full(len(x), m["share"]))
            continue
        w = m["w"].astype(np.float64)
        done.append(sigmoid(z @ w[: z.shape[1]] + sum(4 * p * w[z.shape[1] + i] for i, p in enumerate(done)) + w[-1]))
    return np.array(done).T.reshape(len(x), len(models))


def fit_chain(x: np.ndarray, y: np.ndarray) -> list[dict]:
    """One model for each column of y; a later one sees earlier probabilities, out of fold while it trains."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.02)
    mean[: -2 * Q.FEATURES], scale[: -2 * Q.FEATURES] = 0, 1  # presence stays 0 or 1
    z = ((x - mean) / scale).astype(np.float32)
    fold = np.arange(len(x)) % FOLDS
    models: list[dict] = []
    earlier: list[np.ndarray] = []
    for j in range(y.shape[1]):
        t = y[:, j]
        if t.min() == t.max():
            models.append({"share": float(t[0]), "mean": mean, "scale": scale})
            earlier.append(np.full(len(t), float(t[0])))
            continue
        full = np.concatenate([z, *(4 * p[:, None] for p in earlier)], 1).astype(np.float32)
        out = np.zeros(len(t))
        for f in range(FOLDS):
            w = logistic(full[fold != f], t[fold != f])
            out[fold == f] = sigmoid(full[fold == f] @ w[:-1] + w[-1])
        models.append({"w": logistic(full, t), "mean": mean, "scale": scale})
        earlier.append(out)
    return models


def toxicity(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN, train: F.Column | None = None) -> DataFrame:
    """doc_id, a score for each category of the chain, and toxic 0/1 by the last one, for each row of docs.

    labels: doc_id and a 0/1 column for each category; train: which of its rows may be learnt from (all by default)."""
    spark = tuned(docs.sparkSession)
    docs, k = texts(docs), len(chain)
    marks = labels.where(" and ".join(f"`{c}` is not null" for c in ("doc_id", *chain))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(c).cast("int").alias(c) for c in chain))
    marks = (marks if train is None else marks.where(train)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = materialise(docs.join(F.broadcast(marks), "doc_id").select("doc_id", "text", *chain), "toxicity")
    models: list[dict] = [{"share": 0.0} for _ in chain]
    place, n = np.full(1 << BITS, -1, np.int32), 0
    if sample.limit(1).count():
        chosen = select(sample, list(chain))
        n = len(chosen)
        place[chosen] = np.arange(n)
        held = spark.sparkContext.broadcast(place)

        def gather(b: pa.RecordBatch) -> pa.RecordBatch:
            x = np.concatenate([inputs(d, o, held.value, n) for _, _, d, o in K.chunks(b.column(1))]).astype("<f4")
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), *(b.column(2 + j) for j in range(k))], ["doc_id", "x", *chain])

        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
        rows = sample.mapInArrow(lean(per_batch(gather)), "doc_id long, x binary, " + ", ".join(f"`{c}` int" for c in chain)).orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(SAMPLE).toArrow()
        x = np.frombuffer(b"".join(rows.column("x").to_pylist()), "<f4").reshape(rows.num_rows, -1)
        models = fit_chain(x, np.array([rows.column(c).to_numpy() for c in chain], float).T)
    shared = spark.sparkContext.broadcast((place, models))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        place, models = shared.value
        p = np.concatenate([apply(models, inputs(d, o, place, n)) for _, _, d, o in K.chunks(b.column(1), 1 << 20)])
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, j]) for j in range(k))], ["doc_id", *(f"p_{c}" for c in chain)])

    out = docs.mapInArrow(lean(per_batch(run)), "doc_id long, " + ", ".join(f"`p_{c}` double" for c in chain))
    return out.withColumn("score", F.col(f"p_{chain[-1]}")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 4 is not 2, as the quality query does, so that held-out accuracy can be told."""
    labels = table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    return toxicity(table(spark, sf_dir, "documents"), labels, CHAIN, crc_mod(4) != 2)


NAME, ORACLE = "op10_toxicity", None
