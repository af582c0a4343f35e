"""Quality classifier by positive-unlabelled learning.

Features are shares and counts of a whole text (symbols, repeats, capitals, line and word lengths). A linear model
minimises the non-negative unbiased risk (Kiryo et al., 2017): trusted positives are training rows labelled 1, a sample
of at most POSITIVES of them by least hash; the unlabelled text is every row without a label, and the class prior is the share of
ones among training labels. The risk, its gradient and its curvature over the unlabelled rows are sums that tasks work out, so each
step of Newton's method is a pass over their features; steps of several lengths are held against each other in one more. Every text is scored.

Null texts count as empty ones and are scored as such. A doc_id that stands twice is scored twice; labels with a null
doc_id or quality are ignored, of contradicting labels the lower holds. If all rows carry labels, the training rows are the
unlabelled text. Without a positive training label, or without rows, nothing is fitted: all scores
are the prior (0.5 if there are no labels at all), and `fitted` is false. Ties of the hash go by doc_id and features. A very long text is one row
of shares like any other. No rows give no rows. Columns besides doc_id and text are ignored, clashing names too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import crc_mod, lean, materialise, per_batch, table, tuned

#: Most labelled rows that the model is fitted on.
POSITIVES = 6_000
#: Steps of Newton's method at most, lengths that a step is tried in, weights of the squared weights, and change of the risk that ends it.
STEPS, LENGTHS, RIDGES, ENOUGH = 15, 0.5 ** np.arange(8), 1e-3 * 4.0 ** np.arange(9), 1e-6
#: Rows of a block of features, tasks that sums of tasks meet in, and blocks that are added up without tasks if there are no more.
PACKED, MEET, FEW = 4096, 16, 16
THRESHOLD = 0.7
FEATURES = 16
_b = np.arange(256)
UPPER, LETTER, DIGIT = (_b >= 65) & (_b <= 90), ((_b | 32) >= 97) & ((_b | 32) <= 122), (_b >= 48) & (_b <= 57)
ALNUM = LETTER | DIGIT | (_b >= 128)
SYMBOL = ~ALNUM & ~K.SPACE
PLAIN = np.isin(_b, [ord(c) for c in ".,;:!?'\")-"])
STOPS = np.isin(_b, [ord(c) for c in ".!?"])


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES numbers for each row."""
    rows = len(offsets) - 1
    s, e, first = K.words(data, offsets)
    n = np.maximum(np.diff(first), 1)
    size = np.maximum(np.diff(offsets), 1)

    def by_word(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x)])[first])

    def by_byte(lut: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(lut[data], dtype=np.int64)])[offsets])

    out = np.zeros((rows, FEATURES))
    if len(s):
        h = K.span_hash(K.LOWER[data], s, e)
        row = np.repeat(np.arange(rows), np.diff(first))
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (row[1:] == row[:-1])])
        order = np.lexsort((h, row))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])])
        distinct = np.bincount(row[order][new], minlength=rows)
        last, length = data[e - 1], e - s
        shout = (length > 1) & (last == 33) & (data[np.maximum(e - 2, 0)] == 33)
        letters = by_byte(LETTER)
        lines = by_byte(np.arange(256) == 10) + 1
        for k, x in enumerate([
            by_word(SYMBOL[last] & ~PLAIN[last]) / n, by_word(shout) / n, by_word((length == 1) & SYMBOL[last]) / n, by_word(again) / n,
            np.log1p(n / np.maximum(distinct, 1)) / 3, by_byte(UPPER) / np.maximum(letters, 1), by_byte(DIGIT) / size, by_byte(SYMBOL) / size,
            by_word(length) / n / 10, by_word(length <= 3) / n, np.log1p(n) / 10, np.log1p(n / lines) / 8,
            by_word(UPPER[data[s]]) / n, by_word(length >= 13) / n, by_word(STOPS[last]) / n, 1.0 * (np.diff(first) == 0),
        ]):
            out[:, k] = x
    else:
        out[:, -1] = 1
    return out


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, rid, x of each row of docs(doc_id, rid, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.concatenate([features(d, o) for _, _, d, o in K.chunks(b.column(2))])
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES), pa.int32()), pa.array(x.ravel()))], ["doc_id", "rid", "x"])

    return docs.mapInArrow(lean(per_batch(run)), "doc_id long, rid long, x array<double>")


def widen(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(x, 0))], 1)


def packed(x: DataFrame) -> DataFrame:
    """part, body: blocks of features of rows x(x), in the order of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for b in batches:
            f = np.asarray(b.column(0).flatten())
            for k in range(0, len(f), PACKED * FEATURES):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f[k : k + PACKED * FEATURES].tobytes()], pa.binary())], ["part", "body"])

    return x.select("x").mapInArrow(lean(run), "part long, body binary")


def summed(blocks: DataFrame | list[bytes], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of of(features) over all blocks, added up in the tasks, then in MEET of them, then here; a list of blocks is added up here."""
    if isinstance(blocks, list):
        parts = [of(np.frombuffer(x).reshape(-1, FEATURES)) for x in blocks]
        return sum(parts) if parts else None

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part = None, 0
        for b in batches:
            for p, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = of(np.frombuffer(body).reshape(-1, FEATURES))
                out, part = (got, p) if out is None else (out + got, part)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["part", "body"])

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int64()), pa.array([sum(np.frombuffer(x) for _, x in rows).tobytes()], pa.binary())], ["part", "body"])

    kind = "part long, body binary"
    got = blocks.mapInArrow(lean(first), kind).repartition(MEET, "part").mapInArrow(then, kind).collect()  # MEET rows
    return sum(np.frombuffer(r.body) for r in sorted(got)) if got else None


def fit(positive: np.ndarray, unlabelled: DataFrame, prior: float) -> dict | None:
    """Weights that minimise prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) with the logistic loss l.

    unlabelled: blocks of packed(). The risk without the max() is convex and minimised as it is. Where its second part comes out
    negative, few positives were learnt by heart, and the ridge grows until it isn't: then both risks are one."""
    wide = widen(positive)
    few = unlabelled.limit(FEW + 1).collect()
    unlabelled = [bytes(r.body) for r in few] if len(few) <= FEW else unlabelled
    moments = summed(unlabelled, lambda x: np.concatenate([[len(x)], widen(x).sum(0), (widen(x) ** 2).sum(0)]))
    if moments is None or not len(positive):
        return None
    k = wide.shape[1]
    n = moments[0]
    total = n + len(wide)
    mean = (moments[1 : k + 1] + wide.sum(0)) / total
    scale = np.sqrt(np.maximum((moments[k + 1 :] + (wide**2).sum(0)) / total - mean**2, 0)) + 1e-3
    ready = lambda x: np.append(np.clip((widen(x) - mean) / scale, -8, 8), np.ones((len(x), 1)), 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    p = ready(positive)
    bare = np.append(np.ones(k), 0)
    w = np.zeros(k + 1)

    def slope(w: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            u = ready(x)
            s = sigmoid(u @ w)
            return np.concatenate([(u * s[:, None]).sum(0), ((u * (s * (1 - s))[:, None]).T @ u).ravel()])

        return summed(unlabelled, of) / n

    def losses(ws: np.ndarray) -> np.ndarray:
        """E_u[l(-g)] for each column of weights."""
        return summed(unlabelled, lambda x: np.logaddexp(0, ready(x) @ ws).sum(0)) / n

    def risk(ws: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
        """The unbiased risk of each column of weights with its ridge, and the part of it that is of negatives."""
        g = p @ ws
        negative = losses(ws) - prior * np.logaddexp(0, g).mean(0)
        return prior * np.logaddexp(0, -g).mean(0) + negative + ridge * (bare[:, None] * ws**2).sum(0), negative

    for ridge in RIDGES:
        now, negative = risk(w[:, None], ridge)
        for _ in range(STEPS):
            got = slope(w)
            # the loss of a positive less that of a negative is the score itself
            grad = got[: k + 1] - prior * p.mean(0) + 2 * ridge * bare * w
            step = np.linalg.solve(got[k + 1 :].reshape(k + 1, k + 1) + np.diag(2 * ridge * bare + 1e-9), grad)
            tried = w[:, None] - step[:, None] * LENGTHS
            after, negatives = risk(tried, ridge)
            best = int(np.argmin(after))
            if not after[best] < now[0] - ENOUGH:
                break
            w, now, negative = tried[:, best], after[[best]], negatives[[best]]
        if negative[0] >= 0:
            break
    return {"w": w, "mean": mean, "scale": scale}


def predict(model: dict | None, prior: float, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), prior)
    z = np.append(np.clip((widen(x) - model["mean"]) / model["scale"], -8, 8), np.ones((len(x), 1)), 1) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def least(df: DataFrame, n: int) -> np.ndarray:
    """The features of the n rows of least hash: a bounded sample that does not depend on the partitions."""
    rows = df.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(n).select("x").toArrow().column(0).combine_chunks()
    return np.asarray(rows.flatten()).reshape(-1, FEATURES)


def quality(docs: DataFrame, labels: DataFrame, rid: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, fitted for each row of docs; rid: a column of long numbers that goes along."""
    tuned(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(rid) if rid else F.lit(0)).cast("long").alias("rid"), text)
    x = materialise(featured(rows), "quality")
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    train = marks.where(crc_mod(4) != 2)
    ones, total = train.agg(F.coalesce(F.sum("quality"), F.lit(0)), F.count("*")).first()
    prior = min(0.97, max(0.03, ones / total)) if total else 0.5
    model = None
    if ones:
        positive = least(x.join(train.where("quality = 1"), "doc_id", "left_semi"), POSITIVES)
        rest = x.join(marks, "doc_id", "left_anti")
        if not rest.limit(1).count():  # all rows carry labels: without them, the training rows are the unlabelled text
            rest = x.where(crc_mod(4) != 2)
        model = fit(positive, materialise(packed(rest), "unlabelled"), prior)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        f = np.asarray(b.column(2).flatten()).reshape(-1, FEATURES)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(predict(model, prior, f))], ["doc_id", "rid", "score"])

    scored = x.mapInArrow(lean(per_batch(run)), "doc_id long, rid long, score double")
    told = [(crc_mod(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.lit(model is not None).alias("fitted")]
    return scored.select("doc_id", *(["rid"] if rid else []), *told)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


NAME, ORACLE = "op5_quality", None
