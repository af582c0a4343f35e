"""Session settings, shared scratch space and graph components for the operators here."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; the kernels cut a batch further, by bytes.
BATCH_ROWS = "1000"
#: Bytes of a row group of scratch tables: writers and readers hold one at a time.
ROW_GROUP = 8 << 20
_roots: dict[str, str] = {}


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches keep a worker's memory bounded when rows are long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone when the interpreter ends
        pass


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which all executors share.

    Without that setting only a session on one machine gets a folder of its own; a cluster's would write where others can't read."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
            base = f"file://{tempfile.gettempdir()}/lumenlake-scratch"
        _roots[app] = root = f"{base.rstrip('/')}/lumenlake-{app}"
        atexit.register(_remove, spark, root)
    return _roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, n: int, onto: DataFrame | None = None) -> DataFrame:
    """Like materialise(), as a table of n buckets by key: joins and groups by the key need no shuffle of such tables.

    onto, a table that this function gave for the same key and n, gets the rows too, and is returned with them."""
    spark = df.sparkSession
    path, known = (onto.scratch_path, onto.scratch_name) if onto is not None else (scratch_path(spark, name), f"lumenlake_{name}_{uuid.uuid4().hex}")
    df.repartition(n, key).write.mode("append").bucketBy(n, key).sortBy(key).option("path", path).option("compression", "none").option("parquet.block.size", ROW_GROUP).saveAsTable(known)
    if onto is None:
        atexit.register(_forget, spark, known)
    out = spark.table(known)
    out.scratch_path, out.scratch_name = path, known
    return out


def _forget(spark: SparkSession, known: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {known}")
    except Exception:  # the session may have ended
        pass


def drop_scratch(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing reads it any more."""
    _remove(df.sparkSession, df.scratch_path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer referenced."""
    for _ in range(2):  # the first lets go of Python's references, the second of what they held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A small table of what the driver holds. From Arrow the JVM reads it; rows of Python would go through Python workers of their own."""
    return spark.createDataFrame(pa.table(columns))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else docs carries; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_mod(n: int) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def _trim() -> None:
    """Give memory that is free back to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow, after whose task the worker keeps no memory that it doesn't use."""

    @functools.wraps(fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _trim()

    return run


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None and out.num_rows:
                yield out

    return run


# ---- connected components ---------------------------------------------------------------------------------------


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each node that has an edge, root the smallest node it reaches by the edges given."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars with the same components as a partition's edges; folded every million edges, so memory stays bounded."""
    a, b, n = [], [], 0

    def fold() -> None:
        nonlocal a, b, n
        node, root = spanning(np.concatenate(a), np.concatenate(b))
        keep = node != root
        a, b, n = [node[keep]], [root[keep]], 0

    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n >= 1_000_000:
            fold()
    if a:
        fold()
        yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(b[0])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges(a, b): component is the smallest node that links reach.

    Alternates large-star and small-star steps (Kiveris et al., 2014). A step takes the least neighbour of each
    node by a pre-aggregated group-by and joins it back, so that a node with very many links is no single group."""
    spark = edges.sparkSession
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct()
    now = materialise(now.mapInArrow(lean(_contract), "a long, b long"), "edges")
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.u).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = down.join(low, down.a == low.u).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = materialise(small, "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_scratch(now)
        now = new
        if before is not None and tuple(state) == before:
            break
        before = tuple(state)
    out = now.groupBy("a").agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("a")).distinct().join(out.select("a"), "a", "left_anti").withColumn("component", F.col("a"))
    return out.union(roots).withColumnRenamed("a", "node")
