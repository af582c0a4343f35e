"""Source divergence audit: how the words of each source of a language differ from those of the others.

Terms are integers: the kept terms of a language are laid out as sorted arrays, range by range, and a term's id is its place,
found by searchsorted. Ids ascend as the terms' UTF-8 bytes do, so a bincount by source and id is a dense block of counts
of a range, probabilities and divergences are arithmetic on such blocks, and ties go to the lower id.

Each task counts terms of its texts by language and source (Arrow dictionaries, so told apart by all bytes) and hands on
sums; these are added, and sorted by language and term into ranges. A task walks through its ranges and writes blocks of at
most TERMS kept terms or ENTRIES counts. Totals come from the blocks; a second walk gives the divergence of each two
sources within a block, for SOURCES x SOURCES sources at a time, and the ten best terms of each source. Nothing is held whole: not the vocabulary,
not a source, not a language; only the totals of a language's sources are (the result itself is quadratic in them).

Terms are runs of letters A-Z, a-z and of all characters beyond ASCII; A-Z alone is lower-cased. Null text, lang and source
are ''. A language keeps the terms that at least MIN_DOCS of its rows hold. All arithmetic is exact: p is divided out in three steps of three
digits, which 64 bits hold for fewer than 9e15 terms. Rows that repeat count each; doc_id and other columns are not looked at.
Groups without terms are in the result, by their 2s alone; with no kept terms pairs have 0. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import drop_scratch, lean, materialise, table, tuned

MIN_DOCS, TOP = 10, 10
#: Bytes of texts counted together; kept terms and counts of a block; sources held against each other at a time; rows that a task sums before it hands them on; parts that the blocks of a language are dealt to.
CHUNK, TERMS, ENTRIES, SOURCES, HELD, SALTS = 4 << 20, 8192, 1 << 20, 256, 1 << 20, 64
_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SCALE = 1_000_000_000


def share(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(1e9 * (count + 2) / (total + 2 * kept)), exactly."""
    d = total + 2 * kept
    q, r = np.divmod(count.astype(np.int64) + 2, d)
    for _ in range(3):
        r *= 1000
        q = q * 1000 + r // d
        r %= d
    return q + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(all terms of the texts, a dictionary array; the row of each)."""
    inside = _TERM[data]
    before = np.concatenate([[False], inside[:-1]])
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    letters = K.LOWER[data[inside]]
    ends = np.concatenate([np.cumsum(inside)[start] - 1, [len(letters)]]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.utf8(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return terms.dictionary_encode(), np.searchsorted(offsets, start, "right") - 1


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (rows that hold it), to be added up; docs(lang, source, text) without nulls."""

    def count(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for a, b, data, offsets in K.chunks(batch.column(2), CHUNK):
            if not len(data):
                continue
            terms, row = _terms(data, offsets)
            size = len(terms.dictionary)
            if not size:
                continue
            held, n = np.unique(row * size + terms.indices.to_numpy(), return_counts=True)
            row, term = held // size, held % size
            named = dict.fromkeys(own := list(zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist())))
            langs, sources = (pa.array(x) for x in zip(*named))
            number = {g: i for i, g in enumerate(named)}
            of = np.array([number[g] for g in own])
            key, at = np.unique(of[row] * size + term, return_inverse=True)
            g = pa.array(key // size)
            yield pa.table({"lang": langs.take(g), "source": sources.take(g), "term": terms.dictionary.take(pa.array(key % size)), "n": np.bincount(at, n).astype(np.int64), "d": np.bincount(at)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        held = 0

        def add(parts: list[pa.Table]) -> pa.Table:
            out = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("d", "sum")])
            return out.select(["lang", "source", "term", "n_sum", "d_sum"]).rename_columns(["lang", "source", "term", "n", "d"])

        for batch in batches:
            for t in count(batch):
                parts.append(t)
                held += t.num_rows
                if held > HELD:
                    parts = [add(parts)]
                    held = parts[0].num_rows
                    if held > HELD // 2:
                        yield from parts[0].combine_chunks().to_batches(10_000)
                        parts, held = [], 0
        if parts:
            yield from add(parts).combine_chunks().to_batches(10_000)

    return docs.mapInArrow(lean(run), "lang string, source string, term string, n long, d long")


def blocks(sums: DataFrame, least: int) -> DataFrame:
    """lang, first (term), terms (sorted), sources, totals, and cells (source x terms + term id) with their counts, of sums(lang, source, term, n, d) sorted by lang and term."""
    kind = "lang string, first string, terms array<string>, sources array<string>, totals array<bigint>, cells binary, counts binary"
    names = ["lang", "first", "terms", "sources", "totals", "cells", "counts"]

    def block(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """The block of rows of one lang, all rows of each term among them."""
        head = np.flatnonzero(_changed(t["term"].combine_chunks()))
        head = head[np.add.reduceat(t["d"].to_numpy(), head) >= least]
        if not len(head):
            return
        terms = t["term"].combine_chunks().take(pa.array(head))
        row = np.flatnonzero(np.asarray(pc.is_in(t["term"].combine_chunks(), value_set=terms)))
        ids = np.searchsorted(head, row, "right") - 1
        t = t.take(pa.array(row))
        sources = t["source"].combine_chunks().unique()
        cells, n = np.asarray(pc.index_in(t["source"].combine_chunks(), value_set=sources)).astype(np.int64), t["n"].to_numpy()
        totals = np.zeros(len(sources), np.int64)
        np.add.at(totals, cells, n)
        yield pa.RecordBatch.from_arrays([t["lang"].slice(0, 1).combine_chunks(), terms.slice(0, 1), _listed(terms), _listed(sources), _listed(pa.array(totals)), pa.array([(cells * len(terms) + ids).tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def split(t: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
            """(whole blocks, what is left): cut where lang changes, and before a term once there is enough."""
            other = _changed(t["lang"].combine_chunks())
            new = other | _changed(t["term"].combine_chunks())
            heads = np.flatnonzero(new)
            out, a = [], 0
            ends = np.append(heads[1:], t.num_rows) if last else heads[1:]
            since = 0
            for h, e in zip(heads.tolist(), ends.tolist()):
                if other[h] and h > a:
                    out.append(t.slice(a, h - a))
                    a, since = h, 0
                since += 1
                if since >= TERMS or e - a >= ENTRIES:
                    out.append(t.slice(a, e - a))
                    a, since = e, 0
            if last and a < t.num_rows:
                out.append(t.slice(a))
                a = t.num_rows
            return out, t.slice(a)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= 1 << 17:
                whole, rest = split(pa.concat_tables(held).combine_chunks(), False)
                for t in whole:
                    yield from block(t)
                held, rows = [rest], 0
        if held:
            for t in split(pa.concat_tables(held).combine_chunks(), True)[0]:
                yield from block(t)

    return sums.mapInArrow(lean(run), kind)


def _changed(x: pa.Array) -> np.ndarray:
    """Where a value is another than that before it; the first is."""
    out = np.ones(len(x), bool)
    if len(x) > 1:
        out[1:] = ~np.asarray(pc.equal(x.slice(1), x.slice(0, len(x) - 1)))
    return out


def _listed(x: pa.Array) -> pa.Array:
    """One list of all of x."""
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _found(held: DataFrame, top: int) -> DataFrame:
    """kind 0: source, item (a source after it), value of a pair within a block, to be added up; kind 1: source, item (a term), value of its best.

    held: a block with its language's sources (sorted), their totals, and the number of kept terms."""
    names = ["kind", "lang", "source", "item", "value"]

    def pairs(lang: str, sources: list[str], p: np.ndarray, a: int, q: np.ndarray, b: int) -> Iterator[pa.RecordBatch]:
        left, right, value = [], [], []
        for i in range(len(p)):
            k = max(0, a + i + 1 - b)
            if k < len(q):
                f = np.concatenate([apart(p[i], q[x : x + 16]).sum(1) for x in range(k, len(q), 16)])
                left += [sources[a + i]] * len(f)
                right += sources[b + k : b + len(q)]
                value.append(f)
        if left:
            n = len(left)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array([lang] * n), pa.array(left), pa.array(right), pa.array(np.concatenate(value))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                lang, terms, own, cells, counts_, sources, totals, kept, total = (batch.column(i)[r].as_py() for i in range(9))
                width = len(terms)
                cell, count = np.frombuffer(cells, np.int64), np.frombuffer(counts_, np.int64)
                number = {s: i for i, s in enumerate(sources)}
                owner = np.array([number[s] for s in own])[cell // width]
                cell = cell % width

                def part(a: int) -> tuple[np.ndarray, np.ndarray]:
                    some = sources[a : a + SOURCES]
                    here = (owner >= a) & (owner < a + SOURCES)
                    n = np.zeros((len(some), width), np.int64)
                    n[owner[here] - a, cell[here]] = count[here]
                    return n, np.stack([share(n[i], totals[a + i], kept) for i in range(len(some))])

                of_all = np.zeros(width, np.int64)
                np.add.at(of_all, cell, count)
                whole = share(of_all, total, kept)
                for a in range(0, len(sources), SOURCES):
                    n, p = part(a)
                    yield from pairs(lang, sources, p, a, p, a)
                    for b in range(a + SOURCES, len(sources), SOURCES):
                        yield from pairs(lang, sources, p, a, part(b)[1], b)
                    src, item, value = [], [], []
                    for i in range(len(n)):
                        ok = np.flatnonzero((n[i] > 0) & (p[i] > whole))
                        f = apart(p[i][ok], whole[ok])
                        best = np.lexsort((ok, -f))[:top]
                        src += [sources[a + i]] * len(best)
                        item += [terms[k] for k in ok[best].tolist()]
                        value.append(f[best])
                    if src:
                        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(src), np.int8)), pa.array([lang] * len(src)), pa.array(src), pa.array(item), pa.array(np.concatenate(value))], names)

    return held.mapInArrow(lean(run), "kind byte, lang string, source string, item string, value long")


def divergence(docs: DataFrame, least: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    tuned(docs.sparkSession)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    sums = counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    sums = materialise(sums, "sums")
    ranged = sums.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    built = materialise(blocks(ranged, least), "blocks")
    drop_scratch(sums)
    groups = docs.select("lang", "source").distinct()
    own = built.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("total"))
    groups = groups.join(own, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    groups = materialise(groups, "groups")
    # a row for each language, with a number for each of its sources
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("s"), F.sum("total").alias("all"))
    kept = built.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    langs = langs.join(kept, "lang").select("lang", F.col("s.source").alias("all_sources"), F.col("s.total").alias("all_totals"), "kept", "all")
    # a language may hold most blocks: its row goes to SALTS places
    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = built.withColumn("salt", F.pmod(F.hash("first"), F.lit(SALTS))).join(salted, ["lang", "salt"]).select("lang", "terms", "sources", "cells", "counts", "all_sources", "all_totals", "kept", "all")
    found = materialise(_found(held, top), "found")
    one_way = found.where("kind = 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = one_way.union(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    terms = found.where("kind = 1").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(w))
    terms = terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return pairs.union(terms)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


NAME = "op12_divergence"
ORACLE = r"""
with d as (select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source, coalesce("text", '') txt from documents),
t as materialized (select rid, lang, source, unnest(regexp_extract_all(translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
k as materialized (select lang, term, count(*) n from t group by lang, term having count(distinct rid) >= 10),
g as materialized (select distinct lang, source from d),
c as materialized (select t.lang, t.source, t.term, count(*) n from t join k on t.lang = k.lang and t.term = k.term group by t.lang, t.source, t.term),
v as (select lang, count(*) v, sum(n) n from k group by lang),
s as (select lang, source, sum(n) n from c group by lang, source),
gn as (select g.lang, g.source, coalesce(s.n, 0) n from g left join s on g.lang = s.lang and g.source = s.source),
p as materialized (select gn.lang, gn.source, k.term, coalesce(c.n, 0) n,
    cast(1 + (1000000000 * cast(coalesce(c.n, 0) + 2 as hugeint)) // (gn.n + 2 * v.v) as bigint) p, cast(1 + (1000000000 * cast(k.n + 2 as hugeint)) // (v.n + 2 * v.v) as bigint) q
  from gn join v on gn.lang = v.lang join k on gn.lang = k.lang left join c on c.lang = gn.lang and c.source = gn.source and c.term = k.term),
f as (select a.lang, a.source, b.source item, cast(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as bigint) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pair as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f.f, 0) "value" from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
term as (select lang, source, 'term' part, term item, ((p - q) * (p - q)) // (p + q) "value" from p where n > 0 and p > q)
select lang, source, part, item, "value", cast(row_number() over (partition by lang, source order by "value" desc, item) as integer) "rank" from pair
union all
select * from (select lang, source, part, item, "value", cast(row_number() over (partition by lang, source order by "value" desc, item) as integer) "rank" from term) x where "rank" <= 10
"""
