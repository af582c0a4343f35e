"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Vectors alike in all components are one class, so that a group of exact copies is one node. Classes are dealt to
shards by hash. A shard builds its graph in batches (searches of a batch run together in numpy; neighbours are chosen
by the diversity rule of Malkov and Yashunin, 2018) and audits it: near copies of a sample of its own rows are searched
and held against brute force, and the beam is doubled until AUDIT of the links are found in each class of queries with
like numbers of links, so that a large group doesn't hide what small ones lose; the recall that the audits measured is
returned. Every vector is then searched in every shard; from a beam that is full of links the graph is followed, both ways,
from link to link, so large groups lose no links to its width. Graphs are walked in single precision; cosines of all hits are taken
in double precision and those under the threshold dropped. A task hands on counts
of links, and of the links themselves a spanning forest only; components are joined from the forests.

Vectors that are null, zero, or hold null or non-finite components, and rows without a vec_id, link with nothing (the
component is the row's own vec_id). Rows of a repeated vec_id are vectors of their own. Vectors of different lengths
do not link. Extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, lean, materialise, spanning, table, tuned

#: The audit takes one row in AUDIT_SHARE of a shard, and AUDIT_ROWS at least.
THRESHOLD, AUDIT, AUDIT_ROWS, AUDIT_SHARE = 0.95, 0.995, 128, 32
M, BUILD_BEAM, BEAM, STEP = 12, 40, 24, 4
#: An upper layer of at most so many nodes is searched whole, by a matrix product, and those above it need no walk.
WHOLE = 5000
#: Nodes of the layer above from which a layer is entered.
ENTRIES = 8
#: Vectors of a shard, and the least number of shards.
SHARD_ROWS, SHARDS = 50_000, 6
#: Vectors of a block of queries, and the blocks that a task searches in a shard.
QUERY_ROWS, BLOCKS = 2048, 6
#: Tasks of a shard beyond which each takes more blocks.
SALTS = 8
#: What single precision may take from a cosine.
SLACK = 1e-5
#: Cosines by which a node may miss the threshold and still be followed from a beam that is full of links.
FRINGE = 0.02
#: Hits that a search hands on at once, those whose vectors are compared at once, and cells of a beam search's tables.
HITS, CHUNK, CELLS = 1 << 18, 1 << 14, 1 << 20


def pick(centre: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidate ids (-1: none) the chosen ones, best first: a candidate must be nearer to the centre than to any chosen before it."""
    sim = np.where(ids >= 0, np.einsum("bd,bcd->bc", centre, x[ids]), -np.inf)
    order = np.argsort(-sim, 1, kind="stable")
    ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
    v = x[ids]
    b, c = ids.shape
    near = np.full((b, c), -np.inf)  # of each candidate, to the nearest chosen one
    chosen = np.zeros((b, c), bool)
    count = np.zeros(b, int)
    for k in range(c):
        take = (ids[:, k] >= 0) & (count < most) & (sim[:, k] > near[:, k])
        chosen[:, k] = take
        count += take
        if take.any():
            r = np.flatnonzero(take)
            near[r] = np.maximum(near[r], np.einsum("bd,bcd->bc", v[r, k], v[r]))
    # places left over go to the best of the rest
    rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, 1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, live: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of the beam best nodes found for each query, -1 where there are fewer; entry: a node for each query, or several in a row."""
    b, n = len(q), len(x)
    seen = np.zeros((b, n), bool)
    rows = np.arange(b)
    ids = np.full((b, beam), -1)
    sim = np.full((b, beam), -np.inf)
    fresh = np.zeros((b, beam), bool)
    entry = entry.reshape(b, -1)[:, :beam]
    k = entry.shape[1]
    ids[:, :k], sim[:, :k], fresh[:, :k] = entry, np.einsum("bd,bed->be", q, x[entry]), True
    seen[rows[:, None], entry] = True
    act = rows
    while len(act):
        s = np.where(fresh[act], sim[act], -np.inf)
        step = min(STEP, beam)
        top = np.argpartition(-s, step - 1, 1)[:, :step]
        ok = np.isfinite(np.take_along_axis(s, top, 1))
        go = ok.any(1)
        act, top, ok = act[go], top[go], ok[go]
        if not len(act):
            break
        node = np.take_along_axis(ids[act], top, 1)
        fresh[act[:, None], top] = False
        r, k = np.nonzero(ok)
        near = links[node[r, k]]
        row = np.repeat(act[r], near.shape[1])
        near = near.ravel()
        good = near >= 0
        row, near = row[good], near[good]
        new = ~seen[row, near]
        code = np.unique(row[new] * n + near[new])
        row, near = code // n, code % n
        if not len(row):
            continue
        seen[row, near] = True
        c = np.einsum("bd,bd->b", q[row], x[near])
        floor = sim[row].min(1) if beam > 1 else sim[row, 0]
        keep = c > floor
        row, near, c = row[keep], near[keep], c[keep]
        if not len(row):
            continue
        u, first, count = np.unique(row, return_index=True, return_counts=True)
        width = count.max()
        at = np.arange(len(row)) - np.repeat(first, count)
        inv = np.repeat(np.arange(len(u)), count)
        add_i, add_s = np.full((len(u), width), -1), np.full((len(u), width), -np.inf)
        add_i[inv, at], add_s[inv, at] = near, c
        all_i, all_s = np.concatenate([ids[u], add_i], 1), np.concatenate([sim[u], add_s], 1)
        all_f = np.concatenate([fresh[u], add_i >= 0], 1)
        best = np.argpartition(-all_s, beam - 1, 1)[:, :beam]
        ids[u], sim[u], fresh[u] = (np.take_along_axis(y, best, 1) for y in (all_i, all_s, all_f))
    return ids, sim


def flood(x: np.ndarray, links: np.ndarray, named: tuple[np.ndarray, np.ndarray], q: np.ndarray, ids: np.ndarray, threshold: float) -> np.ndarray:
    """The nodes that reach the threshold among those that links lead to from ids, either way, over nodes that miss it by FRINGE at most.

    named: the nodes that name each node, and where those of each begin. Each node is looked at once, where a beam that is widened to hold n hits costs n steps of its own width."""
    seen = np.zeros(len(x), bool)
    seen[ids] = True
    out, new = [], ids
    while len(new):
        sim = x[new] @ q
        out.append(new[sim >= threshold])
        go = new[sim >= threshold - FRINGE]
        first, n = named[1][go], named[1][go + 1] - named[1][go]
        back = named[0][np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
        new = np.concatenate([links[go].ravel(), back])
        new = np.unique(new[(new >= 0) & ~seen[new]])
        seen[new] = True
    return np.concatenate(out)


class Graph:
    """A navigable small world over unit vectors x; upper layers hold ever fewer of the nodes."""

    def __init__(self, exact: np.ndarray, seed: int = 1):
        self.exact, n = exact, len(exact)
        self.x = x = exact.astype(np.float32)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(M)).astype(int)
        order = np.argsort(-level, kind="stable")
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # (members, links among their places), top first
        for l in range(level.max(initial=0), -1, -1):
            members = order[level[order] >= l]
            self.layers.append((members, self._grow(x[members], 2 * M if l == 0 else M)))
        self._places()

    def _grow(self, x: np.ndarray, most: int) -> np.ndarray:
        n = len(x)
        links = np.full((n, most), -1)
        at = 0
        while at < n:
            size = min(max(32, at // 4), 256, n - at)
            new = np.arange(at, at + size)
            q = x[new]
            beam = min(BUILD_BEAM, max(1, at))
            if at <= 1024:
                s = q @ x[:at].T
                found = np.argsort(-s, 1, kind="stable")[:, :beam] if at else np.zeros((size, 0), int)
            else:
                # places are ordered by level: the first few are spread over the data and serve as entries
                entry = np.argmax(q @ x[:64].T, 1)
                found = beam_search(x[:at], links[:at], q, entry, beam)[0]
            s = q @ q.T
            np.fill_diagonal(s, -np.inf)
            s[np.triu_indices(size)] = -np.inf  # earlier ones of the batch only
            k = min(8, size)
            peers = np.argsort(-s, 1, kind="stable")[:, :k]
            peers = np.where(np.isfinite(np.take_along_axis(s, peers, 1)), peers + at, -1)
            links[new] = np.pad(p := pick(q, np.concatenate([found, peers], 1), x, min(M, most)), ((0, 0), (0, most - p.shape[1])), constant_values=-1)
            self._back(x, links, new, most)
            at += size
        self._reach(links)
        return links

    @staticmethod
    def _reach(links: np.ndarray, least: int = 4) -> None:
        """Nodes that fewer than `least` others name (as in a large group of near copies they may be) are named by those that they name first.

        Where there is no room, the one goes that most others name, unless it came so itself."""
        named = np.bincount(links[links >= 0], minlength=len(links))
        kept = np.zeros(links.shape, bool)
        for i in np.flatnonzero((named < least) & (links[:, 0] >= 0)).tolist():
            for h in links[i][links[i] >= 0].tolist():
                if named[i] >= least:
                    break
                host = links[h]
                if (host == i).any():
                    continue
                free = np.flatnonzero(host < 0)
                at = int(free[0]) if len(free) else int(np.argmax(np.where(kept[h], -1, named[host])))
                if host[at] >= 0:
                    if kept[h, at] or named[host[at]] <= least:
                        continue
                    named[host[at]] -= 1
                host[at], kept[h, at] = i, True
                named[i] += 1

    @staticmethod
    def _back(x: np.ndarray, links: np.ndarray, new: np.ndarray, most: int) -> None:
        src, col = np.nonzero(links[new] >= 0)
        to, src = links[new][src, col], new[src]
        order = np.argsort(to, kind="stable")
        to, src = to[order], src[order]
        u, first, count = np.unique(to, return_index=True, return_counts=True)
        width = count.max(initial=0)
        if not width:
            return
        more = np.full((len(u), width), -1)
        more[np.repeat(np.arange(len(u)), count), np.arange(len(to)) - np.repeat(first, count)] = src
        used = (links[u] >= 0).sum(1)
        fits = used + count <= most
        for k in range(width):
            r = np.flatnonzero(fits & (more[:, k] >= 0))
            links[u[r], used[r] + k] = more[r, k]
        full = np.flatnonzero(~fits)
        for lo in range(0, len(full), 512):
            r = full[lo : lo + 512]
            links[u[r]] = pick(x[u[r]], np.concatenate([links[u[r]], more[r]], 1), x, most)

    def __getstate__(self) -> dict:
        """Without what follows from the rest: graphs are sent to many tasks."""
        return {"exact": self.exact, "layers": [(m.astype(np.int32), links.astype(np.int32)) for m, links in self.layers]}

    def __setstate__(self, state: dict) -> None:
        self.exact, self.layers = state["exact"], state["layers"]
        self.x = self.exact.astype(np.float32)
        self._places()

    def _places(self) -> None:
        self.place = [np.full(len(self.exact), -1, np.int32) for _ in self.layers]
        for p, (members, _) in zip(self.place, self.layers):
            p[members] = np.arange(len(members))
        self.low = self.x[self.layers[-1][0]]
        src, col = np.nonzero(self.layers[-1][1] >= 0)
        to = self.layers[-1][1][src, col]
        self.named = src[np.argsort(to, kind="stable")].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(to, minlength=len(self.low)))])

    def near(self, q: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all hits found."""
        found = list(self.hits(q, threshold, beam))
        return tuple(np.concatenate(x) if found else np.zeros(0, int) for x in (zip(*found) if found else ((), ())))

    def hits(self, q: np.ndarray, threshold: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of all hits found, by parts of HITS or so, or of one query; from beams full of hits the graph is followed from hit to hit."""
        exact, q = q, q.astype(np.float32)
        upper = self.layers[:-1]
        whole = max((i for i, (members, _) in enumerate(upper) if len(members) <= WHOLE), default=-1)
        entry = np.zeros((len(q), 1), int)
        for i, (members, links) in enumerate(upper):
            if i < whole:
                continue
            if i == whole:
                x = self.x[members]
                some = min(ENTRIES, len(x))
                best = members[np.concatenate([np.argpartition(q[lo : lo + 256] @ -x.T, some - 1, 1)[:, :some] for lo in range(0, len(q), 256)])] if len(q) else np.zeros((0, some), int)
            else:
                best = members[beam_search(self.x[members], links, q, entry, ENTRIES)[0]]
            entry = self.place[i + 1][best]
        members, links = self.layers[-1]
        x, beam = self.low, min(beam, len(self.low))

        def sure(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            nodes = members[nodes]
            parts = [np.einsum("bd,bd->b", exact[rows[lo : lo + CHUNK]], self.exact[nodes[lo : lo + CHUNK]]) >= threshold for lo in range(0, len(rows), CHUNK)]
            keep = np.concatenate(parts) if parts else np.zeros(0, bool)
            return rows[keep], nodes[keep]

        size = int(np.clip(CELLS // (beam + STEP * links.shape[1] + len(x) // 16), 8, 256))
        for lo in range(0, len(q), size):
            part = np.arange(lo, min(lo + size, len(q)))
            ids, sim = beam_search(x, links, q[part], entry[part], beam)
            hit = (ids >= 0) & (sim >= threshold - SLACK)
            full = hit.all(1) & (beam < len(x))
            r, c = np.nonzero(hit & ~full[:, None])
            rows, nodes, held = [part[r]], [ids[r, c]], len(r)
            for k in np.flatnonzero(full):
                nodes.append(flood(x, links, self.named, q[part[k]], ids[k], threshold - SLACK))
                rows.append(np.full(len(nodes[-1]), part[k]))
                held += len(nodes[-1])
                if held >= HITS:
                    yield sure(np.concatenate(rows), np.concatenate(nodes))
                    rows, nodes, held = [], [], 0
            if held:
                yield sure(np.concatenate(rows), np.concatenate(nodes))


def audit(g: Graph, threshold: float) -> tuple[int, float]:
    """The least beam (by doubling) that finds AUDIT of the links of a sample, in each class of queries with like numbers of links; the least share found there.

    A query is a row of the shard turned by an angle within the threshold, as a near copy of it in another shard would
    be: so each has a link here, and none matches itself. The sample grows with the shard. Of queries with very many
    links fewer are taken (they cost as many hits, and weigh in their own class alone)."""
    n, dim = g.exact.shape
    r = np.random.default_rng(n)
    rows = r.permutation(n)[: max(AUDIT_ROWS, n // AUDIT_SHARE)]
    away = r.standard_normal((len(rows), dim))
    away -= np.einsum("bd,bd->b", away, g.exact[rows])[:, None] * g.exact[rows]
    size = np.linalg.norm(away, axis=1, keepdims=True)
    cosine = r.uniform(threshold + 0.05 * (1 - threshold), 1, (len(rows), 1))
    q = np.where(size > 1e-9, cosine * g.exact[rows] + np.sqrt(1 - cosine**2) * away / np.maximum(size, 1e-9), g.exact[rows])
    true = np.concatenate([(q[lo : lo + 128] @ g.exact.T >= threshold).sum(1) for lo in range(0, len(q), 128)])
    kind = np.log2(np.maximum(true, 1)).astype(int)
    place = np.empty(len(q), int)
    for k in np.unique(kind):
        place[kind == k] = np.arange((kind == k).sum())
    take = (true > 0) & (place < np.maximum(AUDIT_ROWS * 1024 >> kind, 8))
    q, true, kind = q[take], true[take], kind[take]
    beam = BEAM
    while True:
        found = np.bincount(g.near(q, threshold, min(beam, n))[0], minlength=len(q)) if len(q) else np.zeros(0)
        all_ = np.bincount(kind, true)
        share = np.bincount(kind, found, len(all_))[all_ > 0] / all_[all_ > 0]
        if beam >= n or share.min(initial=1.0) >= AUDIT:
            return min(beam, n), float(share.min(initial=1.0))
        beam *= 2


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _shards(vectors: DataFrame, shards: int, threshold: float) -> DataFrame:
    """(shard, graph, recall) of vectors(id, n, v): a shard's rows are SHARD_ROWS or so, whatever the input."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        v = _matrix(t.column("v").chunk(0))
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        g = Graph(v)
        beam, recall = audit(g, threshold)
        blob = pickle.dumps((t.column("id").to_numpy(), t.column("n").to_numpy(), g, beam), 5)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([blob], pa.binary()), "recall": pa.array([recall])})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(run, "shard int, body binary, recall double")


def _links(vectors: DataFrame, graphs: DataFrame, rows: int, shards: int, threshold: float) -> DataFrame:
    """kind 0: (id, links found in a shard); kind 1: (a, b) of a spanning forest of a batch's links."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, QUERY_ROWS):
                part = b.slice(lo, QUERY_ROWS)
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[0]) % salts], pa.int32()), pa.array([pickle.dumps((ids, _matrix(part.column(1))), 5)], pa.binary())], ["salt", "body"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for kind, shard, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if kind == 0:
                    held = (shard, *pickle.loads(body))
                    continue
                if held is None or held[0] != shard:  # a shard without vectors has no graph
                    continue
                _, node, n, g, beam = held
                ids, v = pickle.loads(body)
                count, x, y = np.zeros(len(ids), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                for row, hit in g.hits(v / np.linalg.norm(v, axis=1, keepdims=True), threshold, beam):
                    a, b = ids[row], node[hit]
                    other = a != b
                    count += np.bincount(row, n[hit] - ~other, len(ids)).astype(np.int64)
                    if other.any():  # links are folded as they come: those of a large group are never held together
                        x, y = spanning(np.concatenate([x, a[other]]), np.concatenate([y, b[other]]))
                        x, y = x[x != y], y[x != y]
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(some), len(x)]).astype(np.int8)), pa.array(np.concatenate([ids[some], x])), pa.array(np.concatenate([count[some], y]))], ["kind", "a", "b"])

    spark = vectors.sparkSession
    salts = max(1, -(-rows // (QUERY_ROWS * BLOCKS)))
    if salts > SALTS:  # a graph goes to each salt: a task's queries grow until they weigh as much as its graph
        salts = max(SALTS, -(-rows // SHARD_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(QUERY_ROWS))
    blocks = materialise(vectors.select("id", "v").mapInArrow(lean(pack), "salt int, body binary"), "queries")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    asked = blocks.select(F.lit(1).cast("byte").alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "salt", "body")
    told = graphs.select(F.lit(0).cast("byte").alias("kind"), "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "body")
    met = told.union(asked).repartition(shards * salts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return met.select("kind", "shard", "body").mapInArrow(lean(search), "kind byte, a long, b long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings, and the least recall that an audit of a shard measured."""
    spark = tuned(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    rows = rows.withColumn("fine", F.coalesce(F.expr(fine), F.lit(False)))
    classes = materialise(rows.where("fine").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("dim", F.size("v")), "vectors")
    # two classes of one least vec_id (a repeated id): a number of the class keeps them apart
    same = classes.groupBy("id").count().where("count > 1").limit(1).count()
    if same:
        classes = materialise(classes.withColumn("id", F.xxhash64("id", "v")), "vectors")
    found, recall = [], 1.0
    for r in classes.groupBy("dim").count().orderBy("dim").collect():
        part = classes.where(F.col("dim") == r.dim)
        shards = max(SHARDS, -(-r["count"] // SHARD_ROWS))
        graphs = materialise(_shards(part, shards, threshold), "graphs")
        recall = min(recall, graphs.agg(F.min("recall")).first()[0])
        found.append(materialise(_links(part, graphs, r["count"], shards, threshold), "links"))
    tuned(spark)
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("audited_recall"))
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    counts = every.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    comp = materialise(components(every.where("kind = 1").select("a", "b")), "comp").withColumnRenamed("node", "id")
    member = rows.where("fine").groupBy("v").agg(F.min("vec_id").alias("least"))
    told = classes.join(member, "v").join(counts, "id", "left").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(least, "component").select(F.col("v").alias("w"), F.coalesce("links", F.col("n") - 1).alias("links"), "component_id")
    out = rows.where("fine").join(told, F.col("v") == F.col("w"), "left").select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumns({"kept": F.col("vec_id").eqNullSafe(F.col("component_id")), "audited_recall": F.lit(recall)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


NAME, ORACLE = "op3_hnsw", None
