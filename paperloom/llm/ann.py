"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Distinct vectors are dealt by hash into shards; each shard's graph is built in one task by batches (all nodes of a batch search the
graph so far in lock-step as whole arrays) and stored as one row of flat arrays: ids, vectors, levels, and per level a matrix of
neighbour numbers, padded with -1. A shard holds about 32 * sqrt(n) of n vectors, at least SHARD_LEAST and at most SHARD_BYTES,
so a query, which searches every shard in logarithmic time, costs about sqrt(n) until shards are full. Queries go in waves of
WAVE_ROWS to every shard, and a task unpacks a graph once for a whole wave; each shard returns its best, scored exactly in double
precision on the original vectors, and the best of all shards are merged. Equal vectors are one node; the ids that share a found
node's vector are added when results are merged, so a vector that very many rows share costs no more than one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._store import written

SHARD_LEAST = 8192
SHARD_BYTES = 64 << 20  # of vectors and neighbours: one row of the index, which a worker holds a few times over
WAVE_ROWS = 1 << 16
BLOCK_ROWS = 1024
M = 16  # forward neighbours, chosen for spread; as many again (twice on the ground level) point back to near nodes
EF_BUILD, EF_SEARCH = 64, 128
BATCH = 256
SALTS = 32


def beam(vectors: np.ndarray, graph: np.ndarray, rows: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one level for all queries in lock-step: node numbers and cosines, best first, -1 where fewer.

    graph[rows[i]] are node i's neighbours on this level.
    """
    b = len(queries)
    every = np.arange(b)
    seen = np.zeros((b, len(vectors) + 1), bool)  # the last column stands for padding
    seen[:, -1] = True
    ids = np.full((b, ef), -1, np.int64)
    sims = np.full((b, ef), -np.inf, np.float32)
    done = np.ones((b, ef), bool)
    ids[:, : entry.shape[1]] = entry
    there = entry >= 0
    sims[:, : entry.shape[1]] = np.where(there, np.einsum("bkd,bd->bk", vectors[entry], queries), -np.inf)
    done[:, : entry.shape[1]] = ~there
    seen[every[:, None], entry] = True
    active = every
    while len(active):
        a_sims = np.where(done[active], -np.inf, sims[active])
        at = a_sims.argmax(axis=1)
        more = a_sims[np.arange(len(active)), at] > -np.inf
        active, at = active[more], at[more]
        if not len(active):
            break
        done[active, at] = True
        near = graph[rows[ids[active, at]]]
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        s = np.where(fresh, np.einsum("bkd,bd->bk", vectors[near], queries[active]), -np.inf)
        all_sims = np.concatenate([sims[active], s], axis=1)
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        keep = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        sims[active] = np.take_along_axis(all_sims, keep, 1)
        ids[active] = np.take_along_axis(all_ids, keep, 1)
        done[active] = np.take_along_axis(all_done, keep, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    sims, ids = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
    return np.where(sims > -np.inf, ids, -1), sims


def spread(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of candidates, best first, m each: those nearer to the node than to any chosen before, then the nearest of the rest."""
    b, c = ids.shape
    v = vectors[ids]
    among = np.matmul(v, v.transpose(0, 2, 1))
    valid = (ids >= 0) & (sims > -np.inf)
    chosen = np.zeros((b, c), bool)
    for k in range(c):
        blocked = (chosen & (among[:, k, :] > sims[:, k, None])).any(axis=1)
        chosen[:, k] = valid[:, k] & ~blocked & (chosen.sum(axis=1) < m)
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c)
    take = np.argsort(rank, axis=1)[:, :m]
    out = np.where(np.take_along_axis(valid, take, 1), np.take_along_axis(ids, take, 1), -1)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1) if out.shape[1] < m else out


def point_back(vectors: np.ndarray, graph: np.ndarray, rows: np.ndarray, nodes: np.ndarray, forward: np.ndarray, m: int) -> None:
    """Adds each node to the back places (from column m on) of its forward neighbours; full places keep the nearest."""
    src = np.repeat(nodes, forward.shape[1])
    dst = forward.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    new = ~(graph[rows[dst], :m] == src[:, None]).any(axis=1)  # those that point there already would be met twice
    src, dst = src[new], dst[new]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    first = np.searchsorted(dst, dst)
    rank = np.arange(len(dst)) - first
    width = graph.shape[1] - m
    for r in range(0, int(rank.max()) + 1 if len(rank) else 0, width):
        part = (rank >= r) & (rank < r + width)
        to, inverse = np.unique(dst[part], return_inverse=True)
        new = np.full((len(to), width), -1, np.int64)
        new[inverse, rank[part] - r] = src[part]
        both = np.concatenate([graph[rows[to], m:], new], axis=1)
        s = np.where(both >= 0, np.einsum("bkd,bd->bk", vectors[both], vectors[to]), -np.inf)
        keep = np.argsort(-s, axis=1, kind="stable")[:, :width]
        graph[rows[to], m:] = np.take_along_axis(both, keep, 1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, exactly, so that squares of huge and tiny components neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    return np.ldexp(vectors, -exponent[:, None])


class Graph:
    """Levels of one shard: `levels` per node, and per level the nodes' rows and a neighbour matrix."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, matrices: list[np.ndarray] | None = None):
        vectors = scaled(vectors)
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = (vectors / norms[:, None]).astype(np.float32)
        self.unit = np.concatenate([self.unit, np.zeros((1, vectors.shape[1]), np.float32)])  # node -1
        self.levels = levels
        self.rows, self.matrices = [], matrices or []
        for level in range(int(levels.max()) + 1 if len(levels) else 0):
            on = np.flatnonzero(levels >= level)
            rows = np.full(len(levels) + 1, -1, np.int64)
            rows[on] = np.arange(len(on))
            self.rows.append(rows)
            if matrices is None:
                self.matrices.append(np.full((len(on) + 1, M * (3 if level == 0 else 2)), -1, np.int64))
        if matrices is None:
            self._build()

    def _build(self) -> None:
        n = len(self.levels)
        order = np.concatenate([[int(self.levels.argmax())], np.delete(np.arange(n), int(self.levels.argmax()))]) if n else np.zeros(0, np.int64)
        at = 1
        while at < n:
            batch = order[at : at + min(BATCH, max(1, at))]
            queries = self.unit[batch]
            entry = np.full((len(batch), 1), order[0])
            for level in range(len(self.rows) - 1, -1, -1):
                stay = self.levels[batch] >= level
                ids, sims = beam(self.unit, self.matrices[level], self.rows[level], queries, entry, EF_BUILD if stay.any() else 1)
                if stay.any():
                    nodes = batch[stay]
                    own = self.unit[nodes] @ self.unit[nodes].T  # nodes of a batch are candidates of each other
                    np.fill_diagonal(own, -np.inf)
                    both_ids = np.concatenate([ids[stay], np.broadcast_to(nodes, own.shape)], axis=1)
                    both_sims = np.concatenate([np.where(ids[stay] >= 0, sims[stay], -np.inf), own], axis=1)
                    best = np.argsort(-both_sims, axis=1, kind="stable")[:, : min(EF_BUILD, both_sims.shape[1])]
                    forward = spread(self.unit, np.take_along_axis(both_ids, best, 1), np.take_along_axis(both_sims, best, 1), M)
                    self.matrices[level][self.rows[level][nodes], :M] = forward
                    point_back(self.unit, self.matrices[level], self.rows[level], nodes, forward, M)
                entry = ids[:, :1]
            at += len(batch)

    def search(self, queries: np.ndarray, k: int, ef: int) -> np.ndarray:
        """Node numbers of about the k nearest of each query, -1 where fewer; queries are scaled."""
        q = (queries / np.sqrt((queries * queries).sum(axis=1))[:, None]).astype(np.float32)
        entry = np.full((len(q), 1), int(self.levels.argmax()))
        for level in range(len(self.rows) - 1, -1, -1):
            ids, _ = beam(self.unit, self.matrices[level], self.rows[level], q, entry, max(ef, k) if level == 0 else 1)
            entry = ids[:, :1]
        return ids[:, :k]


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def taking_part(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (doubles) of the rows with a key and a usable vector."""
    return rows.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def shard_rows(n: Column, dim: Column, least: int) -> Column:
    """How many of n vectors a shard takes."""
    most = F.lit(SHARD_BYTES) / (8 * dim + 4 * 3 * M + 64)
    return F.least(F.greatest(32 * F.sqrt(n), F.lit(least)), F.greatest(most, F.lit(1024)))


def nodes_of(rows: DataFrame) -> DataFrame:
    """v, id (the least of its ids), n (rows), h (hash) of the distinct vectors of (id, v); id and h name a node."""
    return written(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("h", F.xxhash64("v")), "ann-nodes")


def build(nodes: DataFrame, least: int = SHARD_LEAST) -> DataFrame:
    """The index of distinct vectors: dim, shard, ids and hashes (of nodes), vectors (doubles), levels, graph (per level a flat matrix of int32)."""
    x = nodes.select("id", "h", "v", F.size("v").alias("dim"))
    shards = x.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / shard_rows(F.col("n"), F.col("dim"), least)).alias("shards"))  # one row a length
    dealt = x.join(F.broadcast(shards), "dim").select("dim", F.pmod(F.xxhash64("id", "h"), F.col("shards")).cast("int").alias("shard"), "id", "h", "v")

    def run(rows: pa.Table) -> pa.Table:
        ids, h = rows.column("id").to_numpy(), rows.column("h").to_numpy()
        by = np.lexsort((h, mixed(ids)))  # an order that doesn't depend on partitions
        v = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[by]
        ids, h = ids[by], h[by]
        u = (mixed(ids ^ h) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        levels = np.minimum(12, np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(M))).astype(np.int8)
        graph = Graph(v, levels)
        return pa.table({
            "dim": pa.array([v.shape[1]], pa.int32()), "shard": rows.column("shard").slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "hashes": pa.array([h.tobytes()], pa.binary()),
            "vectors": pa.array([v.tobytes()], pa.binary()), "levels": pa.array([levels.tobytes()], pa.binary()),
            "graph": pa.array([[m.astype(np.int32).tobytes() for m in graph.matrices]], pa.list_(pa.binary())),
        })

    return written(dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, ids binary, hashes binary, vectors binary, levels binary, graph array<binary>"), "ann-index")


def mixed(ids: np.ndarray) -> np.ndarray:
    from paperloom.llm._bytes import mix

    return mix(ids.astype(np.uint64))


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH, wave_rows: int = WAVE_ROWS) -> DataFrame:
    """query_id, id and h (of a node), score: of every shard the best k of each query (id, v), exact cosines in double."""
    shards = index.select(F.col("dim").alias("dim"), F.col("shard").alias("shard")).distinct()
    waves = max(1, -(-queries.count() // wave_rows))
    blocks = max(1, wave_rows // BLOCK_ROWS)

    def pack(rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        by = np.argsort(ids)
        v = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[by]
        wave = rows.column("wave").slice(0, 1)
        return pa.table({"dim": pa.array([v.shape[1]], pa.int32()), "wave": wave, "q_ids": pa.array([ids[by].tobytes()], pa.binary()), "q_vectors": pa.array([v.tobytes()], pa.binary())})

    h = F.xxhash64("id")
    dealt = queries.select(F.size("v").alias("dim"), F.pmod(h, F.lit(waves)).cast("int").alias("wave"), F.pmod(F.xxhash64(h), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    packed = dealt.groupBy("dim", "wave", "block").applyInArrow(pack, "dim int, wave int, q_ids binary, q_vectors binary")
    # the stated query set against every shard, a wave of blocks at a time; there are at most n / SHARD_LEAST shards
    left = packed.join(F.broadcast(shards), "dim")
    right = index.join(F.broadcast(dealt.select("dim", "wave").distinct()), "dim")

    def run(q: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if q.num_rows and shard.num_rows:
            dim = shard["dim"][0].as_py()
            ids, h = (np.frombuffer(shard[c][0].as_buffer(), np.int64) for c in ("ids", "hashes"))
            v = scaled(np.frombuffer(shard["vectors"][0].as_buffer(), np.float64).reshape(-1, dim))
            levels = np.frombuffer(shard["levels"][0].as_buffer(), np.int8)
            flat = [np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in shard["graph"][0].values]
            graph = Graph(v, levels, [m.reshape(-1, M * (3 if n == 0 else 2)) for n, m in enumerate(flat)])
            norms = np.sqrt((v * v).sum(axis=1))
            for q_ids, q_vectors in zip(q["q_ids"], q["q_vectors"], strict=True):
                q_ids, qv = np.frombuffer(q_ids.as_buffer(), np.int64), scaled(np.frombuffer(q_vectors.as_buffer(), np.float64).reshape(-1, dim))
                for a in range(0, len(q_ids), BATCH):
                    part = qv[a : a + BATCH]
                    got = graph.search(part, k, ef)
                    score = np.einsum("bkd,bd->bk", v[got], part) / (norms[got] * np.sqrt((part * part).sum(axis=1))[:, None])
                    there = got >= 0
                    for held, own in zip(out, (np.broadcast_to(q_ids[a : a + BATCH, None], got.shape)[there], ids[got[there]], h[got[there]], score[there]), strict=True):
                        held.append(own)
        columns = [np.concatenate(x) if x else np.zeros(0) for x in out]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "id", "h", "score"])

    return left.groupBy("dim", "wave", "shard").cogroup(right.groupBy("dim", "wave", "shard")).applyInArrow(run, "query_id long, id long, h long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", ef: int = EF_SEARCH, shard_least: int = SHARD_LEAST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each usable query its k nearest found among the usable vectors of its length.

    A query's own id is no candidate. Ties go to the smaller id. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, on either side; ids that are null neither; rows that repeat an id and vector count once. Of rows
    that repeat a query's id with other vectors the least vector (by components) is the query; all are candidates of others.
    With fewer candidates all are returned; empty tables give empty results; other columns are not read.
    """
    rows = taking_part(vectors, key, vector)
    nodes = nodes_of(rows)
    index = build(nodes, shard_least)
    asked = written(taking_part(queries, key, vector).groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
    found = search(index, asked, k + 1, ef)
    # best nodes over all shards; at most (k + 1) a shard and query
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "h")
    found = written(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"), "ann-found")
    # ids of found nodes: their own, and where rows share the vector the k + 1 least; dealt over salts first, since very many may
    met = written(nodes.join(found.select("id", "h").distinct(), ["id", "h"], "left_semi"), "ann-met")
    several = met.where("n > 1").select("v", F.col("id").alias("node"), "h")
    x = rows.join(several, "v").select("node", "h", "id").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for by in (["node", "h", "salt"], ["node", "h"]):
        x = x.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("n") <= k + 1)
    members = met.where("n = 1").select("id", "h", F.col("id").alias("vec_id")).unionByName(x.select(F.col("node").alias("id"), "h", F.col("id").alias("vec_id")))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # an id that is repeated with several vectors counts once, by its nearest
    near = found.join(members, ["id", "h"]).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = near.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
