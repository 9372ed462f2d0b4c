"""Nearest neighbours by inner product: hierarchical navigable small-world
graphs, one per shard, whose results are merged.

Equal vectors are one point of the index, named by its smallest vec_id; its
other rows (as many as an answer can hold) are put back into the answers.
Points are dealt to shards of at most about ``SHARD`` by a hash. A task gets a
shard's points first and then the queries, in blocks: it builds the graph, and
answers as the blocks stream by, so it holds one shard and one block.

Graph: every point has a random highest level. Points are inserted in random
order, in blocks of at most ``INSERTED`` (and a quarter of what is there): a
search from the top level down finds ``CONSTRUCTION`` near points on each level
of a point, which is joined to up to ``LINKS`` of these, and of its block, that
are not nearer to each other than to it, and back; a list that overflows is
chosen anew. Neighbours are stored as flat arrays, -1 where there are fewer. To
turn the largest inner product into the nearest point, each vector gets one more
component that brings its length to the longest of the shard; since long vectors
have large products with anything, a search looks at the ``ENTRIES`` longest
first. It goes on with the levels downwards and holds ``BEAM`` points on the
ground; the queries of a block advance together. Every shard answers every
query, as the method has it, so work grows with queries times shards.

Vectors that are null, zero, hold null or non-finite components or have another
number of components than most take no part, nor do rows without vec_id.
Repeated rows count once. Rows with one vec_id and different vectors are rows of
their own; as a query the least of these vectors (in order of components) is
asked. Queries: rows whose vec_id is divisible by 20.

Recall of the 20 nearest, one full shard of 8192 points in 64 dimensions against
brute force: isotropic normal 0.96 or more, log-normal lengths 0.99, clusters of
40 points and groups of 256 nearly equal ones 1.0 (``tests/llm/test_recall.py``).
A shard of 32768 isotropic points reached 0.74 only, hence the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept

SHARD, LEAST_SHARDS = 8192, 6
#: Links of a point (twice that on the ground), candidates that they are chosen
#: from, and points that searches hold: at insertion, and for an answer.
LINKS, CANDIDATES, CONSTRUCTION, BEAM = 16, 64, 64, 256
LEVEL_SHARE = 1 / 16
#: Longest vectors, which every search looks at first.
ENTRIES = 1024
#: Points that are inserted at a time, and points that a search expands at a time.
INSERTED, EXPANDED = 512, 4
BLOCK = 256


class Graph:
    """Vectors, levels of neighbour arrays (the ground first; -1 where there are
    fewer), and the entry points, the longest vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        n = len(vectors)
        norms = (vectors * vectors).sum(1)
        extra = np.sqrt(np.maximum(norms.max() - norms, 0)) if n else norms
        self.x = np.concatenate([vectors, extra[:, None]], axis=1).astype(np.float32)
        rng = np.random.default_rng(seed)
        height = rng.geometric(1 - LEVEL_SHARE, n) - 1
        self.entries = np.argsort(-norms, kind="stable")[:ENTRIES]
        top = int(height.max()) if n else 0
        self.levels = [np.full((n, LINKS * (1 if k else 2)), -1, np.int32) for k in range(top + 1)]
        order, done = rng.permutation(n), 0
        while done < n:  # blocks that grow with what is there to search
            block = order[done : done + min(INSERTED, max(16, done // 4))]
            self._insert(block, order[:done], height)
            done += len(block)

    def _insert(self, block: np.ndarray, before: np.ndarray, height: np.ndarray) -> None:
        """Joins the points of a block to near ones that are in the graph, found
        by a search of each level from the top, and to each other."""
        x = self.x[block]
        own = x @ x.T
        np.fill_diagonal(own, -np.inf)
        near = np.full((len(block), 1), -1, np.int64)
        for k in range(int(height.max()), -1, -1):
            here = before[height[before] >= k]
            rows = np.flatnonzero(height[block] >= k)
            if len(here):
                if not (near >= 0).any():
                    near = np.repeat(here[:1][None], len(block), 0)
                # points that stay below this level only descend through it
                wide = CONSTRUCTION if len(rows) else 1
                near = self._search(k, x, near, wide)
            if not len(rows):
                continue
            found = near[rows] if len(here) else np.full((len(rows), 1), -1)
            peers = np.where(np.isin(np.arange(len(block)), rows)[None], own[rows], -np.inf)
            m = min(CANDIDATES, len(block))
            best = np.argpartition(-peers, m - 1, axis=1)[:, :m]
            peer = np.where(np.take_along_axis(peers, best, 1) > -np.inf, block[best], -1)
            chosen = self._diverse(block[rows], np.concatenate([found, peer], 1), LINKS)
            links = self.levels[k]
            links[block[rows], : chosen.shape[1]] = chosen
            self._link_back(links, block[rows], chosen)

    def _diverse(self, points: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Of the candidates of each point up to ``most`` that are not nearer to
        one that is taken than to the point, filled up by the nearest."""
        x = self.x
        out = np.full((len(points), most), -1, np.int32)
        for start in range(0, len(points), BLOCK):
            at = slice(start, start + BLOCK)
            cand = ids[at]
            sims = np.where(cand >= 0, np.einsum("ij,ikj->ik", x[points[at]], x[cand]), -np.inf)
            k = min(CANDIDATES, cand.shape[1])
            near = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            cand, sims = np.take_along_axis(cand, near, 1), np.take_along_axis(sims, near, 1)
            v = x[cand]
            among = np.matmul(v, v.transpose(0, 2, 1))
            pick, count = np.zeros(cand.shape, bool), np.zeros(len(cand), int)
            worst = np.full(cand.shape, -np.inf, np.float32)
            for j in range(k):
                take = (worst[:, j] < sims[:, j]) & (count < most) & (cand[:, j] >= 0)
                pick[:, j] = take
                count += take
                worst = np.where(take[:, None], np.maximum(worst, among[:, :, j]), worst)
            for j in range(k):
                more = ~pick[:, j] & (count < most) & (cand[:, j] >= 0)
                pick[:, j] |= more
                count += more
            r, c = np.nonzero(pick)
            out[start + r, np.arange(len(r)) - np.searchsorted(r, r)] = cand[r, c]
        return out

    def _link_back(self, links: np.ndarray, points: np.ndarray, chosen: np.ndarray) -> None:
        """Adds the points to the lists of those they chose; a list that
        overflows is chosen anew from old and new neighbours."""
        most = links.shape[1]
        r, c = np.nonzero(chosen >= 0)
        to, back = chosen[r, c].astype(np.int64), points[r]
        fresh = ~(links[to] == back[:, None]).any(1)
        to, back = to[fresh], back[fresh]
        order = np.lexsort((-np.einsum("ij,ij->i", self.x[to], self.x[back]), to))
        to, back = to[order], back[order]
        rank = np.arange(len(to)) - np.searchsorted(to, to)
        used = (links[to] >= 0).sum(1)
        room = used + rank < most
        links[to[room], (used + rank)[room]] = back[room]
        full = np.unique(to[~room])
        if len(full):
            width = np.searchsorted(to, full, side="right") - np.searchsorted(to, full)
            more = np.full((len(full), min(int(width.max()), most)), -1, np.int64)
            mine = np.isin(to, full) & (rank < more.shape[1])
            more[np.searchsorted(full, to[mine]), rank[mine]] = back[mine]
            old = links[full].astype(np.int64)
            twice = (more[:, :, None] == old[:, None, :]).any(2)  # those that found room just now
            links[full] = self._diverse(full, np.concatenate([old, np.where(twice, -1, more)], 1), most)

    def _search(self, level: int, q: np.ndarray, start: np.ndarray, beam: int) -> np.ndarray:
        """Best-first search of a level from start (ids, -1 where fewer), for all
        queries side by side: up to ``beam`` near points, the nearest first."""
        links, x, every = self.levels[level], self.x, np.arange(len(q))
        n, width = start.shape
        first = np.where(start >= 0, np.einsum("ij,ikj->ik", q, x[start]), -np.inf).astype(np.float32)
        if width > beam:
            keep = np.argpartition(-first, beam - 1, axis=1)[:, :beam]
            start, first = np.take_along_axis(start, keep, 1), np.take_along_axis(first, keep, 1)
            width = beam
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -np.inf, np.float32)
        ids[:, :width], sims[:, :width] = start, first
        done = ids < 0
        seen = np.zeros((n, len(x)), bool)
        r, c = np.nonzero(ids >= 0)
        seen[r, ids[r, c]] = True
        live = every
        while len(live):
            # the nearest open points, several at a time
            opened = np.where(done[live], -np.inf, sims[live])
            k = min(EXPANDED, beam)
            nxt = np.argpartition(-opened, k - 1, axis=1)[:, :k] if k < beam else np.broadcast_to(np.arange(beam), opened.shape)
            real = np.take_along_axis(opened, nxt, 1) > -np.inf
            more = real.any(1)
            live, nxt, real = live[more], nxt[more], real[more]
            if not len(live):
                break
            done[live[:, None], nxt] = True
            near = np.where(real[:, :, None], links[ids[live[:, None], nxt]], -1).reshape(len(live), -1)
            r, c = np.nonzero(near >= 0)
            r, to = live[r], near[r, c].astype(np.int64)
            key = np.unique((r * len(x) + to)[~seen[r, to]])
            if not len(key):
                continue
            r, to = key // len(x), key % len(x)
            seen[r, to] = True
            got = np.einsum("ij,ij->i", q[r], x[to])
            better = got > sims[r].min(1)
            r, to, got = r[better], to[better], got[better]
            if not len(r):
                continue
            own, at = np.unique(r, return_inverse=True)
            place = np.arange(len(r)) - np.searchsorted(r, r)
            new_ids = np.full((len(own), int(place.max()) + 1), -1, np.int64)
            new_sims = np.full(new_ids.shape, -np.inf, np.float32)
            new_ids[at, place], new_sims[at, place] = to, got
            all_sims = np.concatenate([sims[own], new_sims], 1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[own] = np.take_along_axis(np.concatenate([ids[own], new_ids], 1), keep, 1)
            done[own] = np.take_along_axis(np.concatenate([done[own], new_ids < 0], 1), keep, 1)
            sims[own] = np.take_along_axis(all_sims, keep, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1)

    def search(self, queries: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
        """Up to k near points for each query, -1 where fewer."""
        q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        beam = max(beam, k)
        # the entry points are looked at whole, then the levels downwards
        sims = q @ self.x[self.entries].T
        m = min(beam // 2, len(self.entries))
        best = self.entries[np.argpartition(-sims, m - 1, axis=1)[:, :m]]
        at = best[np.arange(len(q))[:, None], np.argsort(-np.take_along_axis(sims, np.argpartition(-sims, m - 1, axis=1)[:, :m], 1), axis=1)][:, :1]
        for level in range(len(self.levels) - 1, 0, -1):
            high = np.flatnonzero((self.levels[level] >= 0).any(1))
            if not len(high):
                continue
            at = self._search(level, q, np.concatenate([at, np.repeat(high[:1][None], len(q), 0)], 1), 8)[:, :1]
        found = self._search(0, q, np.concatenate([np.where((best == at).any(1)[:, None], -1, at), best], 1), beam)
        return found[:, :k]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine: Column = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + 0.0))
    sizes = rows.groupBy(F.size("v").alias("k")).count().orderBy(F.col("count").desc(), "k").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].k if sizes else 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of each query."""
    rows = usable(vectors).distinct().withColumn("h", F.xxhash64("v"))
    same = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    # a point's name is its smallest vec_id, and the hash of its vector where ids repeat
    members = Kept(members.withColumn("point", F.min("vec_id").over(Window.partitionBy("v"))))
    points = members.df.where("place = 1").select("vec_id", "h", "v")
    n = points.count()
    shards = max(LEAST_SHARDS, -(-n // SHARD))
    own = points.select(F.pmod(F.xxhash64("vec_id", "h"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "h", "v")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "h")).alias("q"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "q.h", "q.v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, data, graph = None, [], [], None

        def answer(qid: np.ndarray, qh: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            nonlocal graph
            if graph is None:
                graph = Graph(np.concatenate(data)), np.concatenate(ids), np.concatenate(data)
            g, names, x = graph
            found = g.search(q, k + 1)
            r, c = np.nonzero(found >= 0)
            at = found[r, c]
            return pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(qh[r]), pa.array(names[at, 0]), pa.array(names[at, 1]), pa.array((x[at] * q[r]).sum(1))], ["query_id", "qh", "point", "h", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            s, kind, vec, h = (np.asarray(batch.column(i)) for i in range(4))
            flat = batch.column(4)
            x = np.asarray(flat.flatten()).reshape(len(s), -1)
            cut = np.flatnonzero((np.diff(s) != 0) | (np.diff(kind) != 0)) + 1
            for at in np.split(np.arange(len(s)), cut):
                if s[at[0]] != shard:
                    shard, ids, data, graph = s[at[0]], [], [], None
                if kind[at[0]] == 0:
                    ids.append(np.stack([vec[at], h[at]], 1))
                    data.append(x[at])
                elif data:
                    for start in range(0, len(at), 256):
                        part = at[start : start + 256]
                        yield answer(vec[part], h[part], x[part])

    dealt = own.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "vec_id", "h")
    near = dealt.mapInArrow(run, "query_id long, qh long, point long, h long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "point", "h")
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    full = near.join(members.df.select("point", "h", "vec_id"), ["point", "h"]).where("vec_id <> query_id OR h <> qh")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", "h")
    ranked = full.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
