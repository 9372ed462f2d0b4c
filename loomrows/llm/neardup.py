"""Near-duplicate documents: minima of many universal hashes, banding, checks
on signatures and on full sets, and connected components.

A document's set holds its distinct shingles of ``width`` words (lower-cased
A-Z); with fewer words, the whole sequence as one; without words it is empty and
linked with nothing. Documents are linked when 100 * intersection >= 80 * union.

1. One pass hashes each text: size and 128-bit digest of its set, and a
   signature of ``BANDS * ROWS`` minima of the hashes a * x + b.
2. Documents with equal sets are one node with a number of its own. Its text is
   that of one row, named by a 128-bit key of doc_id and text, so that rows that
   share a doc_id (or have none) are never taken for each other.
3. Nodes are dealt to buckets by each band. Before the shuffle each task joins
   the nodes of a bucket that it holds to the smallest of them and sends only
   that one on, so a bucket gets a row per batch, however many nodes it has.
   The result is a tree of edges (key, node, pivot) for each bucket. A pair at
   exactly 0.8 shares no bucket with probability (1 - 0.8^5)^40 = 1.2e-7, which
   is the rate at which a link may be missed; above 0.8 it falls fast (1e-10 at
   0.85).
4. Each node is checked against the pivot that it shares most buckets with:
   pairs whose signatures agree in too few places (five and a half standard
   deviations below 0.8: one true link in 5e7 is lost) go, the rest is confirmed
   on full sets. A pivot's members are dealt in salted parts.
5. Components by alternating large-star and small-star steps, each a minimum
   over a node's edges (a window, which spills). All edges of one node meet in
   one task; that much is not split.
6. Nodes still apart from a pivot are checked against the one of these that they
   share most buckets with, and components are formed anew. At last, nodes of
   different components whose sketches allow a link and that meet in a bucket
   are gathered in clusters, by a spanning forest of each bucket, and the nodes
   of a cluster are compared on full sets in blocks, out of which only links
   come. So every pair that shares a bucket has been checked or connected,
   and no bucket emits the pairs of its nodes.

Intermediate tables go to the shared folder. Null texts count as empty. A
component is named by its smallest doc_id, nulls last; rows with one doc_id and
different texts are documents of their own. Rows without words: component_id is
the doc_id itself. A row without doc_id is kept if no row of its component has
one and its text is the component's first by key. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: Least share of equal minima: 0.8 less 5.5 standard deviations.
AGREE = 0.8 - 5.5 * (0.8 * 0.2 / HASHES) ** 0.5
#: Members of a pivot that are compared in one salted part.
PART = 2048
#: Members of a bucket that are held at once when components meet in it.
HELD = 1024
#: Shingles of a block of a cluster, two of which are held at once.
BLOCK_HASHES = 1 << 19
#: Word hashes that a worker keeps, and words hashed at a time for minima.
CACHE = 100_000
BLOCK = 4096
#: Rows of an Arrow batch that are worked on at a time.
SLICE = 1024

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_C = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * 2 + 1


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_words = _WordHash()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < width:
        # a sequence of its own length, told apart from shingles by its constants
        made = _mix(np.array([(h * _C[32 : 32 + len(h)]).sum()], np.uint64) + np.uint64(len(h)))
    else:
        n = len(h) - width + 1
        made = _mix(sum((h[k : k + n] * _C[k] for k in range(1, width)), h[:n] * _C[0]))
    return np.unique(made)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), BLOCK):
        np.minimum(least, (x[start : start + BLOCK, None] * _A + _B).min(axis=0), out=least)
    return least


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices that take little memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def with_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with k1 and k2, which tell rows apart by doc_id and text."""
    each = lambda k: F.xxhash64(F.lit(k), F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col(text).isNull(), F.col(text))
    return docs.withColumns({"k1": each(1), "k2": each(2)})


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, k1, k2, n, d1, d2 (digest of the set; null if empty) and sig."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n, d1, d2, sig = [], [], [], []
            for t in batch.column(3):
                s = shingle_set(t.as_py(), width)
                n.append(len(s))
                if not len(s):
                    d1.append(None), d2.append(None), sig.append(None)
                    continue
                digest = xxhash.xxh3_128_digest(s.tobytes())
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                sig.append(minima(s).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "k1", "k2", "n", "d1", "d2", "sig"])

    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, n long, d1 long, d2 long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def band_rows(nodes: DataFrame) -> DataFrame:
    """(key, node, pivot): the edges inside a task's batches, and with a null
    pivot the row that a batch sends to each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = np.asarray(batch.column(0))
            keys = np.empty((len(node), BANDS), np.uint64)
            for start in range(0, len(node), SLICE):
                sig = _matrix(batch.column(1).slice(start, SLICE))
                part = np.zeros((len(sig), BANDS), np.uint64)
                for r in range(ROWS):
                    part = (part + sig[:, r::ROWS]) * _C[r]
                    part ^= part >> np.uint64(31)
                keys[start : start + SLICE] = part
            keys = _mix(keys + np.arange(BANDS, dtype=np.uint64) * _C[40]).ravel().view(np.int64)
            nodes_ = np.repeat(node, BANDS)
            order = np.lexsort((nodes_, keys))
            keys, nodes_ = keys[order], nodes_[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            pivot = nodes_[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
            for start in range(0, len(keys), 100_000):
                at = slice(start, start + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(nodes_[at]), pa.array(pivot[at], mask=new[at])], ["key", "node", "pivot"])

    return nodes.select("rep", "sig").mapInArrow(run, "key long, node long, pivot long")


def _trees(sent: DataFrame) -> DataFrame:
    """(key, node, pivot) from rows that lie together by key, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for batch in batches:
            key, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if not len(key):
                continue
            new = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            pivot = np.where(at >= 0, node[at], node[0] if first is None else first)
            last, first = key[-1], pivot[-1]
            more = ~new & (pivot != node)
            if more.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[more]), pa.array(node[more]), pa.array(pivot[more])], ["key", "node", "pivot"])

    return sent.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long, pivot long")


def _near_signatures(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sizes and signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            na, nb = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            share = (_matrix(batch.column(4)) == _matrix(batch.column(5))).mean(axis=1)
            near = (share >= AGREE) & (100 * np.minimum(na, nb) >= 80 * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near)), batch.column(1).filter(pa.array(near))], ["node", "pivot"])

    a = nodes.select(F.col("rep").alias("node"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = nodes.select(F.col("rep").alias("pivot"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    return pairs.join(a, "node").join(b, "pivot").select("node", "pivot", "na", "nb", "sa", "sb").mapInArrow(run, "node long, pivot long").repartition("pivot", "node")


def _linked(roles: DataFrame, docs: DataFrame, width: int) -> Kept:
    """Links (node, pivot) found on full sets. roles: (grp, part, own, id); the
    members of a part that are not own are compared with all that are. Of
    several links of a member in a part the first is given, which suffices
    where the own ones are already connected."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            made = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pa.binary())], ["grp", "part", "own", "id", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, block = None, [], [], None
        for batch in _slices(batches):
            cols = [c.to_pylist() for c in batch.columns]
            node, pivot = [], []
            for grp, part, own, i, x in zip(*cols, strict=True):
                if (grp, part) != now:
                    now, ids, held, block = (grp, part), [], [], None
                x = np.frombuffer(x, np.uint64)
                if own:
                    ids.append(i)
                    held.append(x)
                elif ids and len(x):
                    if block is None:
                        size = np.array(list(map(len, held)))
                        block = np.concatenate(held), np.cumsum(size) - size, size
                    flat, start, size = block
                    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
                    both = np.add.reduceat((x[at] == flat).astype(np.int64), start)
                    hit = np.flatnonzero(100 * both >= 80 * (size + len(x) - both))
                    if len(hit):
                        node.append(i)
                        pivot.append(ids[hit[0]])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(pivot, pa.int64())], ["node", "pivot"])

    rows = docs.join(roles.hint("merge"), docs["node"] == roles["id"]).select("grp", "part", "own", "id", "text")
    rows = rows.mapInArrow(sets, "grp long, part int, own boolean, id long, data binary")
    rows = rows.repartition("grp", "part").sortWithinPartitions("grp", "part", F.col("own").desc(), "id")
    return Kept(rows.mapInArrow(compare, "node long, pivot long"))


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> Kept:
    """The pairs (node, pivot), a node at most once, that are linked: checked
    on signatures, then on full sets. The members of a pivot are dealt in
    salted parts, and the pivot goes to each of them."""
    near = Kept(_near_signatures(pairs, nodes))
    parts = near.df.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    members = near.df.join(parts, "pivot").select(F.col("pivot").alias("grp"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("own"), F.col("node").alias("id"))
    pivots = parts.select(F.col("pivot").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("own"), F.col("pivot").alias("id"))
    out = _linked(members.unionByName(pivots), docs, width)
    near.drop()
    return out


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node joins its greater neighbours to the least of itself and all
    its neighbours. edges: (u, v), in any direction and as often as it likes."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.withColumn("m", F.least(F.min("v").over(Window.partitionBy("u")), "u"))
    return least.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins itself and its smaller neighbours to the least of these.
    edges: (u, v) with v < u."""
    least = edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    joined = F.when(F.col("v") == F.col("m"), F.struct("u", "v")).otherwise(F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return least.select(joined.alias("e")).select("e.u", "e.v").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node is either the least of its neighbours or has one
    neighbour only, which is such a least one: then stars are components."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    roles = edges.select(ends.alias("e")).groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return roles.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(edges: DataFrame) -> Kept:
    """(node, component) for every node of edges (node, pivot) but the smallest
    of a component; component is the smallest node reachable. Alternating
    large-star and small-star; a round is one job of three shuffles."""
    step = Kept(edges.select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v")).where("u <> v").distinct())
    while not _all_stars(step.df):
        before, step = step, Kept(_small_star(_large_star(step.df)))
        before.drop()
    step.df = step.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return step


def _with_components(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """edges (node, pivot, ...) with the components cn and cp of their ends.
    A component's smallest node isn't in comp and stands for itself."""
    cn = comp.select(F.col("node").alias("_n"), F.col("component").alias("_cn"))
    cp = comp.select(F.col("node").alias("_p"), F.col("component").alias("_cp"))
    out = edges.join(cn, F.col("node") == F.col("_n"), "left").join(cp, F.col("pivot") == F.col("_p"), "left")
    return out.withColumns({"cn": F.coalesce("_cn", "node"), "cp": F.coalesce("_cp", "pivot")}).drop("_n", "_cn", "_p", "_cp")


def _best(edges: DataFrame) -> DataFrame:
    """Of each node the pivot that it shares most buckets with."""
    by = edges.groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("k"))
    return by.groupBy("node").agg(F.max_by("pivot", F.struct(F.col("k"), -F.col("pivot"))).alias("pivot"))


def _roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each of n places by edges (p, q)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, p, before[q])
        np.minimum.at(root, q, before[p])
        root = root[root]
        if (root == before).all():
            return root


def _forest(members: DataFrame) -> DataFrame:
    """(node, pivot): a spanning forest, bucket by bucket, of the pairs in
    different components whose sketches allow a link. members: (key, node,
    component, n, sketch). Members of a bucket are held in blocks of HELD,
    every two of which meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def edges() -> pa.RecordBatch | None:
            if not rows:
                return None
            own, comp, n, node = (np.concatenate([r[k] for r in rows]) for k in range(4))
            sketch = np.concatenate([r[4] for r in rows])
            left, right = np.flatnonzero(own == now[1]), np.flatnonzero(own == now[2])
            ps, qs = [], []
            for start in range(0, len(left), 64):
                i = left[start : start + 64]
                may = (comp[i, None] != comp[right]) & (100 * np.minimum(n[i, None], n[right]) >= 80 * np.maximum(n[i, None], n[right]))
                x, y = np.nonzero(may)
                for cut in range(0, len(x), 20_000):
                    p, q = i[x[cut : cut + 20_000]], right[y[cut : cut + 20_000]]
                    near = (sketch[p] == sketch[q]).mean(axis=1) >= AGREE
                    ps.append(p[near]), qs.append(q[near])
            if not ps:
                return None
            root = _roots(len(node), np.concatenate(ps), np.concatenate(qs))
            at = np.flatnonzero(root != np.arange(len(node)))
            return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root[at]])], ["node", "pivot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, low, high, own, comp, n, node = (np.asarray(batch.column(k)) for k in range(7))
            sketch = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, HASHES)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            for at in np.split(np.arange(len(key)), cuts):
                here = key[at[0]], low[at[0]], high[at[0]]
                if here != now:
                    if (out := edges()) is not None:
                        yield out
                    now, rows = here, []
                rows.append((own[at], comp[at], n[at], node[at], sketch[at]))
        if (out := edges()) is not None:
            yield out

    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("blocks"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    rows = members.join(sizes.where("c0 <> c1").select("key", "blocks"), "key")
    rows = _block_pairs(rows).select("key", "low", "high", "own", "component", "n", "node", "sketch")
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(run, "node long, pivot long").distinct()


def _block_pairs(rows: DataFrame) -> DataFrame:
    """rows (node, blocks, ...) with own, their block, and once for each pair
    (low, high) of blocks that it is in."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"low": F.least("own", "_j"), "high": F.greatest("own", "_j")}).drop("_j", "blocks")


def _sketches(nodes: DataFrame) -> DataFrame:
    """rep, n and one byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                low = (_matrix(batch.column(2)) & 0xFF).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([r.tobytes() for r in low], pa.binary())], ["rep", "n", "sketch"])

    return nodes.select("rep", "n", "sig").mapInArrow(run, "rep long, n long, sketch binary")


def _clusters(edges: DataFrame, comp: DataFrame, nodes: DataFrame) -> Kept:
    """(node, component, n, sketch, cluster) of the nodes that meet others of
    another component in a bucket with a sketch that allows a link; such nodes
    are in one cluster."""
    met = _with_components(edges, comp).select("key", "node", "pivot", F.col("cn"), F.col("cp"))
    open_keys = met.groupBy("key").agg(F.max((F.col("cn") != F.col("cp")).cast("int")).alias("open")).where("open = 1").select("key")
    met = met.join(open_keys, "key", "left_semi")
    met = met.select("key", "node", F.col("cn").alias("component")).unionByName(met.select("key", F.col("pivot").alias("node"), F.col("cp").alias("component"))).distinct()
    sketches = _sketches(nodes)
    members = Kept(met.join(sketches, met["node"] == sketches["rep"]).select("key", "node", "component", "n", "sketch"))
    found = components(_forest(members.df))
    named = found.df.select("node", F.col("component").alias("cluster")).unionByName(found.df.select(F.col("component").alias("node"), F.col("component").alias("cluster")).distinct())
    out = Kept(members.df.drop("key").dropDuplicates(["node"]).join(named, "node"))
    members.drop(), found.drop()
    return out


def _inside_clusters(clusters: DataFrame, docs: DataFrame, width: int) -> Kept:
    """Links (node, pivot) between components, found on full sets by comparing
    the nodes of a cluster in blocks; of many links between the same components
    of a block one is given. Sets of linked documents are at most a quarter
    apart in size, so nodes of a size class only meet those of the class and of
    the next one; these make a cell."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)], pa.binary())], ["id", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def links() -> pa.RecordBatch | None:
            own, even, node = (np.array([r[k] for r in rows]) for k in range(3))
            comp = np.unique([r[3] for r in rows], return_inverse=True)[1]
            sketch = np.frombuffer(b"".join([r[4] for r in rows]), np.uint8).reshape(-1, HASHES)
            held = [np.frombuffer(r[5], np.uint64) for r in rows]
            n = np.array(list(map(len, held)))
            right = np.flatnonzero(own == now[3])
            ps, qs = [], []
            for i in np.flatnonzero(own == now[2]):
                j = right if now[2] != now[3] else right[right > i]
                j = j[(comp[j] != comp[i]) & (even[j] | even[i]) & (100 * np.minimum(n[j], n[i]) >= 80 * np.maximum(n[j], n[i]))]
                j = j[(sketch[j] == sketch[i]).mean(axis=1) >= AGREE] if len(j) else j
                for cut in range(0, len(j), 256):
                    part = j[cut : cut + 256]
                    part = part[comp[part] != comp[i]]
                    if not len(part):
                        continue
                    flat = np.concatenate([held[k] for k in part])
                    at = np.minimum(np.searchsorted(held[i], flat), n[i] - 1)
                    both = np.add.reduceat((held[i][at] == flat).astype(np.int64), np.cumsum(n[part]) - n[part])
                    for k in part[100 * both >= 80 * (n[part] + n[i] - both)]:
                        if comp[k] != comp[i]:
                            comp[comp == comp[k]] = comp[i]
                            ps.append(node[i]), qs.append(node[k])
            return pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array(qs, pa.int64())], ["node", "pivot"]) if ps else None

        for batch in _slices(batches):
            cluster, cell, low, high, *values = (c.to_pylist() for c in batch.columns)
            for here, *row in zip(zip(cluster, cell, low, high, strict=True), *values, strict=True):
                if here != now:
                    if rows and (out := links()) is not None:
                        yield out
                    now, rows = here, []
                rows.append(row)
        if rows and (out := links()) is not None:
            yield out

    size = F.floor(F.log("n") / math.log(1.2500001)).cast("int")
    cells = clusters.withColumn("size", size).withColumn("cell", F.explode(F.array(F.col("size"), F.col("size") - 1))).withColumn("even", F.col("size") == F.col("cell"))
    blocks = cells.groupBy("cluster", "cell").agg(F.ceil(F.sum("n") / BLOCK_HASHES).cast("int").alias("blocks"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.max("even").alias("some")).where("c0 <> c1 AND some").select("cluster", "cell", "blocks")
    roles = _block_pairs(cells.drop("n", "size").join(blocks, ["cluster", "cell"]))
    near = docs.join(roles.select(F.col("node").alias("_id")).distinct().hint("merge"), F.col("node") == F.col("_id"), "left_semi").select("node", "text")
    data = near.mapInArrow(sets, "id long, data binary")
    rows = roles.join(data.hint("merge"), F.col("node") == F.col("id")).select("cluster", "cell", "low", "high", "own", "even", "node", "component", "sketch", "data")
    rows = rows.repartition("cluster", "cell", "low", "high").sortWithinPartitions("cluster", "cell", "low", "high")
    return Kept(rows.mapInArrow(compare, "node long, pivot long"))


def _texts_of(nodes: DataFrame, docs: DataFrame) -> Kept:
    """(node, text), a row per node. nodes: node, k1, k2."""
    wanted = nodes.select("node", F.col("k1").alias("_1"), F.col("k2").alias("_2"))
    # the merge hint deals texts in one way at every size
    found = docs.join(wanted.hint("merge"), (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2"))).select("node", "text")
    near = Kept(found)
    if near.df.groupBy("node").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
        return near
    once = Kept(near.df.groupBy("node").agg(F.first("text").alias("text")))  # rows of a node with one key have one text
    near.drop()
    return once


def _grouped(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, k1, k2, n of each row of docs (doc_id, k1, k2, text), and f, the
    first row of its component: null_id, doc_id, k1, k2 (null for empty sets)."""
    base = Kept(signatures(docs, width))
    first = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "k1", "k2")
    # sets, and so sizes and signatures, are equal in a class
    classes = base.df.where("n > 0").groupBy("d1", "d2").agg(F.min(first).alias("f"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = Kept(classes.withColumn("rep", F.monotonically_increasing_id()))

    bands = Kept(band_rows(nodes.df))
    inside = bands.df.where("pivot IS NOT NULL AND pivot <> node")
    trees = Kept(inside.unionByName(_trees(bands.df.where("pivot IS NULL").select("key", "node"))))
    bands.drop()

    # from here on only texts of nodes that share a bucket are read
    shared = trees.df.select(F.col("node").alias("_id")).unionByName(trees.df.select(F.col("pivot").alias("_id"))).distinct()
    shared = nodes.df.select(F.col("rep").alias("node"), "f.k1", "f.k2").join(shared, F.col("node") == F.col("_id"), "left_semi")
    near = _texts_of(shared, docs)

    links = _confirmed(_best(trees.df), nodes.df, near.df, width)
    comp = components(links.df)

    second = Kept(_best(_with_components(trees.df, comp.df).where("cn <> cp")))
    more = _confirmed(second.df, nodes.df, near.df, width)
    comp, before = components(comp.df.withColumnRenamed("component", "pivot").unionByName(more.df)), comp
    before.drop()

    clusters = _clusters(trees.df, comp.df, nodes.df)
    rest = _inside_clusters(clusters.df, near.df, width)
    comp, before = components(comp.df.withColumnRenamed("component", "pivot").unionByName(rest.df)), comp
    for kept in (before, clusters, near, links, second, more, rest, trees):
        kept.drop()

    # a component takes the name of its first row
    heads = comp.df.select(F.col("component").alias("node"), "component").distinct()
    named = comp.df.unionByName(heads).join(nodes.df.select(F.col("rep").alias("node"), "f"), "node")
    least = named.groupBy("component").agg(F.min("f").alias("f"))
    new = Kept(named.select("node", "component").join(least, "component").select(F.col("node").alias("_node"), F.col("f").alias("_f")))
    found = nodes.df.join(new.df, F.col("rep") == F.col("_node"), "left")
    found = Kept(found.select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), F.coalesce("_f", "f").alias("f")))
    for kept in (comp, nodes, new):
        kept.drop()
    return base.df.join(found.df, (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")), "left").select("doc_id", "k1", "k2", "n", "f")


def near_duplicates(docs: DataFrame, width: int = 5, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs."""
    rows = with_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")))
    component = F.when(F.col("f").isNull(), F.col("doc_id")).otherwise(F.col("f.doc_id"))
    own = F.col("f").isNull() | ((F.col("k1") == F.col("f.k1")) & (F.col("k2") == F.col("f.k2")))
    kept = F.when(F.col("doc_id").isNull(), own).otherwise(F.col("doc_id").eqNullSafe(component))
    return _grouped(rows, width).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, text: str = "text") -> DataFrame:
    """docs without near copies: one row of each component, that with the
    smallest doc_id (nulls last), and all rows without words. Other rows with
    the doc_id of one that goes are not touched."""
    found = _grouped(with_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))), width)
    own = F.col("f").isNull() | ((F.col("k1") == F.col("f.k1")) & (F.col("k2") == F.col("f.k2")))
    kept = found.where(own).groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.count(F.lit(1)).alias("_rows"), F.first(F.col("f").isNull()).alias("_empty"))
    kept = Kept(kept)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id"), F.col(text).alias("text"))
    rows = with_keys(whole).join(kept.df, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    if not kept.df.where("_rows > 1 AND NOT _empty").isEmpty():  # repeated rows
        first = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy(F.to_json("_row")))
        rows = rows.withColumn("_first", F.when(F.col("_empty"), 1).otherwise(first)).where("_first = 1")
    return rows.select("_row.*")
