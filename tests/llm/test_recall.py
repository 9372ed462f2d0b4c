"""Recall of a full shard, and rows that share a vec_id."""

import numpy as np
import pytest

from loomrows.llm import hnsw


def _vectors(kind):
    r = np.random.default_rng(6)
    n = hnsw.SHARD
    x = r.standard_normal((n, 64))
    if kind == "lengths":
        return x * np.exp(r.standard_normal((n, 1)))
    if kind == "clusters":
        return 0.3 * x + r.standard_normal((200, 64))[r.integers(0, 200, n)]
    if kind == "tight":
        return np.repeat(r.standard_normal((n // 256, 64)), 256, 0) + 1e-3 * x
    return x


@pytest.mark.parametrize("kind", ["isotropic", "lengths", "clusters", "tight"])
def test_recall_at_a_full_shard(kind):
    x = _vectors(kind)
    q = x[:: len(x) // 128]
    found = hnsw.Graph(x).search(q, 20)
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 20 for a, b in zip(found, best, strict=True)]) >= 0.9
    assert all(len(set(a.tolist())) == 20 for a in found)


def test_rows_that_share_a_vec_id(spark):
    r = np.random.default_rng(2)
    rows = [(i % 60, r.standard_normal(8).tolist()) for i in range(120)] + [(0, [9.0] * 8), (60, [9.0] * 8), (60, [9.0] * 8)]
    asked = {i: min(v for j, v in rows if j == i) for i, _ in rows if i % 20 == 0}
    once = {(i, tuple(v)) for i, v in rows}
    for parts in (2, 5):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got: dict = {}
        for g in sorted(hnsw.nearest(df).collect(), key=lambda x: (x.query_id, x.rank)):
            got.setdefault(g.query_id, []).append((g.vec_id, round(g.score, 9)))
        for i, q in asked.items():
            near = sorted(((round(float(np.dot(q, v)), 9), j) for j, v in once if (j, v) != (i, tuple(q))), key=lambda x: (-x[0], x[1]))[:20]
            assert got[i] == [(j, s) for s, j in near]
