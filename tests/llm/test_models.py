"""The language model, nearest neighbours and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loomrows.llm import hnsw, lm_score


def _vocabulary():
    top = [(f"w{k}", 100 - k) for k in range(60)]
    return lm_score.Vocabulary(top, 20, {k: (0.5, 40.0, 10.0) for k in range(lm_score.REST)}, 5000, 400)


def test_gradients_match_differences():
    v = _vocabulary()
    net = lm_score.Network(v)
    r = np.random.default_rng(0)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    net.p["C"] += r.standard_normal(net.p["C"].shape)
    h = r.standard_normal((7, lm_score.HIDDEN))
    word = r.integers(0, 50, 7)
    cls = v.cls[word]
    grads = {k: np.zeros_like(x) for k, x in net.p.items()}
    _, dh = net.outputs(h, cls, word, grads)
    loss = lambda: -net.outputs(h, cls, word)[0].mean()
    for name, at in (("C", (3, int(cls[0]))), ("W", (int(word[0]), 2)), ("w", (int(word[1]),))):
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-5
        up = loss()
        net.p[name][at] = keep - 1e-5
        down = loss()
        net.p[name][at] = keep
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    h[2, 5] += 1e-5
    up = loss()
    h[2, 5] -= 2e-5
    assert dh[2, 5] == pytest.approx((up - loss()) / 2e-5, abs=1e-6)


def test_probabilities_sum_to_one():
    v = _vocabulary()
    net = lm_score.Network(v)
    h = np.random.default_rng(1).standard_normal((1, lm_score.HIDDEN)).astype(np.float32)
    short = np.arange(len(v.cls))
    logp, _ = net.outputs(np.repeat(h, len(short), 0), v.cls[short], short)
    rest, _ = net.outputs(np.repeat(h, lm_score.REST, 0), np.arange(lm_score.CLASSES, lm_score.CLASSES + lm_score.REST), np.zeros(lm_score.REST, int))
    empty = sum(1 for m in net.members if not len(m))
    none, _ = net.outputs(np.repeat(h, lm_score.CLASSES, 0), np.arange(lm_score.CLASSES), np.zeros(lm_score.CLASSES, int)) if empty else (np.array([]), None)
    total = np.exp(logp).sum() + np.exp(rest).sum()
    assert total <= 1 + 1e-4 and (empty or total == pytest.approx(1, abs=1e-4))
    assert 10 ** v.inside(0, 3) + sum(10 ** v.inside(c, 3) for c in [4] * 10) == pytest.approx(1)


def test_scores_and_base(spark):
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(300):
        at, words = r.randrange(80), []
        for _ in range(r.randint(0, 60)):
            at = (at * 7 + r.randrange(3)) % 80
            words.append(vocabulary[at] + r.choice(["", "", ","]))
        rows.append((i, " ".join(words).upper() if i % 9 == 0 else " ".join(words)))
    rows += [(400, None), (401, ""), (402, "unseen Words é"), (None, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in lm_score.lm_scores(df, frequent=100).collect()}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    coded = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    c = Counter(w for i, ws in coded.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in coded.items():
        x = got[i]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert x.base_score == pytest.approx(base) and x.score < 0
    test = [got[i] for i in held if held[i]]
    assert sum(x.score for x in test) > sum(x.base_score for x in test)


def test_nearest_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((1500, 16)) + 2 * r.standard_normal((12, 16))[r.integers(0, 12, 1500)]
    x[100:160] = x[100]
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(2000, None, "b"), (2020, [0.0] * 16, "b"), (2040, [float("nan")] * 16, "b"), (2060, [1.0], "b"), (0, x[0].tolist(), "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(4)
    got: dict = {}
    for g in hnsw.nearest(df).collect():
        got.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(f[2] == pytest.approx(s[f[1]]) for f in found)
        hits += len({f[1] for f in found} & set(best.tolist()))
    assert hits >= 0.9 * 20 * len(got)
    same = sorted(got[100])
    assert [f[1] for f in same if f[1] in range(101, 160)] == sorted(f[1] for f in same if f[1] in range(101, 160))
    assert hnsw.nearest(df.limit(0)).count() == 0
    assert hnsw.nearest(df.where("vec_id IN (20, 21, 22)")).count() == 2


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(7)
    word = lambda: "".join(r.choice(["an", "er", "tion", "he", "nd"]) for _ in range(r.randint(1, 4)))
    good = [" ".join(word() for _ in range(60)) for _ in range(80)]
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = good + [good[3], good[4] + " extra", "too short", None, " ".join(["same"] * 50), " ".join(word() for _ in range(60)) + f' token = "{key}" end']
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = {}
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        stages[name] = df.collect()
        if name != "bpe":
            assert df.columns == docs.columns
    ids = lambda name: [x.doc_id for x in stages[name]]
    assert set(ids("quality rules")) == set(range(82)) | {85}
    assert sorted(ids("near-duplicates")) == [*range(80), 85]
    assert key not in next(x.text for x in stages["secrets"] if x.doc_id == 85) and sorted(ids("secrets")) == [*range(80), 85]
    assert max(Counter(ids("mixing")).values()) <= 3 and set(ids("mixing")) <= {*range(80), 85}
    assert sorted(ids("bpe")) == sorted(ids("mixing")) and all(x.n_tokens == len(x.token_ids) > 0 for x in stages["bpe"])
    assert Counter(x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(ids("bpe"))
