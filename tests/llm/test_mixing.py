import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomrows.llm import mixing


def filled(sizes, weights=(5, 2, 1), cap=3):
    """Targets by source, by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        free = {s: weight[s] for s in names if s not in capped}
        target = capped | {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if target[s] > cap * sizes[s] + 1e-9]
        if not over:
            return target
        capped |= {s: cap * sizes[s] for s in over}


def made(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 7 % 40)), f"s{k % 5}") for k in range(900)]
    rows += [(1000 + k, "a b c", "tiny") for k in range(3)] + [(2000, None, None), (2001, "x y", None), (2002, "", "s1"), (2003, "q " * 5000, "s2")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), rows


def test_targets_and_taken(spark):
    df, rows = made(spark)
    sizes = mixing.sized(df).select("doc_id", "source", "size").cache()
    got = mixing.taken(sizes, mixing.mix_plan(sizes)).collect()
    source = {i: s for i, _, s in rows}
    by, took = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        by[s] += len((t or "").split())
    want = filled(by)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == by[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        took[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(took[s] - t) <= max(3, 0.01 * t)
    again = mixing.taken(sizes, mixing.mix_plan(sizes)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_rows_of_the_mix_are_dealt_to_shards(spark):
    df, _ = made(spark)
    sizes = mixing.sized(df).select("doc_id", "source", "size").cache()
    want = {r.doc_id: r.taken // r.size for r in mixing.taken(sizes, mixing.mix_plan(sizes)).collect() if r.taken}
    rows = mixing.mix(df, depth=2).collect()
    assert Counter(r.doc_id for r in rows) == want
    assert {r.shard for r in rows} <= {0, 1, 2, 3} and len({r.shard for r in rows}) == 4


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([("a", 40), ("b", 7), (None, 13), ("z", 0)], "source string, n long")
    rows = mixing.splitting_tree(quotas, 3).collect()
    total, shard = Counter(), Counter()
    for r in rows:
        total[r.source] += r.quota
        shard[r.shard] += r.quota
    assert dict(total) == {"a": 40, "b": 7, None: 13, "z": 0} and max(shard.values()) - min(shard.values()) <= 1


def test_hypergeometric_draws(spark):
    n = 4000
    rows = spark.range(n).select(mixing.draw_hypergeometric(F.lit(20).cast("long"), F.lit(8).cast("long"), F.lit(10).cast("long"), (F.col("id") + 0.5) / n).alias("x"))
    got = {r.x: r["count"] / n for r in rows.groupBy("x").count().collect()}
    for k in range(0, 9):
        assert got.get(k, 0) == pytest.approx(math.comb(8, k) * math.comb(12, 10 - k) / math.comb(20, 10), abs=1e-3)


def test_empty(spark):
    df, _ = made(spark)
    sizes = mixing.sized(df.limit(0)).select("doc_id", "source", "size")
    assert mixing.taken(sizes, mixing.mix_plan(sizes)).count() == 0
    assert mixing.mix(df.limit(0)).count() == 0


def test_null_ids_have_whole_copies_only(spark):
    rows = [(None if k % 3 == 0 else k, f"a b c d e {k}", s) for k, s in enumerate("aaaaaaaaabbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.source: r for r in mixing.mix_plan(mixing.sized(df).select("doc_id", "source", "size")).df.collect()}
    got = mixing.mix(df).groupBy("source", F.col("doc_id").isNull().alias("none")).count().collect()
    for r in got:
        if r["none"]:
            assert r["count"] == plan[r.source].copies * sum(i is None and s == r.source for i, _, s in rows)
    shards = mixing.mix(df, depth=3).select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.p for r in shards}) == len(shards) == len({r.shard for r in shards})
