"""The draw goes on past documents that don't fit; the query runs the mix."""

from collections import Counter

import pytest

from loomrows.llm import mixing, queries


def drawn_words(spark, rows, seed):
    """(need, words drawn once more) of source b, whose target is a part of its size."""
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(2).cache()
    plan = mixing.mix_plan(sizes, seed)
    p = plan.df.where("source = 'b'").collect()[0]
    got = mixing.taken(sizes, plan, seed).where("doc_id < 100000").collect()
    return p.target - p.copies * p.source_size, sum(r.taken - p.copies * r.size for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_large_documents_are_set_aside(spark, seed):
    # b: 2000 documents of 100 words and one of 1,000,000; a larger source takes
    # five sevenths of all words, so that b is drawn in part
    rows = [(k, "b", 100) for k in range(2000)] + [(2000, "b", 1_000_000)] + [(100_000 + k, "a", 1000) for k in range(300)]
    need, words = drawn_words(spark, rows, seed)
    assert 0 < need < 1_000_000
    assert min(need, 200_000) - 100 <= words <= need


def test_repeated_rows_are_one_unit(spark):
    rows = [(k // 3, "b", 40 + k % 5) for k in range(900)] + [(5000, "b", 30)] * 400 + [(None, "b", 5)] * 10 + [(100_000 + k, "a", 1000) for k in range(20)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(3).cache()
    plan = mixing.mix_plan(sizes)
    p = plan.df.where("source = 'b'").collect()[0]
    times: dict = {}
    for r in mixing.taken(sizes, plan).where("doc_id < 100000").collect():
        times.setdefault(r.doc_id, set()).add(r.taken // r.size)
    assert all(len(t) == 1 for t in times.values())
    unit = Counter()
    for i, s, n in rows:
        unit[i] += n * (s == "b" and i is not None)
    left = p.target - p.copies * p.source_size - sum(n for i, n in unit.items() if n and times[i] == {p.copies + 1})
    assert 0 <= left and all(n > left for i, n in unit.items() if n and times[i] == {p.copies})


def test_query_reads_its_words_from_the_mix(spark, tmp_path, monkeypatch):
    rows = [(k, "w " * (1 + k % 30), f"s{k % 3}") for k in range(300)] + [(7, "x y z", "s0"), (None, "a b", "s1"), (400, None, "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = mixing.sized(docs).select("doc_id", "source", "size")
    planned = Counter(map(tuple, mixing.taken(sizes, mixing.mix_plan(sizes)).collect()))
    assert Counter(map(tuple, queries.op2_mixing(spark, str(tmp_path)).collect())) == planned
    # quotas that lose the blocks of a source lose its rows, and the query shows it
    whole = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda *a: whole(*a).where("source <> 's0'"))
    lost = queries.op2_mixing(spark, str(tmp_path)).collect()
    assert len(lost) == len(rows) and sum(r.taken for r in lost) < sum(r[4] * n for r, n in planned.items())
