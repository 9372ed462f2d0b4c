import random
from collections import Counter, defaultdict

import pytest

from loomrows.llm import neardup


def brute(rows, width):
    """(doc_id, text): n_shingles and component of each row."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    ids = [i for i, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k in range(len(rows)):
        least[find(k)].append(ids[k])
    return Counter((i, len(s), min(x for x in least[find(k)] if x is not None) if ids[k] is not None or any(x is not None for x in least[find(k)]) else None) for k, (i, s) in enumerate(zip(ids, sets)))


def made(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 60))] for _ in range(12)]
    rows = []
    for k in range(n):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((1000 - k, " ".join(words)))
    return rows + [(5, None), (6, ""), (7, " \n\t"), (8, "one"), (9, "ONE"), (10, "one two"), (11, "one  two\n")]


@pytest.mark.parametrize("seed, width", [(1, 2), (2, 5)])
def test_components_match_brute_force(spark, seed, width):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, width).collect())
    assert got == brute(rows, width)


def test_a_large_near_group_in_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 7)
    monkeypatch.setattr(neardup, "HELD", 16)
    r = random.Random(3)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(40)] = f"x{r.randrange(60)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in neardup.near_duplicates(df, 2).collect()) == brute(rows, 2)


def test_repeated_rows_and_no_rows(spark):
    rows = [(1, "a b c", 3), (1, "a b c", 3), (2, "a b c", 4), (None, "a b c", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = neardup.near_duplicates(df, 2).collect()
    assert sorted((x.doc_id or 0, x.component_id, x.kept) for x in got) == [(0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert [(x.doc_id, x.component_id) for x in neardup.deduplicated(df, 2).collect()] == [(1, 3)]
    assert neardup.near_duplicates(df.limit(0), 2).count() == 0


def test_rows_are_told_apart_by_text_not_by_doc_id(spark):
    """Null ids and one id on several texts: no row stands for another."""
    copy, other = "a b c d e f", "zz yy xx ww vv"
    df = spark.createDataFrame([(None, copy), (None, other), (5, copy), (1, "q w e r t y"), (1, "u i o p a s"), (3, "q w e r t y"), (None, None), (7, "")], "doc_id long, text string")
    got = Counter((x.doc_id, x.component_id, x.kept) for x in neardup.near_duplicates(df, 2).collect())
    assert got == Counter([(None, 5, False), (None, None, True), (5, 5, True), (1, 1, True), (1, 1, True), (3, 1, False), (None, None, True), (7, 7, True)])
    kept = neardup.deduplicated(df, 2).collect()
    assert Counter((x.doc_id, x.text) for x in kept) == Counter([(None, other), (5, copy), (1, "q w e r t y"), (1, "u i o p a s"), (None, None), (7, "")])


def test_many_copies_without_ids_leave_one(spark):
    df = spark.createDataFrame([(None, "one two three", k) for k in range(5)] + [(None, "one two three four", 9)], "doc_id long, text string, k1 int")
    assert neardup.deduplicated(df, 2).count() == 2
    long_text = " ".join(f"w{k}" for k in range(200_000))
    df = spark.createDataFrame([(1, long_text), (2, long_text + " more")], "doc_id long, text string")
    assert [x.doc_id for x in neardup.deduplicated(df, 5).collect()] == [1]
