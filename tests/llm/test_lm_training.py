"""The language model learns from every training text."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomrows.llm import lm_score


def test_order_is_learned_from_texts_outside_a_sample_of_3000(spark):
    r = random.Random(5)
    held = {i for i in range(7000) if zlib.crc32(str(i).encode()) % 10 == 0}
    share = 3000 / (7000 - len(held))
    hashed = spark.range(7000).select("id", (F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))).alias("sampled"))
    sampled = {x.id for x in hashed.collect() if x.sampled}
    words, rows = ["one", "two", "three", "four"], []
    for i in range(7000):
        at = r.randrange(4)
        ordered = i in held or i not in sampled
        rows.append((i, " ".join(words[(at + k) % 4] if ordered else r.choice(words) for k in range(20))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    test = [x for x in lm_score.lm_scores(df).collect() if x.held_out]
    assert len(test) == len(held)
    assert sum(x.score for x in test) > 0.6 * sum(x.base_score for x in test)


def test_each_text_is_in_one_shard_and_all_tokens_weigh(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD", 500)
    rows = [(k % 90 if k % 7 else None, " ".join(f"w{(k * j) % 50}" for j in range(k % 23))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n = sum(len(t.split()) + 1 for _, t in rows)
    v = lm_score.Vocabulary([(f"w{k}", 60 - k) for k in range(50)], len(rows), {}, n, 51)
    shards = -(-n // (lm_score.ROUNDS * 500))
    top = [(f"w{k}", 60 - k, lm_score.rest_class(b"w1")) for k in range(50)]
    docs = df.withColumn("held_out", F.lit(False))
    coded = lm_score.coded_texts(docs, v, top, len(rows)).where("word IS NULL")
    got = lm_score.dealt(coded, lm_score.ROUNDS, shards).collect()
    assert {x.round for x in got} == set(range(lm_score.ROUNDS)) and {x.shard for x in got} == set(range(shards))
    assert Counter(bytes(x.ids) for x in got) == Counter(np.array([v.index[w] for w in lm_score.words(t)], np.uint16).tobytes() for _, t in rows)
    net, again = (lm_score.pickle.loads(lm_score.trained_network(coded.select("doc_id", "ids"), v)) for _ in range(2))
    assert np.array_equal(net.flat(), again.flat()) and not np.array_equal(net.flat(), lm_score.Network(v).flat())


def test_parameters_are_averaged_by_weight(spark):
    x = np.arange(32, dtype=np.float32)
    rows = [(s, 0, p, w, bytearray((part * (s + 1)).tobytes())) for s, w in ((0, 10), (1, 30)) for p, part in enumerate(np.array_split(x, lm_score.PIECES))]
    df = spark.createDataFrame(rows, "shard int, part int, piece int, weight long, value binary").repartition(3)
    assert np.allclose(lm_score.averaged(df), x * 1.75)


def test_a_repeated_text_is_learned():
    v = lm_score.Vocabulary([(f"w{k}", 60 - k) for k in range(50)], 9, {k: (0.5, 9.0, 3.0) for k in range(lm_score.REST)}, 900, 60)
    ids = np.random.default_rng(3).integers(0, 50, 400).astype(np.uint16)
    cls = lm_score.class_table(v)
    nets = [lm_score.Network(v) for _ in range(2)]
    before = nets[0].score([ids], cls, v.end)[0]
    tokens = np.append(ids, np.uint16(v.end))
    nets[0].train(np.tile(tokens, 40), cls[np.tile(tokens, 40)], v.end)
    assert nets[0].score([ids], cls, v.end)[0] > 0.5 * before


def test_states_are_carried_and_lengths_do_not_matter(monkeypatch):
    v = lm_score.Vocabulary([(f"w{k}", 60 - k) for k in range(50)], 9, {k: (0.5, 9.0, 3.0) for k in range(lm_score.REST)}, 900, 60)
    net, cls, r = lm_score.Network(v), lm_score.class_table(v), np.random.default_rng(1)
    net.load(net.flat() * 3)  # logits that need their greatest taken off
    texts = [r.integers(0, 50, n).astype(np.uint16) for n in (0, 1, 31, 32, 33, 100, 1000, 5)]
    one = []
    for t in texts:
        h, total, last = np.zeros((1, lm_score.HIDDEN), np.float32), 0.0, v.end
        for y in [*t.tolist(), v.end]:
            h = net.step(h, (net.p["E"] + net.p["b"])[[last]])[0]
            total += net.outputs(h, cls[[y]], np.array([y]))[0][0]
            last = y
        one.append(total)
    monkeypatch.setattr(lm_score, "GROUP", 3)
    assert np.allclose(net.score(texts, cls, v.end), one, rtol=1e-4)


def test_a_text_of_a_million_words_takes_the_memory_of_a_window():
    import tracemalloc

    v = lm_score.Vocabulary([(f"w{k}", 60 - k) for k in range(50)], 9, {}, 900, 60)
    net, cls = lm_score.Network(v), lm_score.class_table(v)
    texts = [np.zeros(200_000, np.uint16), *(np.zeros(30, np.uint16) for _ in range(511))]
    tracemalloc.start()
    got = net.score(texts, cls, v.end)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(got).all() and peak < 60e6


def test_forms_agree_in_python_and_spark(spark):
    found = [w for w in ["a", "b1", "ñ", "x.", "y,", "z!", "é9", "日本。", "1", "-", "ü."]]
    got = spark.createDataFrame([(w,) for w in found], "word string").select("word", lm_score.rest_class_of(F.col("word")).alias("k")).collect()
    assert {r.word: r.k for r in got} == {w: lm_score.rest_class(w.encode()) for w in found}


def test_words_of_all_texts_are_the_words_of_each():
    r = random.Random(2)
    texts = [None, "", " ", "\t\n\x0b\x0c\r", "ÄB c D", " a\x1cb C "] + ["".join(r.choice("aB .é\t\n\x0b\x0c\r\x1f　😀") for _ in range(r.randrange(40))) for _ in range(400)]
    for column in (lm_score.pa.array(texts), lm_score.pa.array(texts).slice(3, 50), lm_score.pa.array([None, " "], lm_score.pa.string())):
        starts, found = lm_score.words_of_all(column)
        found = found.cast(lm_score.pa.binary()).to_pylist()
        assert [found[a:b] for a, b in zip(starts, starts[1:])] == [lm_score.words(t) for t in column.to_pylist()]


def test_rows_of_one_value_are_added_up():
    r = np.random.default_rng(4)
    at, rows = r.permutation(np.concatenate([np.zeros(100, int), np.full(17, 5), np.full(16, 6), r.integers(7, 60, 120)])), r.standard_normal((253, 6))
    values, sums = lm_score._sums(rows, at)
    assert values.tolist() == sorted(set(at.tolist()))
    assert np.allclose(sums, [rows[at == x].sum(0) for x in values])


def test_a_rare_word_that_a_text_repeats_is_one_row(spark):
    v = lm_score.Vocabulary([("a", 9), ("b", 5)], 3, {}, 20, 4)
    top = [("a", 9, 0), ("b", 5, 0)]
    rows = [(1, "a x. x. ñ b x."), (2, "x. 7"), (3, None), (4, "A b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False)).coalesce(1)
    got = lm_score.coded_texts(docs, v, top, 3).collect()
    doc_of = {r.uid: r.doc_id for r in got if r.word is None}
    assert sorted((doc_of[r.uid], r.word, r.cls, r.times) for r in got if r.word is not None) == [(1, "x.", 2, 3), (1, "ñ", lm_score.KINDS, 1), (2, "7", 1, 1), (2, "x.", 2, 1)]
    ids = {r.doc_id: np.frombuffer(r.ids, np.uint16).tolist() for r in got if r.word is None}
    a, b, rest = v.index[b"a"], v.index[b"b"], lm_score.SHORT
    assert ids == {1: [a, rest + 2, rest + 2, rest + lm_score.KINDS, b, rest + 2], 2: [rest + 2, rest + 1], 3: [], 4: [a, b]}
    assert [(r.n_tokens, r.n_known) for r in sorted((r for r in got if r.word is None), key=lambda r: r.doc_id)] == [(7, 3), (3, 1), (1, 1), (3, 3)]


def test_forms_of_many_words_are_those_of_each():
    found = ["a", "b1", "ñ", "x.", "y,", "z!", "é9", "日本。", "1", "-", "ü.", "\x1c", "{", "A"]
    for words in (lm_score.pa.array(found), lm_score.pa.array(found).slice(2, 7), lm_score.pa.array(found[:0], lm_score.pa.string())):
        assert lm_score.rest_classes(words).tolist() == [lm_score.rest_class(w.encode()) for w in words.to_pylist()]
