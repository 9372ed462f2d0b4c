import datetime
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomrows.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n


TEXTS = [None, "", "   \n\t", "one", "a b c d e", "a b c d e a b c d e", "x " * 40, "a b c d e f\na b c d e f\n\n\nz", "# * | é <ü> 日本 \x0b\x0c x", "1 2 3 4 5 6 1 2 3 4 5 7 2 3 4 5 7 9", " ".join(f"w{i}" for i in range(300)) + " w1 w2 w3 w4 w5", ("line one\n" * 5) + "q r s t u v w x y z"]


def test_statistics_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in quality.with_stats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t


@pytest.mark.parametrize("n, k, p", [(50, 0, 0.01), (1000, 3, 0.01), (1000, 9, 0.01), (200, 1, 0.05), (10, 9, 0.01)])
def test_binomial_tail(spark, n, k, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
    got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p).alias("x")).first().x
    assert got == pytest.approx(want, rel=1e-9)


def _labelled(spark, good_symbols):
    """3000 good and 300 bad documents; bad ones are full of symbols."""
    plain = [f"doc{i} " + " ".join(f"w{i}x{j}" for j in range(12)) for i in range(3000)]
    good = [t + "".join(f" #{j}##" for j in range(20)) if i < good_symbols else t for i, t in enumerate(plain)]
    bad = [" ".join(f"b{i}x{j}###" for j in range(12)) for i in range(300)]
    docs = [(i, t, "en", 1) for i, t in enumerate(good + bad)]
    labels = [(i, int(i < 3000), 0) for i in range(3300)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, n_words int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_reject_bad_and_spare_good(spark):
    docs, labels = _labelled(spark, 0)
    kept = {r.doc_id for r in quality.judged(docs, labels).where("kept").collect()}
    assert kept == set(range(3000))


def test_a_rule_that_would_reject_good_documents_is_not_used(spark):
    docs, labels = _labelled(spark, 300)
    rows = quality.judged(docs, labels).collect()
    good = [r for r in rows if r.doc_id < 3000]
    assert sum(not r.kept for r in good) <= 0.05 * len(good)


def test_without_labels_the_base_rules_stand_alone(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", None), (1, "a b c d e f g h i j", None), (2, "", "en"), (None, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.judged(docs, labels).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in rows) == [(0, False), (1, True), (1, True), (2, False)]
    assert quality.judged(docs.limit(0), labels).count() == 0


def test_copies_of_a_text_are_one_trial(spark):
    """3000 labels of 3 good texts prove no more than 3."""
    plain = [f"doc{i} " + " ".join(f"w{i}x{j}" for j in range(12)) for i in range(3)]
    bad = [" ".join(f"b{i}x{j}###" for j in range(12)) for i in range(50)]
    rows = [(i, plain[i % 3], "en") for i in range(3000)] + [(3000 + i, t, "en") for i, t in enumerate(bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 3000)) for i in range(3050)], "doc_id long, quality int")
    assert quality.judged(docs, labels).where("NOT kept").count() == 0
    known = quality.labelled(docs.select("doc_id", F.col("text").alias("_t1"), F.lit(1).alias("_t2")), labels.withColumn("quality", F.when(F.col("doc_id") == 7, 0).otherwise(F.col("quality"))))
    assert Counter(r.good for r in known.collect()) == Counter({True: 2, False: 51})


def test_clashing_columns_stay_as_they_are(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", "en", 5, "s", 9, datetime.date(2020, 1, 1))], "doc_id long, text string, lang string, n_words int, stratum string, _t1 int, _row date")
    r = quality.judged(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).first()
    assert (r.n_words, r.stratum, r._t1, r._row, r.kept) == (11, "s", 9, datetime.date(2020, 1, 1), True)
