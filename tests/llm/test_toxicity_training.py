"""The chain is fitted on whole documents, long and short."""

import itertools
import math
import random

import numpy as np
import pytest

from loomrows.llm import toxicity


def test_short_documents_train_the_chain():
    r = random.Random(3)
    plain = [f"word{chr(97 + k)}".encode() for k in range(20)]
    docs = [([r.choice(plain) for _ in range(5)] + [b"foul"] * (k % 2), k % 2) for k in range(60)]
    weights, _, _ = toxicity.fit_chain(docs)
    assert weights[b"foul"] > 1


def test_every_token_with_a_feature_is_in_a_window():
    words = [b"bad", b"plain", b"plain"] * 300 + [b"late"]
    found = toxicity.windows_of(words, 1, {b"bad": 0, b"late": 1})
    assert any([1] in part for part, _ in found)
    places = {max(0, min(i - 4, len(words) - 9)) for i in [*range(0, 900, 3), 900]}
    assert len(found) == len(places) and all(len(part) == 9 for part, _ in found)
    assert toxicity.windows_of([], 1, {b"bad": 0}) == []


def test_document_scores_by_enumeration():
    """The score of a short text from all its label sequences."""
    chain = toxicity.Chain({b"bad": 2.0, b"ugly": 1.0}, -1.0, np.array([[0.5, -0.5], [0.2, 0.9]]), np.array([-1.0, 0.7, 0.4, 1.5, -0.3]))
    words = [b"a", b"bad", b"b", b"ugly", b"c"]
    e = [chain.bias + chain.emission[w] for w in words]
    mass, toxic = 0.0, np.zeros(5)
    for states in itertools.product((0, 1), repeat=5):
        z = math.exp(sum(x for x, s in zip(e, states) if s) + sum(chain.trans[a, b] for a, b in zip((0, *states), states)))
        mass, toxic = mass + z, toxic + z * np.array(states)
    m = (toxic / mass)[[1, 3]]
    x = [1.0, math.log1p(m.sum()), min(1.0, 50 * m.sum() / 25), 1 - np.prod(1 - m), math.log1p(5) / 10]
    assert chain.score(words) == pytest.approx(1 / (1 + math.exp(-float(np.dot(chain.doc, x)))))


def test_windows_are_packed_and_counted():
    window = ([[1, 20], [], [3]], [1, 0, 0])
    assert toxicity.unpacked(toxicity.packed(window)) == window
    twice = toxicity.fit_windows([(toxicity.packed(window), 2)], 30)
    assert all(np.allclose(a, b) for a, b in zip(twice, toxicity.fit_windows([(toxicity.packed(window), 1)] * 2, 30), strict=True))


def test_training_agrees_with_itself_and_with_the_local_form(spark):
    r = random.Random(9)
    rows = [(i % 150, " ".join(r.choice(["one", "two", "three", "foul"] if i % 2 else ["one", "two", "three"]) for _ in range(30))) for i in range(300)]
    rows.append((1, " ".join(["plain", "foul"] * 20_000)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, toxic int")
    models = [toxicity.trained_model(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels) for n in (2, 5)]
    assert models[0].weights == pytest.approx(models[1].weights) and models[0].doc.tolist() == pytest.approx(models[1].doc.tolist())
    sample = toxicity._sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, "text").df.collect()
    least: dict = {}
    for i, t in rows:
        least[i] = min(t, least.get(i, t))
    assert all(x.text == least[x.doc_id] for x in sample)
    local, bias, _ = toxicity.fit_chain([(toxicity.tokens(x.text), x.toxic) for x in sample])
    assert local == pytest.approx(models[0].weights) and bias == pytest.approx(models[0].bias)
