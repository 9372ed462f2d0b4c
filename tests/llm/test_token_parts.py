"""Token counts with tiny caches and parts, against the library."""

import random

import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loomrows.llm import token_counts as T
from loomrows.llm.queries import tokenizer

PATH = tokenizer("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_the_table_outlives_the_cache(spark, monkeypatch):
    monkeypatch.setattr(T, "CACHE", 20)
    monkeypatch.setattr(T, "PART", 50)
    r = random.Random(4)
    texts = [" ".join(r.choice(["the", "of", f"w{r.randrange(500)}", "x\ny"]) for _ in range(r.randrange(200))) for _ in range(60)]
    counter = T.PieceCounter(PATH)
    counter.words, counter.lengths = pa.array(["the", "of"]), np.array([counter.length("the"), counter.length("of")])
    assert counter.counts(pa.array([*texts, None, ""])).tolist() == [*(len(MODEL.encode(t)) for t in texts), 0, 0]
    assert len(counter.cache) <= 20 and counter.words.to_pylist() == ["the", "of"]
    top = T.frequent_pretokens(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), "text", 2)
    assert set(top) <= {"the", "of", "x", "\ny"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n▁<s>/日x ", max_size=40), max_size=6))
def test_any_text(texts):
    assert T.PieceCounter.of(PATH).counts(pa.array(texts, pa.string())).tolist() == [len(MODEL.encode(t)) for t in texts]


def test_a_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(T, "PART", 1000)
    text = " ".join(f"word{k % 97}\nline" for k in range(5000)) + " " + "y" * 9000 + " end"
    assert sum(1 for _ in T.parts_of(text.replace("\n", " \n"))) > 20
    assert T.PieceCounter(PATH).counts(pa.array([text, "a"])).tolist() == [len(MODEL.encode(text)), len(MODEL.encode("a"))]
