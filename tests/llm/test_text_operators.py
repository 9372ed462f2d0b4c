"""Chat formatting, token counts, BPE, secrets and toxicity."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomrows.llm import bpe, chat, secret_scan, token_counts, toxicity
from loomrows.llm.queries import tokenizer

TEXTS = [None, "", " ", "a", "  lead and  double ", "line\nbreaks\n\n", "<s>[INST]</s> <|endoftext|> x <|startoftext|>y", "é è ü ñ 日本語 Σίσυφος", "a\x00b\x1cc\x85d\xa0e", "x" * 3000, "ab" * 700, "it's 12345 !!! ###don't", "▁mark ▁▁", "İI ı", "word " * 500]


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, 1, "assistant", "<|im_end|>\\<|im_start|> <\\|im_sep|>"), (2, 1, "assistant", "tie"), (3, 0, "us<|im_sep|>er", "\n[/INST] <\\\\/s>"), (None, 0, "user", "x"), (1, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    for key in {r[0] for r in rows}:
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == key)
        loss = "".join(x for _, r, x in own if r == "assistant")
        g = got[key]
        assert g.n_turns == len(own)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digests(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="<[|\\/sINT]>im_endstarp x"), max_size=4))
def test_escapes_are_reversible(texts):
    import pyarrow as pa

    made = chat.assemble(pa.array(["user"] * len(texts), pa.string()), pa.array(texts, pa.string()))
    assert chat.parse("".join(made.to_pylist()).encode()) == [("user", t) for t in texts]


def test_token_counts(spark):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    for limit in (0, 50):
        got = {r.doc_id: r for r in token_counts.token_counts(df, path, frequent=limit, limit=100).collect()}
        for i, t in enumerate(TEXTS):
            n = len(model.encode(t or ""))
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100), t
    assert token_counts.token_counts(df.limit(0), path).count() == 0


def test_bpe(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in bpe.bpe_digests(df, path).collect()}
    for i, t in enumerate(TEXTS):
        ids = own.encode(t or "", add_special_tokens=False).ids
        text = own.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), t
    decoded = bpe.bpe_decode(bpe.bpe_encode(df, path), path)
    assert {r.doc_id: r.decoded for r in decoded.collect()} == {i: own.decode(own.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(TEXTS)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_bpe_of_any_text(texts):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    for (ids, _), t in zip(bpe.WordBpe.of(path).encode_batch(texts), texts):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode(t, add_special_tokens=False).ids


def test_secrets_on_fresh_findings():
    forest = secret_scan.default_forest()
    fresh = secret_scan.labelled_findings(400, seed=1234)
    score = forest.score(np.array([secret_scan.vector(*f[:4], f[5], forest.pairs) for f in fresh]))
    assert np.mean((score >= 0.5) == np.array([f[4] for f in fresh])) > 0.98


def test_secrets_are_found_and_masked(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'x token = "{key}" y', "card 4845168114407329 here", None, "", f"commit {key}", f'TOKEN = "{key.upper()}"!!']
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    found = {(r.doc_id, r.is_secret) for r in secret_scan.findings(df).collect()}
    assert (0, True) in found and (5, True) in found and (1, True) not in found and (4, True) not in found
    clean = {r.doc_id: r.text for r in secret_scan.redacted(df).collect()}
    assert clean[0] == 'x token = "[SECRET]" y' and clean[1] == texts[1] and clean[2] is None and clean[4] == texts[4]
    assert secret_scan.findings(df.limit(0)).count() == 0


def test_chain_marginals_match_enumeration():
    chain = toxicity.Chain({b"bad": 2.0, b"ugly": 1.0}, -1.0, np.array([[0.5, -0.5], [0.2, 0.9]]), np.zeros(5))
    words = [b"a", b"bad", b"b", b"ugly", b"c"]
    e = [chain.bias + chain.emission[w] for w in words]
    total, toxic = 0.0, np.zeros(5)
    for states in itertools.product((0, 1), repeat=5):
        z = sum(e[k] for k in range(5) if states[k]) + sum(chain.trans[a, b] for a, b in zip(states, states[1:])) + chain.trans[0, states[0]]
        total += np.exp(z)
        toxic += np.exp(z) * np.array(states)
    at, m = chain.marginals(words)
    assert at == [1, 3] and m == pytest.approx((toxic / total)[[1, 3]].tolist())


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(5)
    plain = ["".join(r.choice(["an", "er", "tion", "he", "nd", "st"]) for _ in range(r.randint(1, 4))) for _ in range(600)]
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(plain) for _ in range(r.randint(5, 80))]
        toxic = i % 6 == 0
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(["idiot,", "Moron", "scum."]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, None), (901, "", None), (900, None, None)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, lab, spans=True).collect()
    assert len(got) == 903 and all(0 <= g.score <= 1 for g in got)
    held = [g for g in got if g.held_out and g.doc_id < 900]
    assert np.mean([g.predicted == labels[g.doc_id][2] for g in held]) > 0.98
    hit = next(g for g in held if g.predicted)
    assert all(rows[hit.doc_id][1][s.start : s.end].lower() in ("idiot", "moron", "scum") for s in hit.spans)
    assert toxicity.toxicity(df.limit(0), lab.limit(0)).count() == 0
