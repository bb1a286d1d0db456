"""Batches of texts are encoded as single ones are, each word once."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from corpusmill.llm.sentencepiece import Model, worker_model

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return Model(PATH)


def test_batch_is_encoded_as_its_texts(model):
    draw = random.Random(3)
    texts = ["".join(draw.choice(" ab\n.,▁é日🙂\t 1") for _ in range(draw.randint(0, 30))) for _ in range(300)]
    texts += [None, "", " ", "   ", "a", " a", "a ", "a  b", "  a   b  ", "\n", "a\n\n b", "▁", "x" * 100, "Bücher, (und) mehr!"]
    ids, scores = model.encode_all(pa.array(texts, pa.string()))
    for text, got, score in zip(texts, ids.to_pylist(), scores.to_pylist(), strict=True):
        if text is None:
            assert got is None and score is None
            continue
        data, total = model.encode(text)
        assert got == np.frombuffer(data, "<i4").tolist() and score == pytest.approx(total, rel=1e-12)
    assert model.decode_all(ids).to_pylist() == texts


def test_words_are_cut_together_as_alone(model):
    words = ["▁the", "Straße", "▁▁▁", "internationalisation", "日本", "x", "▁q\udc81"]
    for word, found in zip(words, model.automaton.viterbi_all(words, model.unknown), strict=True):
        score, pieces = model.automaton.viterbi(word, model.unknown)
        if any(number < 0 for number, _ in pieces):
            assert found is None
        else:
            assert found == (np.array([n for n, _ in pieces], dtype="<i4").tobytes(), score)


def test_word_is_cut_once_for_all_texts(model, monkeypatch):
    asked = []
    monkeypatch.setattr(type(model.automaton), "viterbi_all", lambda self, texts, unknown: asked.extend(texts) or [None] * len(texts))
    texts = pa.array(["zumbelkraut and zumbelkraut"] * 50)
    model.encode_all(texts)
    model.encode_all(texts)
    assert asked.count("▁zumbelkraut") == 1


def test_ids_that_are_no_text_are_replaced(model):
    half = model.bytes[0xE6]
    assert model.decode_all(pa.array([[half], None, []], pa.list_(pa.int32()))).to_pylist() == ["�", None, ""]


def test_worker_keeps_its_model():
    assert worker_model(PATH) is worker_model(PATH)
