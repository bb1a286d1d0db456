"""Words whose capitals carry combining marks, and packed ids at their places."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import packing
from corpusmill.llm.packing import LEFT_OVER, WordIds, fill_rest, packing_plan, programmed

WORDS = WordIds(public_tokenizers.path("word_bpe_49k.json"))
MARKED = ["H\u0331", "T\u0308", "J\u030c", "W\u030a", "Y\u030a", "E\u0301", "a\u0308", "\u0331", "K\u212a", "I\u0307", "\u03a3"]


def ids(text: str) -> list[int]:
    return np.frombuffer(WORDS.of([text.encode()])[0], dtype="<u4").tolist()


def whole(text: str) -> list[int]:
    return WORDS.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["H\u0331amza", "T\u0308", "x J\u030c, W\u030aY\u030a"])
def test_capitals_with_combining_marks(text):
    assert ids(text) == whole(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(MARKED) | st.text("ABhtJWy\u0308\u030a\u0331", max_size=5), max_size=8), st.sampled_from([" ", "\n", ""]))
def test_marked_words_have_the_ids_of_the_whole_text(parts, joint):
    assert ids(joint.join(parts)) == whole(joint.join(parts))


def test_memory_of_words_is_bounded(monkeypatch):
    words = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 20_000)
    texts = [" ".join(f"word{i}x{j}" for j in range(50)) + " " + "no-blanks" * 500 for i in range(40)]
    for text in texts:
        got = np.frombuffer(words.of([text.encode()])[0], dtype="<u4").tolist()
        assert got == words.tokenizer.encode(text, add_special_tokens=False).ids
        assert words.size < 10_000 + 60 * 400 and max(map(len, words.known | words.older)) <= packing.REMEMBERED_LENGTH


@pytest.mark.parametrize(("low", "high", "pieces"), [(600, 1100, 5000), (1, 2048, 8000), (100, 900, 3000)])
def test_program_places_most_pieces(low, high, pieces):
    counts = np.bincount(np.random.default_rng(3).integers(low, high, pieces), minlength=2049)
    plan, left, bound = list(programmed(counts, 2048))[-1]
    assert left.sum() <= 0.3 * counts.sum() and LEFT_OVER < 0.3
    whole, lower = packing_plan(counts)
    used = np.zeros(2049, dtype=np.int64)
    for filling, times in whole:
        assert sum(k * n for k, n in filling) <= 2048
        for k, n in filling:
            used[k] += times * n
    assert (used == counts).all() and lower == bound
    assert bound <= sum(t for _, t in whole) <= sum(t for _, t in fill_rest(counts, 2048))


def test_a_word_is_looked_up_once_for_all_texts():
    class Counted(dict):
        asked = 0

        def get(self, *of):
            Counted.asked += 1
            return super().get(*of)

    words = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    words.known = Counted()
    text = "a word, a word and a word; été. "
    first = words.of([text.encode()])
    Counted.asked = 0
    assert words.of([(text * 50).encode()] * 40) == [first[0] * 50] * 40
    assert Counted.asked <= len(set(text.split())) + 1  # and nothing, after the last blank


@pytest.mark.parametrize("text", ["İ!?", "क़.", "İ क़", "été.", "中文!", "x</w> </w>y"])
def test_letters_and_marks_after_them(text):
    assert ids(text) == whole(text)
    assert ids(f"{text} <| {text} a {text}") == whole(f"{text} <| {text} a {text}")
