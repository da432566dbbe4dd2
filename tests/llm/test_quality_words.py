"""Shapes of words are those of whole words."""

import numpy as np
import pytest

from tidewake.llm import quality


def test_a_long_word_counts_to_its_end():
    head = b"aA" * 32
    plain, marked = head + b"a", head + b"a0-0-0"
    assert quality._word(plain)[1] != quality._word(marked)[1]
    assert quality._word(marked)[1] == quality._hash(b"s", head + b"a0-0-0")
    assert set(quality.features(plain)[0]) != set(quality.features(marked)[0])


def test_long_words_are_not_remembered():
    long, score = b"x1" * 50_000, quality.Scorer(quality.Ordinal(np.zeros(2 * quality.SIZE), np.array([0.0, 1.0])))
    score.many([long + b" short", None])
    assert set(score.known) == {b"short"}


def test_many_words_are_worked_out_as_one():
    rng = np.random.default_rng(6)
    words = [bytes(rng.choice(list(b"aabXXY00..-\xc3\xa9"), rng.integers(1, 9))) for _ in range(500)] + [b"...", b"a", b"\x00\x00", b"\x0e", b"x" * 99]
    assert quality._words(words) == [quality._word(w) for w in words] and quality._words([]) == []


def test_texts_of_a_batch_score_alone():
    """The batch's scorer against the features of each text, in a space so small that features of all kinds fall together."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.choice(list(b"abcXY09.-!,"), rng.integers(1, 7))) for _ in range(300)]
    texts = [b" ".join(words[k] for k in rng.integers(0, 300, rng.integers(1, 200))) for _ in range(60)]
    texts += [None, b"", b" \n", b"a", b"...", b"a\na\nb", b"x" * 3000, "é ü 中文".encode()]
    model = quality.Ordinal(rng.normal(0, 1, 2 * quality.SIZE), np.array([0.0, 1.0]))
    score = quality.Scorer(model)
    assert score.many(texts) == pytest.approx([model.score(t) for t in texts])
    hashed = quality._hash
    quality._hash = lambda kind, value: hashed(kind, value) % 64
    try:
        extra = quality._EXTRA
        quality._EXTRA = [quality._hash(b"x", n) for n in (b"repeated", b"lines", b"top", b"short")]
        score = quality.Scorer(model)
        assert score.many(texts) == pytest.approx([model.score(t) for t in texts])
    finally:
        quality._hash, quality._EXTRA = hashed, extra
