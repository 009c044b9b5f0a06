"""What learning a token costs."""

from __future__ import annotations

import sys

import numpy as np

from folioforge.llm import langid


def _model() -> langid.Model:
    return langid.Model(["de", "en"], {p: (0.02 + 0.01 * (i % 7), 0.02 + 0.01 * (i % 5)) for i, p in enumerate(["▁", *"abcdefghij", "▁a", "ab", "▁bc"])})


def test_tokens_are_learned_in_columns_not_one_by_one():
    """Calls of NumPy's methods stay far below one for each token."""
    digits = str.maketrans("0123456789", "abcdefghij")
    tokens = {f"{i:06d}".translate(digits) for i in range(4000)}
    calls = 0

    def count(frame, event, what):
        nonlocal calls
        calls += event == "c_call" and isinstance(getattr(what, "__self__", None), np.ndarray)

    model = _model()
    sys.setprofile(count)
    try:
        model._learn_tokens(tokens)
    finally:
        sys.setprofile(None)
    assert len(model.costs) == 4000
    assert calls < 400


def test_costs_of_tokens_are_those_of_their_words():
    """Several words, none, marks, letters that lower-casing splits, and a token too long for the memo."""
    model = _model()
    tokens = ["abc", "ABC", "a-b", "12", "--", "", "a1b2c", "x" * 100, "İa", "ab́c", "²"]
    found = model._learn_tokens(set(tokens)) | model.costs
    mask = (1 << langid._FIELD) - 1
    for t in tokens:
        logs = sum((model.log_probabilities([w])[0] for w in langid.words(t)), np.zeros(2))
        assert [found[t] >> langid._FIELD * i & mask for i in range(2)] == ((logs.max() - logs) * langid._SCALE).round().astype(int).tolist()
    assert langid.words("Straße a_b ²x") == ["▁straße", "▁a", "▁b", "▁²x"] and langid.words("") == []


def test_texts_without_new_tokens():
    """Texts without any token, and a second batch whose tokens are all known."""
    model = _model()
    assert model.predict(["", " \n"]) == [("und", 0.0)] * 2
    first = model.predict(["abc ab", "a b c"])
    assert model.predict(["abc ab", "a b c"]) == first and model._learn_tokens(set()) == {}
