"""The edit distance by diagonals against the plain table."""

import random
import time

import pytest

from folioforge.functions import edit_distance as ed


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, edits, letters):
    t = list(text)
    for _ in range(edits):
        i, kind = rng.randrange(len(t) + 1), rng.random()
        if kind < 0.34 or not t:
            t.insert(i, rng.choice(letters))
        elif kind < 0.67:
            del t[min(i, len(t) - 1)]
        else:
            t[min(i, len(t) - 1)] = rng.choice(letters)
    return "".join(t)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "aé\U0001f600 "])
def test_every_way_gives_the_distance(letters):
    rng = random.Random(letters)
    for _ in range(250):
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 45)))
        b = edited(rng, a, rng.randint(0, 15), letters) if rng.random() < 0.8 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 45)))
        want = table(a, b)
        assert ed.levenshtein(a, b) == ed.levenshtein(b, a) == want
        if a and b:
            assert ed._table(a, b) == want
            x, y = (a, b) if len(a) >= len(b) else (b, a)
            least = len(x) - len(y)
            for bound in {least, least + 1, want, want + 3, 2 * len(x)}:
                if bound >= least:
                    answer = want if want <= bound else None
                    assert ed._within(x, y, bound) == answer and ed._within_together(x, y, bound, ed._names(x, y)) == answer


def test_long_texts_with_many_edits():
    rng = random.Random(7)
    words = ["the", "of", "and", "thation", "other", "path", "river"]
    text = " ".join(rng.choice(words) + rng.choice(["", "er", "ing"]) for _ in range(20_000))
    began = time.perf_counter()
    assert ed.levenshtein(text, text.replace("th", "t")) == text.count("th")
    found = ed.levenshtein(text, edited(rng, text, 1171, "abc th"))
    assert 1000 < found <= 1171 and time.perf_counter() - began < 10
    short = text[:6000]
    other = edited(rng, short, 500, "abc th")
    assert ed.levenshtein(short, other) == ed._table(short, other)
