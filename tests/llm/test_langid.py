"""Language ID in several scripts, and its kernel against plain sets."""

import math
import random

import numpy as np
import pytest

from vecloop.llm import langid


def scripts():
    """Letters of eight invented languages; two pairs share a script, two write with hundreds of signs."""
    rng = random.Random(6)
    latin, cyrillic, greek = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
    han = [chr(c) for c in rng.sample(range(0x4E00, 0x9FA5), 1300)]
    hangul = [chr(c) for c in rng.sample(range(0xAC00, 0xD7A3), 700)]
    syllables = lambda letters: ["".join(rng.choices(letters, k=2)) for _ in range(40)]
    return {
        "l1": syllables(latin), "l2": syllables(latin), "c1": syllables(cyrillic), "c2": syllables(cyrillic),
        "gr": syllables(greek), "h1": han[:600], "h2": han[600:1200], "ko": hangul,
    }


def make(parts, size, rng):
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(size)).capitalize()


@pytest.mark.parametrize("words", [15, 60])
def test_every_script_is_known(words):
    rng, parts = random.Random(2), scripts()
    sample = [(lang, make(p, 40, rng)) for lang, p in parts.items() for _ in range(120)]
    model = langid.fit(sample)
    for lang, p in parts.items():
        said = model.predict([make(p, words, rng) for _ in range(40)])[0]
        assert said.count(lang) >= 38, (lang, said)


def test_kernel_equals_plain_sets():
    rng, parts = random.Random(3), scripts()
    sample = [(lang, make(p, 12, rng)) for lang, p in parts.items() for _ in range(5)]
    model = langid.fit(sample, langid.Settings(grams=10**6))
    texts = [t for _, t in sample[::3]] + ["A1b2 中!", "  ", "x"]

    def grams(text, n):
        letters = "".join(c.lower() if c.isalpha() else " " for c in text)
        return {s[i : i + n] for s in [" ".join([*letters.split(), ""])] for i in range(len(s) - n + 1)}

    known = {n: set().union(*[grams(t, n) for _, t in sample]) for n in (1, 2, 3)}

    def kernel(x, y):
        total = 0
        for n in (1, 2, 3):
            a, b = grams(x, n) & known[n], grams(y, n) & known[n]
            total += len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1)) / 3
        return total

    features = model.spectrum.presence(texts)
    expected = [[kernel(x, y) for y in texts] for x in texts]
    some = [k for k, t in enumerate(texts) if t.strip() and all(c.lower() in set("".join(x for _, x in sample).lower()) or not c.isalpha() for c in t)]
    np.testing.assert_allclose((features @ features.T)[np.ix_(some, some)], np.array(expected)[np.ix_(some, some)], atol=1e-5)


def test_little_to_learn_from():
    assert langid.fit([]).predict(["abc", None]) == (["und", "und"], [0.0, 0.0])
    one = langid.fit([("en", "some words")] * 3)
    langs, scores = one.predict(["other words", "1 2", "", None])
    assert langs == ["en", "und", "und", "und"] and all(0 <= s <= 1 for s in scores)
