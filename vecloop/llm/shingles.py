"""Words and word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
# Fixed odd numbers: a base for word hashes and its inverse modulo 2^64, then the mixer's.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finishing steps of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class _Powers:
    forward = np.ones(1, np.uint64)
    backward = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.forward) < n:
            size = max(n, 1 << 20)
            steps = np.full(size, _BASE, np.uint64)
            steps[0] = 1
            back = np.full(size, _INVERSE, np.uint64)
            back[0] = 1
            cls.forward, cls.backward = np.cumprod(steps), np.cumprod(back)
        return cls.forward[:n], cls.backward[:n]


class Words:
    """Words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) of a block of texts.

    ``start`` and ``stop`` are byte positions in ``raw``, ``doc`` the text's number, ``hash`` the word's.
    """

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts)
        data = np.frombuffer(self.raw, np.uint8)
        self.texts = len(texts)
        blank = np.ones(len(data) + 2, bool)
        blank[1:-1] = _BLANK[data]
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        self.start, self.stop = edges[::2], edges[1::2]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, int)
        self.doc = np.searchsorted(begins, self.start, "right") - 1
        forward, backward = _Powers.upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LOWER[data] * forward[: len(data)], out=sums[1:])
        self.hash = mix((sums[self.stop] - sums[self.start]) * backward[self.start])

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (number of the first word) and hashes of all runs of ``size`` words in one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, int), np.zeros(0, np.uint64)
        place = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        total = np.zeros(n, np.uint64)
        for j in range(size):
            total = (total ^ self.hash[j : j + n]) * _MIX2 + np.uint64(_BASE)
        return place, mix(total[place])

    def text(self, place: int, size: int) -> str:
        """A shingle's words, lower-cased and joined by single spaces."""
        raw = self.raw[self.start[place] : self.stop[place + size - 1]]
        return b" ".join(raw.lower().split()).decode("utf-8")


def blocks(texts: Iterable[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about ``most`` bytes, with the number of each run's first; a longer text is a run of its own."""
    held: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        if held and size + len(text) > most:
            yield first, held
            held, size, first = [], 0, i
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held
