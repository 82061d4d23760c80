"""Words of many texts at once, with 64-bit hashes of words and of runs of words.

A text is seen as its UTF-8 bytes. All separators are ASCII, so cutting the bytes gives the same words as cutting the
characters. Hashes are polynomials modulo 2**64 over random values of the bytes (Rabin-Karp), taken from prefix sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEED = 20240229


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (murmur finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Alphabet:
    """Which bytes belong to words, and the random value each byte counts as."""

    def __init__(self, separators: list[tuple[int, int]], lower: bool):
        self.word = np.ones(256, dtype=bool)
        for first, last in separators:
            self.word[first : last + 1] = False
        self.value = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.byte = np.arange(256, dtype=np.uint8)
        if lower:
            self.value[65:91] = self.value[97:123]
            self.byte[65:91] = np.arange(97, 123)


#: ``[^\x20\x09-\x0D]+``, unchanged and with A-Z lower-cased; ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
SPACED = Alphabet([(0x20, 0x20), (0x09, 0x0D)], lower=False)
SPACED_LOWER = Alphabet([(0x20, 0x20), (0x09, 0x0D)], lower=True)
ALNUM_LOWER = Alphabet([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], lower=True)


class Powers:
    """Powers of the base and of its inverse, kept for the longest slice so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = 1 << n.bit_length()
            steps = (np.full(n, x, dtype=np.uint64) for x in (_BASE, _INVERSE))
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(x[1:])]) for x in steps)


@dataclass
class Words:
    """Words of a run of texts: byte ranges, hashes, and the index of each text's first word (and the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    powers: Powers

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def runs(self, length: int) -> np.ndarray:
        """The hash of every ``length`` consecutive words, also over the border of two texts."""
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self._sums()[length:] - self._sums()[:n]) * self.powers.down[:n])

    def _sums(self) -> np.ndarray:
        if not hasattr(self, "_kept"):
            self.powers.grow(len(self.hashes) + 1)
            self._kept = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * self.powers.up[: len(self.hashes)])])
        return self._kept

    def whole(self, rows: np.ndarray) -> np.ndarray:
        """The hash of each given text's whole word sequence, equal to that of a run of as many words."""
        low, high = self.first[rows], self.first[rows + 1]
        return mix((self._sums()[high] - self._sums()[low]) * self.powers.down[low])

    def inside(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the runs that lie in one text, and for each text where its runs begin among them (and the end)."""
        n = np.maximum(self.counts() - length + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(n)])
        return np.arange(bounds[-1]) + np.repeat(self.first[:-1] - bounds[:-1], n), bounds

    def text(self, low: int, high: int, alphabet: Alphabet) -> bytes:
        """Words ``low`` to ``high`` joined by one space."""
        return b" ".join(alphabet.byte[self.data[a:b]].tobytes() for a, b in zip(self.starts[low:high], self.ends[low:high]))


def cut(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet, powers: Powers) -> Words:
    """Words of the texts that lie in ``data`` between the given offsets."""
    n = len(data)
    powers.grow(n + 1)
    inside = alphabet.word[data]
    # A pad stands for the border after the last byte; borders between texts part words too.
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    inner = offsets[1:]
    after[inner[inner > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(alphabet.value[data] * powers.up[:n])])
    hashes = mix((sums[ends] - sums[starts]) * powers.down[starts])
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes, powers)
