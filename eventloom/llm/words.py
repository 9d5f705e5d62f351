"""Words of a text and fingerprints of their runs, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
#: An odd multiplier and the steps of the splitmix64 finalizer.
MULTIPLIER = 0x9E3779B97F4A7C15
MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
CACHED_WORDS = 80_000


def split_words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, as UTF-8."""
    return text.encode().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> _U(30))) * MIX[0]
    x = (x ^ (x >> _U(27))) * MIX[1]
    return x ^ (x >> _U(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hash_of = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash_of.__getitem__, words), _U, len(words))


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[_U(1), np.full(size - 1, MULTIPLIER, _U)], dtype=_U)
                self.down = np.cumprod(np.r_[_U(1), np.full(size - 1, pow(MULTIPLIER, -1, 1 << 64), _U)], dtype=_U)
        return self.up[:n], self.down[:n]


_powers = _Powers()


class Runs:
    """Fingerprints of all runs of words of a document, each in constant time."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        self.up, down = _powers.upto(self.n + 1)
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum(hashes * down[: self.n], out=self.sums[1:])

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.up[start]

    def every(self, length: int) -> np.ndarray:
        """Of the run at each start that has ``length`` words."""
        n = max(0, self.n - length + 1)
        return (self.sums[length : length + n] - self.sums[:n]) * self.up[:n]
