"""Word shingles as 64-bit hashes, and their sets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
_GAP = re.compile(rb"[\x09-\x0d\x20]")
_seeded = np.random.default_rng(20_011)
#: A random number for every byte, A-Z as a-z.
_BYTE = _seeded.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = _seeded.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_LENGTH = _seeded.integers(0, 1 << 63, 64, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << (n - 1).bit_length()
        for name, x in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, x, dtype=np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word: runs of bytes other than white space, A-Z as a-z. Long texts go in pieces cut between words."""
    if len(text) <= PIECE:
        return _hashes(text)
    found, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        found.append(_hashes(text[at:end]))
        at = end
    return np.concatenate(found)


def _hashes(text: bytes) -> np.ndarray:
    raw = np.frombuffer(b" " + text + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    begins, ends = edge[::2], edge[1::2]
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """The distinct n-word shingles, sorted; with fewer words the whole sequence is one; without words the set is empty."""
    words = word_hashes(text)
    if not len(words):
        return words
    if len(words) < n:
        return mix((words * _WORD[: len(words)]).sum(keepdims=True, dtype=np.uint64) + _LENGTH[len(words)])
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * _WORD[i]
    return np.unique(mix(total))


def sets_of(texts: Iterator[str], n: int) -> Iterator[np.ndarray]:
    for t in texts:
        yield shingle_set(t.encode(), n)
