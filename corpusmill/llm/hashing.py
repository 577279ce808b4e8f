"""Vectorised hashes of words and shingles, for use inside tasks: one numpy pass over a block of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: UTF-8 bytes of text that are hashed at once; a longer text is a block of its own.
BLOCK = 1 << 22


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def blocks(sizes: list[int], most: int = BLOCK) -> Iterator[slice]:
    """Runs of rows whose sizes add up to most at the most, or single rows."""
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, k)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (a run of bytes but ASCII blanks) of all texts, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends_of_texts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    blank = _BLANK[data]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    ends = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(len(data), _BASE, _U))
        sums = np.concatenate((np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * powers, dtype=_U)))
        inverse = np.multiply.accumulate(np.full(len(data), _INVERSE, _U))
        words = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
    upto = np.searchsorted(starts, ends_of_texts)
    return words, np.diff(np.concatenate(([0], upto)))


def shingle_hashes(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of width words, repeats included, and the number of runs of each text. A text of fewer words, but of one at
    least, has one run of all its words; a text without words has none."""
    words, counts = word_hashes(texts)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])) - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    length = np.repeat(np.minimum(counts, width), n)
    padded = np.concatenate((words, np.zeros(width, _U)))
    with np.errstate(over="ignore"):
        h = np.zeros(len(first), _U)
        for k in range(width):
            h = h * _U(_BASE) + np.where(k < length, padded[first + k], _U(0x1234567))
        return mix64(h), n
