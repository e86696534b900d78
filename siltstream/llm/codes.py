"""Hashes of words and shingles over whole batches of texts, in numpy.

A word is a maximal run of letters and digits, compared in lower case. A batch of texts is one array of code
points; a word's hash is a difference of prefix sums of a polynomial, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters taken at a time, to bound memory; a longer text is taken alone and whole.
CHARS = 600_000
# An odd multiplier and the constants of a 64-bit finaliser.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
HIGHEST = 0x323B0  # no letters or digits lie beyond, but for the tag and variation blocks


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_A
    x ^= x >> np.uint64(29)
    x = x * MIX_B
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point the code of its lower case if it is a letter or digit, else 0."""
    table = np.zeros(HIGHEST + 1, np.uint32)
    for code in range(HIGHEST):
        c = chr(code)
        if c.isalnum():
            table[code] = ord(c.lower()[0])
    return table


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """For each code point a random number if it is a letter or digit, else 0."""
    table = letters()
    return np.where(table > 0, mix(table.astype(np.uint64) + BASE) | np.uint64(1), np.uint64(0))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE), np.full(n, BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1, and its inverse to the same."""
    size = CHARS + 1024 if n <= CHARS + 1024 else n
    up, down = _powers(size)
    return up[:n], down[:n]


def code_points(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(codes, HIGHEST)


def parcels(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about CHARS characters."""
    begin = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > CHARS:
            yield begin, k
            begin, size = k, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each values[start:end], the same wherever the segment stands."""
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX_B)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts in a row, and how many each text has."""
    joined = "\n".join(texts)
    values = gear()[code_points(joined)]
    inside = values != 0
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.r_[0, np.cumsum(lengths)]
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    return segment_hashes(values, starts, ends), counts


def shingle_sets(texts: list[str], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each text the number of its words and the sorted set of its shingles as signed 64-bit hashes."""
    for begin, end in parcels(texts):
        words, counts = word_hashes(texts[begin:end])
        shingles = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            shingles = mix(shingles * BASE + words[k : len(words) - width + 1 + k])
        shingles = shingles.view(np.int64)
        at = 0
        for count in counts.tolist():
            yield count, np.unique(shingles[at : at + max(0, count - width + 1)])
            at += count
