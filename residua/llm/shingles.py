"""Words and shingles as 64-bit hashes, computed for a whole batch of texts at once."""

from __future__ import annotations

import numpy as np

#: A table of random words for bytes, and an odd base with its inverse modulo 2**64, from a fixed seed.
_RANDOM = np.random.default_rng(20240229)
BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RANDOM.integers(0, 1 << 62)) * 4 + 5
INVERSE = pow(BASE, -1, 1 << 64)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.ones(1, np.uint64)
        while len(known) < n:
            known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
        if n <= SLICE:
            _POWERS[base] = known
    return known[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of BYTE[data[t]] * BASE**t over i <= t < j."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever the bytes stand."""
    down = powers(INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * M2)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not white space."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~BLANK[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts one after the other, and the number of words of each text."""
    hashes, counts, at = [], [], 0
    while at < len(texts):
        size, end = len(texts[at]) + 1, at + 1
        while end < len(texts) and size + len(texts[end]) < SLICE:
            size += len(texts[end]) + 1
            end += 1
        data = np.frombuffer(b"\n".join(texts[at:end]) + b"\n", np.uint8)
        starts, ends = word_spans(data)
        hashes.append(range_hashes(prefix_hashes(data), starts, ends))
        limits = np.cumsum([len(t) + 1 for t in texts[at:end]])
        counts.append(np.diff(np.searchsorted(starts, limits), prepend=0))
        at = end
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of n words."""
    out = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for i in range(n):
        out = mix(out * M1 + words[i : len(words) - n + 1 + i])
    return out


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer than n words the whole sequence is one shingle."""
    words, counts = word_hashes(texts)
    everything = gram_hashes(words, n)
    out, at = [], 0
    for count in counts:
        if count >= n:
            grams = np.unique(everything[at : at + count - n + 1])
        elif count:
            grams = gram_hashes(words[at : at + count], int(count))
        else:
            grams = np.zeros(0, np.uint64)
        out.append(grams)
        at += count
    return out
