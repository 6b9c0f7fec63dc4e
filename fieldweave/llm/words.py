"""Hashes of words, computed over whole batches of texts at once."""

from __future__ import annotations

import numpy as np

_B, _M = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_POW = [np.ones(1, np.uint64)]
#: Fixed values: [\x20\x09-\x0D], and A-Z lower-cased.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def powers(n: int) -> np.ndarray:
    if len(_POW[0]) < n:
        _POW[0] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, _B, np.uint64))), dtype=np.uint64)
    return _POW[0]


def word_hashes(texts: list[bytes | None], fold: bytes | None = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, in order, and the number of words of each text."""
    size = np.array([len(t or b"") + 1 for t in texts], np.int64)
    blob = b"\n".join([*(t or b"" for t in texts), b""])
    data = np.frombuffer(blob.translate(fold) if fold else blob, np.uint8)
    inside = ~BLANK[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    length = ends - starts
    at = np.flatnonzero(inside)
    begin = np.cumsum(length) - length
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[at - np.repeat(starts, length)]
    h = np.add.reduceat(terms, begin) ^ length.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * _M
    h ^= h >> np.uint64(29)
    owner = np.searchsorted(np.cumsum(size), starts, side="right")
    return h, np.bincount(owner, minlength=len(texts))


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def gram_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """The sorted distinct n-grams of each text; fewer words than n are one gram of the whole sequence."""
    ids, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    width = np.minimum(counts, n)
    out = []
    full = _grams(ids, n) if len(ids) >= n else ids[:0]
    for end, count, m in zip(ends.tolist(), counts.tolist(), width.tolist(), strict=True):
        start = end - count
        out.append(distinct(full[start : end - n + 1]) if m == n else _grams(ids[start:end], m) if m else ids[:0])
    return out


def _grams(ids: np.ndarray, m: int) -> np.ndarray:
    out = np.full(len(ids) - m + 1, m, np.uint64)
    for j in range(m):
        out = (out ^ ids[j : len(ids) - m + 1 + j]) * np.uint64(_B)
        out ^= out >> np.uint64(29)
    return out
