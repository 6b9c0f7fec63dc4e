"""Upper bounds of the Jaccard similarity of two sets by hashed bitmaps.

A bitmap holds, for each bit, the parity of how many elements hash to it. Two sets differ in at least as many elements as their bitmaps differ in bits. Bitmaps have as many bits as
their set has elements (a power of two, from BITS to a cap); the longer of two is folded by xor, bit i of the folded one being the xor of bits i, i + width, i + 2 width, ..."""

from __future__ import annotations

import numpy as np

BITS = 256


def bitmap(x: np.ndarray, most: int, least: int = BITS, fill: int = 1) -> np.ndarray:
    """The bitmap of distinct hashes as longs, of fill bits an element or more."""
    width = min(max(least, 1 << (fill * len(x) - 1).bit_length()), most) if len(x) else least
    parity = (np.bincount((x & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.uint64)


def fits(na: np.ndarray, nb: np.ndarray, apart: np.ndarray | int, percent: int) -> np.ndarray:
    """J >= t <=> overlap >= t (na + nb) / (1 + t), and overlap <= (na + nb - bits that differ) / 2."""
    return (na + nb - apart) * (100 + percent) >= 2 * percent * (na + nb)


class Bitmaps:
    """Bitmaps of many sets, of powers of two longs each, for bounds of many pairs at once."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray):
        """flat: the longs of all; ends: where each ends."""
        width = np.diff(ends, prepend=0)
        self.width, self.at, self.by = width, np.zeros(len(width), np.int64), {}
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            self.at[own] = np.arange(len(own))
            self.by[w] = flat[(ends[own] - w)[:, None] + np.arange(w)]
        self.narrow = self.folded(np.arange(len(width)), BITS // 64) if len(width) else np.zeros((0, BITS // 64), np.uint64)

    def folded(self, rows: np.ndarray, w: int) -> np.ndarray:
        out, width = np.empty((len(rows), w), np.uint64), self.width[rows]
        for v in np.unique(width).tolist():
            own = np.flatnonzero(width == v)
            out[own] = np.bitwise_xor.reduce(self.by[v][self.at[rows[own]]].reshape(len(own), v // w, w), axis=1)
        return out

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits that differ, of the pairs' shorter length."""
        out, least = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for w in np.unique(least).tolist():
            own = np.flatnonzero(least == w)
            for part in np.array_split(own, len(own) * w // 4_000_000 + 1):
                out[part] = np.bitwise_count(self.folded(i[part], w) ^ self.folded(j[part], w)).sum(1, dtype=np.int64)
        return out

    def similar(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs can be similar: by BITS bits first, then by all."""
        can = np.flatnonzero(fits(n[i], n[j], np.bitwise_count(self.narrow[i] ^ self.narrow[j]).sum(1, dtype=np.int64), percent))
        more = can[np.minimum(self.width[i[can]], self.width[j[can]]) > BITS // 64]
        out = np.zeros(len(i), bool)
        out[can] = True
        out[more] = fits(n[i[more]], n[j[more]], self.apart(i[more], j[more]), percent)
        return out
