"""Document fingerprints by invertible Bloom lookup tables of paragraph digests (Goodrich and Mitzenmacher 2011; Eppstein et al. 2011 for set differences).

A text is a set of paragraph digests: 64-bit hashes of its lines, a line being cut after the ends of its sentences, so that texts of a single line have paragraphs too; the k-th repeat of a paragraph
has a digest of its own. A sketch has three tables of cells, and a digest goes into one cell of each: a cell holds how many came, the xor of the digests and the xor of their checks. Sketches of two
versions subtract cell by cell, and what is in both goes. Peeling takes a cell with one digest left, removes that digest from its three cells, and so on; when all cells are empty, the paragraphs that
differ are known, each with its side. When peeling sticks, the sketches are made again twice as large. Cells go by the low bits of hashes, so a sketch of 2 m cells folds into one of m.

Cases: null and blank texts have no paragraph; two texts without paragraphs have likeness 1, one without and one with have 0; repeated rows and ids follow each other in a fixed order, null ids last;
a table of one row has itself as the next; an empty table gives an empty result. Only the named columns are read, so further columns cannot clash."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: Cells of each of the three tables of a fingerprint; a power of two.
CELLS = 8
#: The largest tables that a comparison tries; two tables of this size hold the differences of texts of millions of paragraphs.
MOST_CELLS = 1 << 24
_CELL = np.dtype([("n", "<i2"), ("key", "<u8"), ("check", "<u4")])
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))
_LINES = bytes(10 if c == 13 else c for c in range(256))


def paragraphs(raw: bytes) -> list[bytes]:
    parts = raw.translate(_LINES).replace(b". ", b".\n").replace(b"! ", b"!\n").replace(b"? ", b"?\n").split(b"\n")
    return [p for p in map(bytes.strip, parts) if p]


def digests(raw: bytes) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(p) for p in paragraphs(raw)], np.uint64)


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[k]
    x = (x ^ (x >> np.uint64(29))) * _ODD[3]
    return x ^ (x >> np.uint64(32))


class Sets:
    """Paragraph digests of many texts: flat keys, and whose each is. Repeats within a text become keys of their own."""

    def __init__(self, keys: np.ndarray, owner: np.ndarray, n: int):
        self.keys, self.owner, self.n = keys, owner, n

    @classmethod
    def of(cls, each: list[np.ndarray]) -> Sets:
        keys = np.concatenate([*each, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        repeat = (np.arange(len(keys)) - first).astype(np.uint64)
        return cls(np.where(repeat > 0, mixed(keys + repeat * _ODD[1], 2), keys), owner, len(each))

    def sizes(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=self.n)

    def only(self, which: np.ndarray) -> Sets:
        new = np.full(self.n, -1)
        new[which] = np.arange(len(which))
        keep = new[self.owner] >= 0
        return Sets(self.keys[keep], new[self.owner[keep]], len(which))


class Sketches:
    """Sketches of n texts: arrays (n, 3 m)."""

    def __init__(self, n: int, m: int):
        self.m, self.count = m, np.zeros((n, 3 * m), np.int64)
        self.key, self.check = np.zeros((n, 3 * m), np.uint64), np.zeros((n, 3 * m), np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int) -> None:
        check = checks(keys)
        for j in range(3):
            at = owner * (3 * self.m) + j * self.m + (mixed(keys, j) & np.uint64(self.m - 1)).astype(np.int64)
            np.add.at(self.count.reshape(-1), at, sign)
            np.bitwise_xor.at(self.key.reshape(-1), at, keys)
            np.bitwise_xor.at(self.check.reshape(-1), at, check)

    @classmethod
    def of(cls, sets: Sets, m: int) -> Sketches:
        out = cls(sets.n, m)
        out.add(sets.keys, sets.owner, 1)
        return out

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.m)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def folded(self, m: int) -> Sketches:
        out, n, f = Sketches(0, m), len(self.count), self.m // m
        out.count = self.count.reshape(n, 3, f, m).sum(2).reshape(n, -1)
        out.key, out.check = (np.bitwise_xor.reduce(x.reshape(n, 3, f, m), axis=2).reshape(n, -1) for x in (self.key, self.check))
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, key, sign) of what is left in differences, emptying them, and which sketches came out empty."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = np.arange(len(self.count))
        for _ in range(4 * self.m + 64):
            one = np.abs(self.count[live]) == 1
            row, cell = np.nonzero(one)
            row = live[row]
            keys = self.key[row, cell]
            place = (mixed_by(keys, cell // self.m) & np.uint64(self.m - 1)).astype(np.int64)
            pure = (checks(keys) == self.check[row, cell]) & (place == cell % self.m)
            if not pure.any():
                break
            row, keys, sign = row[pure], keys[pure], self.count[row[pure], cell[pure]]
            order = np.lexsort((keys, row))
            row, keys, sign = row[order], keys[order], sign[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
            row, keys, sign = row[new], keys[new], sign[new]
            self.add(keys, row, -sign)
            found.append((row, keys, sign))
            live = np.unique(row)
        empty = ~(self.count.any(1) | self.key.any(1) | self.check.any(1))
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        row, keys, sign = (np.concatenate(x) for x in zip(none, *found, strict=True))
        return row, keys, sign, empty

    def packed(self) -> list[bytes]:
        out = np.empty(self.count.shape, _CELL)
        out["n"], out["key"], out["check"] = self.count, self.key, self.check
        sizes = self.count[:, : self.m].sum(1).astype("<u4")  # every digest has one cell in the first table
        return [size.tobytes() + row.tobytes() for size, row in zip(sizes, out, strict=True)]

    @classmethod
    def unpacked(cls, raw: bytes) -> tuple[int, Sketches]:
        """How many digests are in it, and the sketch."""
        cells = np.frombuffer(raw, _CELL, offset=4).reshape(1, -1)
        out = cls(0, cells.shape[1] // 3)
        out.count, out.key, out.check = cells["n"].astype(np.int64), cells["key"].copy(), cells["check"].astype(np.uint64)
        return int.from_bytes(raw[:4], "little"), out


def checks(keys: np.ndarray) -> np.ndarray:
    return mixed(keys ^ _ODD[0], 1) >> np.uint64(32)


def mixed_by(keys: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.choose(j, [mixed(keys, k) for k in range(3)]) if len(keys) else keys


def differences(a: Sets, b: Sets, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, key, side) of what is in a's set alone (side 1) or b's alone (-1), for a.n pairs, and the cells a table that each pair needed; pairs whose peeling sticks are sketched twice as large."""
    left, found, used, m = np.arange(a.n), [], np.zeros(a.n, np.int64), cells
    while len(left):
        if m > MOST_CELLS:
            raise ValueError("differences of texts do not peel")
        step, stuck = max(1, 2_000_000 // m), []
        for at in range(0, len(left), step):
            part = left[at : at + step]
            row, keys, sign, empty = Sketches.of(a.only(part), m).minus(Sketches.of(b.only(part), m)).peel()
            done = empty[row]
            found.append((part[row[done]], keys[done], sign[done]))
            used[part[empty]] = m
            stuck.append(part[~empty])
        left, m = np.concatenate(stuck), 2 * m
    pair, keys, sign = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)), *found, strict=True))
    return pair, keys, sign, used


def likeness(a: Sets, b: Sets, cells: int = CELLS) -> np.ndarray:
    """Paragraphs in common over paragraphs in all, by what the sketches' difference leaves."""
    pair, _, side, _ = differences(a, b, cells)
    of_a, of_b = a.sizes(), b.sizes()
    both = of_a - np.bincount(pair[side > 0], minlength=a.n)
    every = of_a + of_b - both
    return np.where(every > 0, both / np.maximum(every, 1), 1.0)


def from_fingerprints(a: str, b: str) -> float | None:
    """Likeness by two fingerprints alone (also of different sizes); None if their difference is too large for them."""
    (of_a, x), (of_b, y) = (Sketches.unpacked(base64.b64decode(s)) for s in (a, b))
    m = min(x.m, y.m)
    left = x.folded(m).minus(y.folded(m))
    left.count = (left.count + (1 << 15)) % (1 << 16) - (1 << 15)  # counts are stored in 16 bits
    _, _, sign, empty = left.peel()
    if not empty[0]:
        return None
    both = of_a - int((sign > 0).sum())
    return both / (of_a + of_b - both) if of_a + of_b > both else 1.0


def compare_versions(versions: DataFrame, key: str, old: str, new: str, cells: int = CELLS) -> DataFrame:
    """(key, removed, added, likeness, cells): for each row the digests of the paragraphs that only the old and only the new text hold, and the size of table that it took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, olds in slices(batches, "__old"):
            news = batch.column(batch.schema.get_field_index("__new")).cast(pa.binary()).to_pylist()
            a, b = (Sets.of([digests(t or b"") for t in x]) for x in (olds, news))
            pair, keys, side, used = differences(a, b, cells)
            lists = []
            for s in (1, -1):
                own = np.flatnonzero(side == s)
                own = own[np.lexsort((keys[own].view(np.int64), pair[own]))]
                ends = np.concatenate(([0], np.cumsum(np.bincount(pair[own], minlength=a.n)))).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[own].view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), *lists, pa.array(likeness(a, b, cells)), pa.array(used)], [key, "removed", "added", "likeness", "cells"])

    rows = versions.select(key, F.col(old).alias("__old"), F.col(new).alias("__new"))
    return rows.mapInArrow(run, f"{rows.schema[key].name} {rows.schema[key].dataType.simpleString()}, removed array<long>, added array<long>, likeness double, cells long")


class _Text:
    def __init__(self, id_: int | None, raw: bytes | None):
        self.id, self.raw = id_, raw or b""
        self.text, self.digests = self.raw.decode(), digests(self.raw)


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to as many, or all, of the following text's first."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


_OUT = "id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, at int, kind int, text string"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
DONE, FIRST, OPEN = 0, 1, 2


def _rows(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _results(own: list[_Text], following: list[_Text]) -> pa.RecordBatch:
    new = [edited(a.text, b.text).encode() for a, b in zip(own, following, strict=True)]
    a, e, b = Sets.of([x.digests for x in own]), Sets.of([digests(x) for x in new]), Sets.of([x.digests for x in following])
    n, none = len(own), [None] * len(own)
    columns = [[x.id for x in own], [len(x.text) for x in own], [hashlib.sha256(x).hexdigest() for x in new], Sketches.of(a, CELLS).packed(), Sketches.of(e, CELLS).packed(), likeness(a, e).tolist(), likeness(a, b).tolist(), none, [DONE] * n, none]
    return _rows(columns)


def _edge(x: _Text, kind: int, at: int) -> pa.RecordBatch:
    return _rows([[x.id], *([None] for _ in range(6)), [at], [kind], [x.text]])


def _sorted_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a sorted range with the one after it; the first text and the last one, whose follower is in another range, are put out as they are."""
    at, last = TaskContext.get().partitionId(), None
    for batch, texts in slices(batches, "text"):
        some = [_Text(i, t) for i, t in zip(batch.column(batch.schema.get_field_index("id")).to_pylist(), texts, strict=True)]
        if some and last is None:
            yield _edge(some[0], FIRST, at)
        chain = some if last is None else [last, *some]
        if len(chain) > 1:
            yield _results(chain[:-1], chain[1:])
        last = chain[-1] if chain else last
    if last is not None:
        yield _edge(last, OPEN, at)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open texts with the first text of the range after theirs."""
    for batch, texts in slices(batches, "text"):
        following = batch.column(batch.schema.get_field_index("following")).cast(pa.binary()).to_pylist()
        ids = batch.column(batch.schema.get_field_index("id")).to_pylist()
        yield _results([_Text(i, t) for i, t in zip(ids, texts, strict=True)], [_Text(None, t) for t in following])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row; the next document is that of the next id, the first after the last.

    One shuffle carries the texts: rows are range-sorted by id, so that a text meets its follower inside its range; range ends (a text or two a range) are joined afterwards."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    order = (F.asc_nulls_last("id"), F.asc("h"), F.asc("row"))
    found = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text").mapInArrow(_sorted_range, _OUT))
    starts = sorted(r[0] for r in found.filter(F.col("kind") == FIRST).select("at").collect())  # one number a range
    after = docs.sparkSession.createDataFrame([(a, starts[(k + 1) % len(starts)]) for k, a in enumerate(starts)], "at int, then int")
    firsts = found.filter(F.col("kind") == FIRST).select(F.col("at").alias("then"), F.col("text").alias("following"))
    ends = found.filter(F.col("kind") == OPEN).select("id", "text", "at").join(F.broadcast(after), "at").join(firsts, "then").select("id", "text", "following").mapInArrow(_across, _OUT)
    every = found.filter(F.col("kind") == DONE).unionByName(ends)
    text = lambda name: F.translate(F.base64(F.col(name)), "\r\n", "").alias(name)
    return every.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")
