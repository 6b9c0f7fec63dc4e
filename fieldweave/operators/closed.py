"""Common neighbours of linked nodes, by products of blocks of bit rows.

Wedges are as many as the cube of the nodes at a given density, so they are never rows. Tasks pack the links that they have into lists of neighbours; nodes are dealt into blocks, and a task gets the lists of
two blocks, turns them into rows of bits and counts, for each link between the blocks, the bits that both of its ends have. Only lists of neighbours are written, and shuffled once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import drop, settle

#: Links that a task packs at once, bytes of the lists and bits of two blocks, about, words of the rows that are counted at once, and rows that are turned into bits at once.
PACK, BLOCK_BYTES, AT_ONCE, STRIP = 4_000_000, 256 << 20, 1 << 16, 64
_GAP = 32767
_LANES = np.uint64(0x00FF00FF00FF00FF)
_SHORT = np.uint64(0xFFFF)
OUT, IN, BOTH = 1, 2, 3


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of ints as sorted distinct numbers in the same order."""
    up = lambda x: (x.astype(np.int64) + (1 << 31)).astype(np.uint64)
    key = np.sort((up(a) << np.uint64(32)) | up(b))
    return key[np.concatenate((np.ones(1, bool), key[1:] != key[:-1]))]


def _lists(key: np.ndarray, way: int) -> pa.RecordBatch:
    down = lambda x: (x.astype(np.int64) - (1 << 31)).astype(np.int32)
    node, other = down(key >> np.uint64(32)), down(key & np.uint64(0xFFFFFFFF))
    gap = np.diff(other.astype(np.int64), prepend=0)
    new = np.ones(len(key), bool)
    new[1:] = (node[1:] != node[:-1]) | (gap[1:] > _GAP)
    at = np.flatnonzero(new)
    off = np.concatenate((at - np.arange(len(at)), [len(key) - len(at)])).astype(np.int32)
    gaps = pa.ListArray.from_arrays(pa.array(off), pa.array(gap[~new].astype(np.int16)))
    return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(np.full(len(at), way, np.int32)), pa.array(other[at]), gaps], names=["node", "way", "first", "gaps"])


def packed(edges: DataFrame) -> DataFrame:
    """(node, way, first, gaps): pieces of the sorted lists of the nodes that a node has an edge to (way OUT), from (IN) or both, as the first and the steps to the next. Loops are left out; pieces may overlap."""

    def lists(src: np.ndarray, dst: np.ndarray) -> Iterator[pa.RecordBatch]:
        out, back = _keys(src, dst), _keys(dst, src)
        if np.array_equal(out, back):  # edges that come with their reverses
            parts = [(out, BOTH)]
        else:
            both = np.intersect1d(out, back, assume_unique=True)
            parts = [(np.setdiff1d(out, both, True), OUT), (np.setdiff1d(back, both, True), IN), (both, BOTH)]
        for key, way in parts:
            whole = _lists(key, way) if len(key) else None
            yield from (whole.slice(at, 10_000) for at in range(0, whole.num_rows if whole else 0, 10_000))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n >= PACK:
                yield from lists(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from lists(*map(np.concatenate, zip(*held, strict=True)))

    ends = edges.filter("src <> dst").select(F.col("src").cast("int"), F.col("dst").cast("int"))
    return ends.mapInArrow(pack, "node int, way int, first int, gaps array<smallint>")


def repeats(edges: DataFrame) -> DataFrame:
    """(n), one row: how many edges (src, dst int) are there again. Tasks sort what they have and shuffle lists at two bytes an edge, where numbers lie close; a node's lists meet in one row."""

    def some(src: np.ndarray, dst: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = _keys(src, dst)
        whole = _lists(key, OUT).drop_columns("way")
        again = np.zeros(whole.num_rows, np.int64)
        again[0] = len(src) - len(key)
        whole = whole.append_column("again", pa.array(again))
        yield from (whole.slice(at, 10_000) for at in range(0, whole.num_rows, 10_000))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n >= PACK:
                yield from some(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from some(*map(np.concatenate, zip(*held, strict=True)))

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = int(b["again"].sum())
            for pieces in (p for p in b["pieces"] if len(p) > 1):
                ids = np.concatenate([np.cumsum(np.concatenate(([p["first"]], p["gaps"])), dtype=np.int64) for p in pieces])
                n += len(ids) - len(np.unique(ids))
            yield pd.DataFrame({"n": [n]})

    ends = edges.select(F.col("src").cast("int"), F.col("dst").cast("int"))
    lists = ends.mapInArrow(pack, "node int, first int, gaps array<smallint>, again long")
    per = lists.groupBy("node").agg(F.collect_list(F.struct("first", "gaps")).alias("pieces"), F.sum("again").alias("again"))
    return per.select("pieces", "again").mapInPandas(met, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


class _Block(NamedTuple):
    """Some nodes' lists, by node: of the k-th list its node, way, first number and length, and the steps of all lists end to end."""

    node: np.ndarray
    way: np.ndarray
    first: np.ndarray
    size: np.ndarray
    gaps: np.ndarray


_BLOCK = {"node": np.int32, "way": np.int8, "first": np.int32, "size": np.int32, "gaps": np.int16}


class _Rows:
    """The lists of one or two blocks as rows of bits: `any` where there is an edge either way, `both` where there are both, None if that is the same."""

    def __init__(self, blocks: dict[int, _Block]) -> None:
        node, way, first, size, gaps = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*blocks.values(), strict=True))
        of = np.repeat(list(blocks), [len(x.node) for x in blocks.values()])
        start = np.flatnonzero(np.concatenate((np.ones(1, bool), node[1:] != node[:-1])))
        self.node, self.block = node[start], of[start]
        ends, step = np.append(start, len(node)), np.concatenate(([0], np.cumsum(size - 1, dtype=np.int64)))
        strips = [slice(ends[k], ends[min(k + STRIP, len(start))]) for k in range(0, len(start), STRIP)]
        listed = lambda s: self._ids(first[s], gaps[step[s.start] : step[s.stop]], size[s])
        lo, hi = min(int(first.min()), int(node.min())), max(int(node.max()), max(int(listed(s).max()) for s in strips))
        if hi - lo < max(1 << 24, 8 * int(size.sum(dtype=np.int64))):
            seen = np.zeros(hi - lo + 1, bool)
            for s in strips:
                seen[listed(s) - lo] = True
            seen[self.node.astype(np.int64) - lo] = True
            place = np.cumsum(seen, dtype=np.int32) - 1
            width, find = int(seen.sum()), lambda x: place[x - lo]
        else:
            known = np.sort(self.node)
            for s in strips:
                known = np.union1d(known, listed(s))
            width, find = len(known), lambda x: np.searchsorted(known, x)
        self.column = find(self.node.astype(np.int64))
        words = -(-width // 512) * 8
        self.any, self.both = (np.zeros((len(self.node), words), np.uint64) for _ in range(2))
        for k, s in zip(range(0, len(start), STRIP), strips, strict=True):
            row = np.repeat(np.repeat(np.arange(len(start[k : k + STRIP])), np.diff(ends[k : k + STRIP + 1])), size[s])
            ids, ways = find(listed(s)), np.repeat(way[s], size[s])
            planes = np.zeros((2, len(start[k : k + STRIP]), words * 64), np.uint8)
            planes[0, row[ways != IN], ids[ways != IN]] = 1
            planes[1, row[ways != OUT], ids[ways != OUT]] = 1
            out, back = (np.packbits(p, axis=1, bitorder="little").view(np.uint64) for p in planes)
            self.any[k : k + STRIP], self.both[k : k + STRIP] = out | back, out & back
        self.k, self.r = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (self.any, self.both))
        self.symmetric = bool((self.k == self.r).all())
        if self.symmetric:
            self.both = self.any

    def room(self) -> tuple[np.ndarray, np.ndarray]:
        shape = max(1, AT_ONCE // self.any.shape[1]), self.any.shape[1]
        return np.empty(shape, np.uint64), np.empty(shape, np.uint8)

    @staticmethod
    def _ids(first: np.ndarray, gaps: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of lists, end to end."""
        flat, at = np.empty(int(size.sum()), np.int64), np.cumsum(size) - size
        head = np.zeros(len(flat), bool)
        head[at] = True
        flat[head], flat[~head] = first, gaps
        run = np.cumsum(flat)
        return run - np.repeat(run[at] - first, size)

    def links(self, p: int, q: int) -> Iterator[tuple[int, np.ndarray]]:
        """The row of each node of block p, and the rows of those of block q that it is linked to; within a block each link once."""
        of_q = np.flatnonzero(self.block == q)
        word, bit = self.column[of_q] >> 6, (self.column[of_q] & 63).astype(np.uint64)
        for i in np.flatnonzero(self.block == p):
            to = of_q[((self.any[i, word] >> bit) & np.uint64(1)).astype(bool)]
            to = to[to > i] if p == q else to
            if len(to):
                yield i, to


def _shared(row: np.ndarray, rows: np.ndarray, which: np.ndarray, room: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many bits a row has in common with each of some rows. Counts of bytes are added as four lanes of 16 bits of a word."""
    out = np.zeros(len(which), np.int64)
    step = len(room[0])
    for at in range(0, len(which), step):
        w = which[at : at + step]
        both, ones = room[0][: len(w)], room[1][: len(w)]
        np.take(rows, w, axis=0, out=both, mode="clip")
        np.bitwise_and(both, row, out=both)
        np.bitwise_count(both, out=ones)
        eight = ones.view(np.uint64)
        for a in range(0, eight.shape[1], 256):  # 256 words of two counts of at most 64 a lane stay under 65,536
            x = eight[:, a : a + 256]
            four = ((x & _LANES) + ((x >> np.uint64(8)) & _LANES)).sum(1, dtype=np.uint64)
            for lane in range(4):
                out[at : at + len(w)] += ((four >> np.uint64(16 * lane)) & _SHORT).astype(np.int64)
    return out


def _counted(rows: _Rows, key: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A row, the rows that it is linked to, and the common neighbours of both ends."""
    room = rows.room()
    for i, to in rows.links(*key):
        yield i, to, _shared(rows.any[i], rows.any, to, room)


def _blocks(edges: DataFrame, blocks: int | None) -> DataFrame:
    """The lists of neighbours with each node's in one row, a row a block of nodes, written: (block, and the numbers of a _Block as bytes)."""
    lists = settle(packed(edges))
    if blocks is None:
        n, values = lists.agg(F.countDistinct("node"), F.coalesce(F.sum(F.size("gaps") + 1), F.lit(0))).first()
        blocks = max(8, math.ceil((4 * values + n * n / 4) / BLOCK_BYTES))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for b in batches:
            block = b.column(0).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z > a:
                    if held and block[a] != of:
                        yield row(of, held)
                        held = []
                    of = int(block[a])
                    held.append(b.slice(a, z - a))
        if held:
            yield row(of, held)

    def row(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        numbers = [np.concatenate([b.column(k).to_numpy() for b in held]) for k in (1, 2, 3)]
        numbers.append(np.concatenate([np.diff(b.column(4).offsets.to_numpy()) + 1 for b in held]))
        numbers.append(np.concatenate([b.column(4).flatten().to_numpy() for b in held]))
        raw = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(numbers, _BLOCK.values(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *raw], names=["block", *_BLOCK])

    z = lists.select(F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), "node", "way", "first", "gaps")
    out = settle(z.repartition(blocks, "block").sortWithinPartitions("block", "node").mapInArrow(met, "block int, " + ", ".join(f"{name} binary" for name in _BLOCK)))
    drop(lists)
    return out


def _products(edges: DataFrame, blocks: int | None, kernel: Callable[[_Rows, tuple[int, int]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What the kernel makes of each pair of blocks. Pairs are a product of the written blocks with themselves without a shuffle: a task reads two of its parts."""
    table = _blocks(edges, blocks)
    a, b = (table.select(*(F.col(c).alias(f"{c}_{side}") for c in table.columns)) for side in "ab")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                read = {}
                for at in (0, 1 + len(_BLOCK)):
                    raw = (batch.column(at + 1 + i)[k].as_buffer() for i in range(len(_BLOCK)))
                    read[batch.column(at)[k].as_py()] = _Block(*(np.frombuffer(x, kind) for x, kind in zip(raw, _BLOCK.values(), strict=True)))
                key = (batch.column(0)[k].as_py(), batch.column(1 + len(_BLOCK))[k].as_py())
                for found in kernel(_Rows(read), key):
                    yield from pa.Table.from_pandas(found, preserve_index=False).to_batches()

    return a.hint("shuffle_replicate_nl").join(b, F.col("block_a") <= F.col("block_b")).mapInArrow(some, schema)


def of_links(edges: DataFrame, blocks: int | None = None) -> DataFrame:
    """(src, dst, src_k, dst_k, t), src < dst: each linked pair once, whichever way its edges go, with the neighbours of either end and those that they have in common."""

    def some(rows: _Rows, key: tuple[int, int]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for i, to, t in _counted(rows, key):
            held.append((np.full(len(to), i), to, t))
            n += len(to)
            if n >= 1 << 18:
                yield table(rows, held)
                held, n = [], 0
        if n:
            yield table(rows, held)

    def table(rows: _Rows, held: list) -> pd.DataFrame:
        i, j, t = map(np.concatenate, zip(*held, strict=True))
        less = rows.node[i] < rows.node[j]
        a, b = np.where(less, i, j), np.where(less, j, i)
        return pd.DataFrame({"src": rows.node[a], "dst": rows.node[b], "src_k": rows.k[a], "dst_k": rows.k[b], "t": t})

    return _products(edges, blocks, some, "src int, dst int, src_k long, dst_k long, t long")


def of_nodes(edges: DataFrame, blocks: int | None = None) -> DataFrame:
    """(node, k, r, triangles, cubes, forman) of the nodes that have links: neighbours, those with edges both ways, triangles, the diagonal of (A + A^T)^3, and the sum of 4 - k_u - k_v + 3 t_uv over its
    links. Tasks put out sums by node."""

    def some(rows: _Rows, key: tuple[int, int]) -> Iterator[pd.DataFrame]:
        n, same = len(rows.node), key[0] == key[1]
        t, c, f = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        room = rows.room()
        for i, to, common in _counted(rows, key):
            curved = 4 - rows.k[i] - rows.k[to] + 3 * common
            if rows.symmetric:
                cubes = 8 * common
            else:
                more = _shared(rows.any[i], rows.both, to, room) + _shared(rows.both[i], rows.any, to, room) + _shared(rows.both[i], rows.both, to, room)
                at = rows.column[to]
                cubes = (1 + ((rows.both[i, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)) * (common + more)
            for total, x in ((t, common), (c, cubes), (f, curved)):
                total[i] += x.sum()
                total[to] += x  # a row links to another once
        yield pd.DataFrame({"node": rows.node, "k": rows.k if same else np.zeros(n, np.int64), "r": rows.r if same else np.zeros(n, np.int64), "t": t, "c": c, "f": f})

    sums = _products(edges, blocks, some, "node int, k long, r long, t long, c long, f long").groupBy("node").agg(*(F.sum(x).alias(x) for x in "krtcf"))
    return sums.select("node", "k", "r", (F.col("t") / 2).cast("long").alias("triangles"), F.col("c").alias("cubes"), F.col("f").alias("forman"))
