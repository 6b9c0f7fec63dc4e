"""Benchmark decontamination with a generalised suffix automaton.

All test items, as sequences of normalised words, go into one automaton; training words stream through it, and the longest match that ends at each word is
tracked, cut back to the window length. A window of the item length (or window words) that matches in full marks its words as hit.

The automaton is broadcast, so its size is bounded: items are dealt into shards of at most SHARD_WORDS words, one pass over the documents each, and the passes' spans
are merged per row, by a number that the rows get in a table. Words and items are never dropped.

Cases: null or wordless texts and items hit nothing; repeated rows are rows of their own; repeated items count by distinct item_id; a null item_id reads as
an empty string; an empty table on either side gives no hits. Only the named columns are read."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

WINDOW, SHARD_WORDS = 10, 400_000
#: A-Z lower-cased; what [\x00-\x2F\x3A-\x60\x7B-\x7F] holds after that becomes a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers. Per state: transitions, suffix link, length, and the windows that end there."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        seqs = [(k, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for k, words in items if words]
        for _, seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        full: dict[int, set[str]] = {}
        self.need = sorted({min(window, len(s)) for _, s in seqs})
        for key, seq in seqs:
            m, v, size = min(window, len(seq)), 0, 0
            for c in seq:
                v, size = self.step(v, size, c)
                if size >= m == window:
                    full.setdefault(self.at(v, m), set()).add(key)
            if len(seq) < window:
                full.setdefault((self.at(v, m), m), set()).add(key)
        # Windows of full length are known by their state; shorter items by state and length, found along the suffix links.
        self.full: dict[int, frozenset[str]] = {k: frozenset(v) for k, v in full.items() if not isinstance(k, tuple)}
        self.short: dict[int, list[tuple[int, frozenset[str]]]] = {}
        own: dict[int, list[tuple[int, frozenset[str]]]] = {}
        for k, v in full.items():
            if isinstance(k, tuple):
                own.setdefault(k[0], []).append((k[1], frozenset(v)))
        if own:
            for v in sorted(range(len(self.len)), key=self.len.__getitem__):
                found = own.get(v, []) + (self.short.get(self.link[v], []) if v else [])
                if found:
                    self.short[v] = found
        edges = {(a * 1_000_003 + b) & 0x3FFFFF for _, s in seqs for a, b in zip(s, s[1:], strict=False)}
        self.pair = np.zeros(1 << 22, dtype=bool)  # hashed bitmap of neighbouring words: no match of two words without its bit
        self.pair[list(edges)] = True

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.len[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:  # an earlier item came this way
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur, p = self._new(self.len[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def at(self, v: int, size: int) -> int:
        """The state of the suffix of that size."""
        while v and self.len[self.link[v]] >= size:
            v = self.link[v]
        return v

    def step(self, v: int, size: int, c: int) -> tuple[int, int]:
        """Longest match that ends with c, no longer than a window."""
        while v and c not in self.next[v]:
            v = self.link[v]
            size = self.len[v]
        v = self.next[v].get(c, 0)
        size = size + 1 if v else 0
        if size > self.window:
            size = self.window
        if v and self.len[self.link[v]] >= size:
            v = self.at(v, size)
        return v, size

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged half-open word spans that windows cover, and the items whose windows occur."""
        if not self.need or len(words) < self.need[0]:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        if self.need[0] == 1:
            live = ids >= 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], live.view(np.int8), [0]))))
            runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        else:  # runs of neighbours that follow each other in some item, long enough for a window
            live = self.pair[(ids[:-1] * 1_000_003 + ids[1:]) & 0x3FFFFF] & (ids[:-1] >= 0) & (ids[1:] >= 0)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], live.view(np.int8), [0]))))
            runs = [(a, b + 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b + 1 - a >= self.need[0]]
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for a, b in runs:
            v = size = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                v, size = self.step(v, size, c)
                got = 0
                if size == self.window and v in self.full:
                    items |= self.full[v]
                    got = size
                if self.short and v in self.short:
                    for m, keys in self.short[v]:
                        if m <= size:
                            items |= keys
                            got = max(got, m)
                if got:
                    start = i - got
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, items


def _shards(bench: DataFrame, item_col: str, text_col: str, window: int, shard_words: int) -> list[Automaton]:
    """Automata of bounded size. Items stream to the driver one partition at a time; a longer item than a shard is cut into pieces that overlap by window - 1 words."""
    out, now, held = [], [], 0
    for row in bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), text_col).toLocalIterator():
        words = words_of((row[1] or "").encode())
        pieces = [words] if len(words) <= shard_words else [words[i : i + shard_words + window - 1] for i in range(0, len(words) - window + 1, shard_words)]
        for piece in pieces:
            if now and held + len(piece) > shard_words:
                out.append(Automaton(now, window))
                now, held = [], 0
            now.append((row[0], piece))
            held += len(piece)
    return [*out, Automaton(now, window)]


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", keep: bool = False) -> DataFrame:
    """n_words, n_hit, spans (word spans, flat), items per row, after the id; with keep, after all columns of docs under names that do not clash."""
    spark = docs.sparkSession
    out = None
    cols = docs.columns if keep else [id_col, text_col]
    base = docs.select(*cols)
    auto = _shards(bench, item_col, "text", window, shard_words)
    if len(auto) > 1:
        base = cut(base.withColumn("__row", F.monotonically_increasing_id()))
    extra = ["__n_words", "__n_hit", "__spans", "__items"]
    carried = ["__row"] if len(auto) > 1 and keep else [c for c in base.columns if keep or c != text_col]
    schema = ", ".join([*(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in carried), "__n_words long, __n_hit long, __spans array<int>, __items array<string>"])
    for one in auto:
        held = spark.sparkContext.broadcast(one)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            a = held.value
            for batch, texts in slices(batches, text_col):
                cols: list[list] = [[], [], [], []]
                for text in texts:
                    spans, items = a.hits(words := words_of(text))
                    for c, x in zip(cols, (len(words), sum(e - s for s, e in spans), [x for s in spans for x in s], sorted(items)), strict=True):
                        c.append(x)
                types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*carried, *extra])

        part = base.select(*dict.fromkeys([*carried, text_col])).mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    if len(auto) == 1:
        return out
    # Several passes: spans of a row overlap between passes, so its hit words are counted over their union.
    named = "__row" if keep else id_col
    lists = out.groupBy(*dict.fromkeys(["__row", named])).agg(F.max("__n_words").alias("__n_words"), F.flatten(F.collect_list("__spans")).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [union(x) for x in b.column(2).to_pylist()]
            hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(spans, pa.list_(pa.int32())), b.column(3)], names=[named, *extra])

    kind = base.schema[named].dataType.simpleString()
    merged = lists.select(named, "__n_words", "__spans", "__items").mapInArrow(unite, f"`{named}` {kind}, __n_words long, __n_hit long, __spans array<int>, __items array<string>")
    return base.join(merged, "__row").select(*cols, *extra) if keep else merged


def union(spans: list[int]) -> list[int]:
    """Flat spans, sorted and merged where they meet."""
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (F.col("__n_hit") > 0).alias("contaminated"))


def remove_spans(text: str, spans: list[int], max_span: int = 0, max_coverage: float = 0.5) -> str | None:
    """The text without its spans of more than max_span words; None if the spans cover more than max_coverage of the words."""
    raw = (text or "").encode()
    folded, starts, ends, at = raw.translate(FOLD), array("l"), array("l"), 0
    for w in folded.split():
        at = folded.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    pairs = list(zip(spans[::2], spans[1::2], strict=True))
    if starts and sum(e - s for s, e in pairs) > max_coverage * len(starts):
        return None
    out, at = bytearray(), 0
    for s, e in pairs:
        if e - s > max_span:
            out += raw[at : starts[s]]
            at = ends[e - 1]
    return (bytes(out) + raw[at:]).decode()


def cleaned(docs: DataFrame, bench: DataFrame, max_span: int = 0, max_coverage: float = 0.5, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """id, clean_text: spans over the length limit removed; rows over the coverage limit go."""
    found = decontaminate(docs.select(id_col, text_col), bench, window, shard_words, keep=True, id_col=id_col, text_col=text_col)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, remove_spans(t, s, max_span, max_coverage) if t is not None else "") for i, t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True)]
            rows = [r for r in rows if r[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.string())], names=[id_col, "clean_text"])

    return found.mapInArrow(strip, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, clean_text string")


#: DuckDB, independent of any automaton: windows are joined with the documents' 10-word (and short-item-length) sequences as strings.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') s FROM (SELECT item_id, w, least(10, len(w)) m, unnest(range(1, len(w) - least(10, len(w)) + 2)) i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM win),
occ AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) i FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT occ.doc_id, occ.i, occ.m, win.item_id FROM occ JOIN win ON occ.s = win.s AND occ.m = win.m),
pos AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(i, i + m)) p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) n, string_agg(k, ',' ORDER BY k) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT n_words, coalesce(pos.n, 0)::BIGINT n_hit, coalesce(its.n, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(pos.n, 0) > 0 contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
