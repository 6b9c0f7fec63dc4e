"""Substring dedup by content-defined chunking with a gear rolling hash.

The words of a text, joined by single blanks, are cut where a gear hash of the last 32 bytes, read at word ends, has its top two bits clear (four words a chunk on average),
so a cut depends on the words before it alone and an insertion moves only the cuts near it. Chunks are compared by digest, each together with its successor: such a
pair has eight words on average, and only pairs that occur more than once, in one document or in several, count. Runs of them that cover at least `least` words are repeats.

A repeated passage loses the hash window and a part of a chunk at either end, so the chunks of one of 51 words cover 38 on average. Runs of NEAR to least - 1 words are therefore
looked at word by word: every window of `least` words around the pairs that such runs hold is hashed, here and wherever the same pairs stand, and a run counts if it holds a window that
occurs more than once. The limit is 48: a passage of over 50 words, less a word at either end that the text around it may have been glued to. Shorter repeats are left alone.

The document with the smallest id keeps the first place of each pair; the others go. The first place of a chunk is the first of its pairs too, so no chunk goes altogether.
Why pairs: chunks of a few words recur by chance.

Cases: null and wordless texts have no chunk; repeated rows of one id are one document; null ids take no part and are returned with nothing removed; a chunk has MAX_WORDS words at most;
a text of one chunk is compared by that; an empty table gives an empty result. Only id and text are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, dealt_join, slices, uncut
from .words import word_hashes

MIN_WORDS, NEAR, MAX_WORDS, PAD = 48, 16, 32, 32
GEAR = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 32, 256, np.uint32)
GEAR[0] = 0  # the pad between texts leaves nothing in the hash
_B = np.uint64(0x9E3779B97F4A7C15)
_POW = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(MAX_WORDS, _B))), dtype=np.uint64)
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - k]] << k for k < 32, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def cuts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Of each text (its words), the word numbers at which chunks end."""
    blob = bytearray(PAD)
    for words in texts:
        blob += b" ".join(words) + b" " + bytes(PAD)
    data = np.frombuffer(bytes(blob), np.uint8)
    h = gear(data)
    ends = np.flatnonzero(data == 32)  # one blank ends each word
    is_cut = (h[ends] >> np.uint32(30)) == 0
    out, at = [], 0
    for words in texts:
        n = max(len(words), 1)
        found = np.flatnonzero(is_cut[at : at + n]) + 1
        at += n
        bounds = np.unique(np.concatenate((found, [n])))
        gaps = np.diff(np.concatenate(([0], bounds)))
        if gaps.max() > MAX_WORDS:
            more = [np.arange(b - g + MAX_WORDS, b, MAX_WORDS) for b, g in zip(bounds, gaps, strict=True) if g > MAX_WORDS]
            bounds = np.unique(np.concatenate([bounds, *more]))
        out.append(bounds if words else bounds[:0])
    return out


def pairs(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, first word, end word of each chunk with its successor; ids: the words' hashes."""
    if not len(ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    starts = np.concatenate(([0], ends[:-1]))
    chunk = np.add.reduceat(ids * _POW[np.arange(len(ids)) - np.repeat(starts, ends - starts)], starts)
    chunk = (chunk ^ (chunk >> np.uint64(32))) * _B
    if len(ends) == 1:
        return chunk.view(np.int64), starts.astype(np.int32), ends.astype(np.int32)
    pair = (chunk[:-1] * _B + chunk[1:]) * _B
    return (pair ^ (pair >> np.uint64(31))).view(np.int64), starts[:-1].astype(np.int32), ends[1:].astype(np.int32)


def repeated(digests: np.ndarray) -> np.ndarray:
    """Whether each stands further to the front too."""
    out = np.ones(len(digests), bool)
    out[np.unique(digests, return_index=True)[1]] = False
    return out


def chunk_table(base: DataFrame) -> DataFrame:
    """id, n_words, d (digests), s, e (word spans), again (whether the row had the digest before) per row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 1 << 19):
            split = [(t or b"").split() for t in texts]
            ids, counts = word_hashes(texts, None)
            rows = [pairs(w, c) for w, c in zip(np.split(ids, np.cumsum(counts)[:-1]), cuts(split), strict=True)]
            off = pa.array(np.concatenate(([0], np.cumsum([len(r[0]) for r in rows]))), pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate([r[k] for r in rows]))) for k in range(3)]
            again = pa.ListArray.from_arrays(off, pa.array(np.concatenate([repeated(r[0]) for r in rows])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in split], pa.int64()), *lists, again], names=["id", "n_words", "d", "s", "e", "again"])

    return base.mapInArrow(scan, "id long, n_words long, d array<long>, s array<int>, e array<int>, again array<boolean>")


def window_hashes(ids: np.ndarray, base: int, n: int, s: np.ndarray, e: np.ndarray, width: int, sums: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of `width` words that hold one of the spans (s, e) of the text of n words at `base` of the slice."""
    lo, hi = np.maximum(e - width, 0), np.minimum(s, n - width)
    ok = hi >= lo
    if not ok.any():
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    mark = np.zeros(n - width + 2, np.int64)
    np.add.at(mark, lo[ok], 1)
    np.add.at(mark, hi[ok] + 1, -1)
    at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    h = (sums[base + at + width] - sums[base + at]) * back[base + at]
    h = (h ^ (h >> np.uint64(32))) * _B
    return at.astype(np.int32), (h ^ (h >> np.uint64(29))).view(np.int64)


def window_table(base: DataFrame, near: DataFrame, width: int) -> DataFrame:
    """(id, d, s, again) of the windows of `width` words around the spans of near (id, s, e: arrays); again: whether the row had the window before."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 1 << 19):
            ids, counts = word_hashes(texts, None)
            scale = lambda x: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(ids), x))), dtype=np.uint64)
            sums, back = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids * scale(_B)[:-1], dtype=np.uint64))), scale(_INVERSE)
            owner, at, h, again, begin = [], [], [], [], 0
            for i, n in enumerate(counts.tolist()):
                s, e = (np.array(batch.column(k)[i].as_py(), np.int64) for k in (2, 3))
                starts, found = window_hashes(ids, begin, n, s, e, width, sums, back)
                owner.append(np.full(len(starts), i))
                at.append(starts)
                h.append(found)
                again.append(repeated(found))
                begin += n
            cols = [batch.column(0).take(pa.array(np.concatenate(owner))), *(pa.array(np.concatenate(x)) for x in (h, at, again))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "d", "s", "again"])

    return base.join(near, "id").select("id", "text", "s", "e").mapInArrow(scan, "id long, d long, s int, again boolean")


def _often(places: DataFrame) -> DataFrame:
    """(d, lo, n): digests of more than one place, with the smallest id and the number of places; all combine before the shuffle, so a common digest is a row a task."""
    found = places.groupBy("d").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("again").alias("twice"), F.count(F.lit(1)).alias("n"))
    return found.filter("lo < hi OR twice").select("d", "lo", "n")


def _numbered(spans: DataFrame) -> DataFrame:
    """The spans with the first and the end word (rs, re) of their run: the overlapping or touching spans of an id."""
    w = Window.partitionBy("id").orderBy("s", "e")
    until = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(until.isNull() | (F.col("s") > until), 1).otherwise(0))
    run = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("id", "run")
    return run.withColumns({"rs": F.min("s").over(own), "re": F.max("e").over(own)}).drop("new", "run")


def chunk_dedup(docs: DataFrame, least: int = MIN_WORDS, near: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, repeat_words (words in repeats, kept or not), removed_words, spans (removed word spans, flat) per distinct id."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = cut(chunk_table(base))
    rows = table.filter("id IS NOT NULL").select("id", F.explode(F.arrays_zip("d", "s", "e", "again")).alias("x")).select("id", "x.d", "x.s", "x.e", "x.again")
    often = cut(_often(rows))
    hits = dealt_join(rows, often, "d", ["id", "s"]).select("id", "d", "s", "e", ((F.col("id") == F.col("lo")) & ~F.col("again")).alias("first"))
    hits = cut(_numbered(hits).filter(F.col("re") - F.col("rs") >= near))
    short = cut(hits.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("re") - F.col("rs")).alias("run")).filter(F.col("run") < least).select("d", "n"))
    around = dealt_join(hits, short, "d", ["id", "s"], "left_semi").filter(F.col("e") - F.col("s") <= least).groupBy("id").agg(F.collect_set(F.struct("s", "e")).alias("x")).select("id", "x.s", "x.e")
    windows = cut(window_table(base, around, least))
    again = cut(_often(windows))
    sure = dealt_join(windows, again, "d", ["id", "s"], "left_semi").select("id", "s", (F.col("s") + least).alias("e"), F.lit(None).cast("boolean").alias("first"))
    held = cut(_numbered(hits.select("id", "s", "e", "first").union(sure)).filter(F.col("re") - F.col("rs") >= least))
    repeats = held.select("id", "rs", "re").distinct().groupBy("id").agg(F.sum(F.col("re") - F.col("rs")).alias("repeat_words"))
    uncut(often, hits, short, windows, again)
    gone = _numbered(held.filter("NOT first").select("id", "s", "e")).select("id", "rs", "re").distinct().filter(F.col("re") - F.col("rs") >= near)
    spans = gone.groupBy("id").agg(F.sum(F.col("re") - F.col("rs")).alias("removed_words"), F.array_sort(F.collect_list(F.struct("rs", "re"))).alias("x"))
    spans = spans.select("id", "removed_words", F.flatten(F.transform("x", lambda p: F.array(p["rs"], p["re"]))).alias("spans"))
    size = table.groupBy("id").agg(F.max("n_words").alias("n_words"))
    out = size.join(repeats, "id", "left").join(spans, "id", "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("repeat_words", zero).alias("repeat_words"), F.coalesce("removed_words", zero).alias("removed_words"), F.coalesce("spans", F.array().cast("array<int>")).alias("spans"))


def clean(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """All columns of docs, each row's text without its own removed spans, whatever the ids: rows are told apart by a number that each gets in a table, and the first row keeps a passage."""
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    return cleaned(rows, chunk_dedup(rows, id_col="__row", text_col=text_col, **how), "__row", text_col).drop("__row")


def cleaned(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, by id (where ids repeat with different texts, see clean); removed spans go from the text with the blanks after them, the rest stays byte for byte."""
    gone = found.filter("removed_words > 0").select(F.col(id_col).alias("__id"), F.col("spans").alias("__spans"))
    names = docs.columns
    joined = docs.join(gone, F.col(id_col) == F.col("__id"), "left").drop("__id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text_col):
            at, spans = batch.schema.get_field_index(text_col), batch.column(batch.num_columns - 1).to_pylist()
            new = [t.decode("utf-8", "replace") if t is not None and not s else None if t is None else strip(t, s) for t, s in zip(texts, spans, strict=True)]
            cols = [pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(scan, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))


def strip(text: bytes, spans: list[int]) -> str:
    starts, at = [], 0
    for w in text.split():
        at = text.index(w, at)
        starts.append(at)
        at += len(w)
    starts.append(len(text))
    out, at = bytearray(), 0
    for s, e in zip(spans[::2], spans[1::2], strict=True):
        out += text[at : starts[s]]
        at = starts[e]
    return (bytes(out) + text[at:]).decode("utf-8", "replace")
