"""Fuzzy line dedup by MinHash.

Distinct lines (trimmed) are classes. Their character shingles, lower-cased, give a one-permutation MinHash of BANDS x ROWS bins (empty bins take the next full bin's value with
its distance), read in one pass over the shingles. Lines that agree in a band are candidates; bitmaps bound their similarity, and the exact Jaccard of those that pass is computed inside
tasks (see linkage); distributed union-find joins what passes, and of each component the first line by (id, line number) stays. At a similarity of 0.8 the banding finds a pair with probability 0.99 and at 0.85 with 0.999, for each pair apart; groups are found through any of their pairs.

Cases: blank lines are neither classes nor removed; null text has no lines; a line shorter than a shingle is one shingle; repeated rows are the same lines (kept or removed together);
null ids take no part and are returned with nothing removed; an empty table gives an empty result. Only id and text are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bounds import bitmap
from .common import cut, dealt_join, maybe_broadcast, slices, uncut
from .linkage import link
from .words import distinct

SHINGLE, BANDS, ROWS, PERCENT = 8, 12, 5, 80
#: Bits at most of the bitmaps that travel with bands.
MOST = 1024
BINS = BANDS * ROWS
_M = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all lines, and the line that each belongs to."""
    pts = np.frombuffer("".join(lines).lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) if lines else np.zeros(0, np.uint64)
    size = np.array([len(x.lower()) for x in lines], np.int64)
    run, p = pts + np.uint64(1), int(_M)
    for step in (1, 2, 4):  # doubling: hashes of 2, 4, 8 characters in a row
        run = (run[:-step] * np.uint64(p) + run[step:]) if len(run) > step else run[:0]
        p = p * p % (1 << 64)
    count = np.maximum(size - SHINGLE + 1, 0)
    end = np.cumsum(size)
    whole = np.ones(len(pts), bool)  # shingles that start here end in the same line
    for back in range(1, SHINGLE):
        whole[np.maximum(end - back, end - size)[size > 0]] = False
    owner = np.repeat(np.arange(len(lines)), count)
    full = run[whole[: len(run)]]
    short = np.flatnonzero(count == 0)
    lone = np.array([xxhash.xxh3_64_intdigest(lines[i].lower().encode("utf-8", "surrogatepass")) for i in short], np.uint64)
    return np.concatenate([_mix(full), lone]), np.concatenate([owner, short])


def band_keys(lines: list[str]) -> np.ndarray:
    """lines x BANDS keys, each of 32 bits: what else falls together by chance is sorted out by the exact step."""
    h, owner = shingles(lines)
    bins = ((h >> np.uint64(40)) * np.uint64(BINS)) >> np.uint64(24)
    sig = np.full(len(lines) * BINS, _EMPTY)
    np.minimum.at(sig, owner * BINS + bins.astype(np.int64), h)
    sig = sig.reshape(len(lines), BINS)
    twice = np.where(np.concatenate([sig, sig], 1) == _EMPTY, 3 * BINS, np.arange(2 * BINS))
    nearest = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    away = (nearest - np.arange(BINS)).astype(np.uint64)
    sig = np.take_along_axis(sig, nearest % BINS, 1) + away * _M
    out = np.empty((len(lines), BANDS), np.int32)
    for b in range(BANDS):
        key = np.full(len(lines), b + 1, np.uint64)
        for r in range(ROWS):
            key = _mix(key * _M + sig[:, b * ROWS + r])
        out[:, b] = (key >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


#: Characters whose shingles are hashed at once; hashing takes some ten times their bytes.
AT_ONCE = 1 << 18


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingles of each line."""
    out, at = [], 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= AT_ONCE):
            size += len(lines[end])
            end += 1
        part = lines[at:end]
        h, owner = shingles(part)
        order = np.argsort(owner, kind="stable")
        out += [distinct(x) for x in np.split(h[order], np.cumsum(np.bincount(owner, minlength=len(part)))[:-1])]
        at = end
    return out


def line_classes(base: DataFrame) -> DataFrame:
    """id, line (number), digest, bands per line that is not blank."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 1 << 19):
            rows, number, lines = [], [], []
            for i, t in enumerate(texts):
                for k, x in enumerate((t or b"").decode("utf-8", "replace").split("\n")):
                    if x := x.strip():
                        rows.append(i)
                        number.append(k)
                        lines.append(x)
            keys = band_keys(lines).reshape(-1) if lines else np.zeros(0, np.int32)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1) * BANDS, pa.int32()), pa.array(keys))
            digest = pa.array([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), digest, bands], names=["id", "line", "digest", "bands"])

    return base.mapInArrow(scan, "id long, line int, digest binary, bands array<int>")


def line_texts(base: DataFrame, classes: DataFrame, live: DataFrame) -> DataFrame:
    """cid, x (the line), n (shingles) and bits (the bitmap) of the live classes; the lines are read again from their documents."""
    wanted = cut(classes.join(live, "cid").groupBy("id").agg(F.collect_list(F.struct("line", "cid", "digest")).alias("want")))
    n_wanted = wanted.agg(F.coalesce(F.sum(F.size("want")), F.lit(0))).first()[0]
    rows = base.join(maybe_broadcast(wanted, n_wanted), "id").select("want", "text")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 1 << 19):
            cid, got = [], []
            for want, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                lines = (t or b"").decode("utf-8", "replace").split("\n")
                for w in want:
                    x = lines[w["line"]].strip() if w["line"] < len(lines) else ""
                    if xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) == w["digest"]:  # an id may repeat with another text
                        cid.append(w["cid"])
                        got.append(x)
            sets = shingle_sets(got)
            bits = pa.array([bitmap(x, MOST).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(got, pa.string()), pa.array([len(x) for x in sets], pa.int64()), bits], names=["cid", "x", "n", "bits"])

    out = cut(rows.mapInArrow(fetch, "cid long, x string, n long, bits binary").dropDuplicates(["cid"]))
    uncut(wanted)
    return out


def line_dedup(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block: int | None = None) -> DataFrame:
    """id, n_lines (not blank), n_removed, removed (line numbers, rising) per distinct id; every id of the table is returned."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lines = cut(line_classes(base.filter("id IS NOT NULL")))
    first = lines.groupBy("digest").agg(F.min(F.struct("id", "line", "bands")).alias("x"), F.count(F.lit(1)).alias("times"))
    classes = cut(first.select("digest", "x.id", "x.line", "x.bands", "times", F.monotonically_increasing_id().alias("cid")))
    banded = classes.select(F.posexplode("bands").alias("band", "part"), "cid").select((F.shiftleft(F.col("band").cast("long"), 32) + F.col("part")).alias("key"), "cid", F.lit(0).cast("long").alias("n"))
    held: list[DataFrame] = []

    def marks(live: DataFrame) -> DataFrame:
        held.append(line_texts(base, classes.select("cid", "id", "line", "digest"), live))
        return held[0].select("cid", "n", "bits")

    roots = link(banded, marks, lambda wanted: held[0].join(wanted.select("cid", "key"), "cid").select("key", "cid", "x"), lambda t: shingle_sets(t["x"].to_pylist()), percent, block)
    uncut(*held)
    linked = classes.select("digest", "id", "line", "times", "cid").join(roots, F.col("cid") == F.col("node"))
    keeper = cut(linked.groupBy("root").agg(F.min(F.struct("id", "line")).alias("keep"), F.count(F.lit(1)).alias("n")))
    near = dealt_join(linked, keeper, "root", ["cid"]).select("digest", F.col("keep.id").alias("keep_id"), F.col("keep.line").alias("keep_line"), F.col("times").alias("n"))
    equal = classes.filter("times > 1").join(roots, F.col("cid") == F.col("node"), "left_anti").select("digest", F.col("id").alias("keep_id"), F.col("line").alias("keep_line"), F.col("times").alias("n"))
    # n is how many lines have the digest: a line of a third of all documents, or a component of as many lines, is dealt to parts.
    rule = cut(near.union(equal))
    uncut(keeper)
    gone = dealt_join(lines.select("id", "line", "digest"), rule, "digest", ["id", "line"]).filter("id <> keep_id OR line <> keep_line")
    none = F.lit(None).cast("int")
    parts = base.select("id", none.alias("line"), none.alias("gone")).union(lines.select("id", "line", none)).union(gone.select("id", none, "line"))
    per = parts.groupBy("id").agg(F.size(F.collect_set("line")).cast("long").alias("n_lines"), F.array_sort(F.collect_set("gone")).alias("removed"))
    return per.select(F.col("id").alias(id_col), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def clean(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """All columns of docs, each row's text without its own removed lines, whatever the ids: rows are told apart by a number that each gets in a table, and the first row keeps a line."""
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    return cleaned(rows, line_dedup(rows, id_col="__row", text_col=text_col, **how), "__row", text_col).drop("__row")


def cleaned(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, the text without its removed lines, by id; where ids repeat with different texts, see clean."""
    gone = found.filter("n_removed > 0").select(F.col(id_col).alias("__id"), F.col("removed").alias("__gone"))
    kept = F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.array_contains(F.col("__gone"), i))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return docs.join(gone, F.col(id_col) == F.col("__id"), "left").withColumn(text_col, text).drop("__id", "__gone")
