"""N-gram Jaccard self-join, exact.

1. Texts become sets of word n-grams (64-bit hashes, sorted). Equal sets are one class, by a 128-bit digest.
2. Tiles: at similarity t a pair must share one of the first n - ceil(t n) + 1 grams of any global order. The order is by hash, with grams that very many documents
   share (counted over all documents) last, so that shared passages open no tile. A tile is a gram and its classes; within it, only sizes within t of each other meet (size bands).
3. Hashed bitmap signatures of parity bits, as many as grams (a power of two, MOST at most), travel with the tiles. Two sets differ in at least as many grams as their bitmaps differ in
   bits, so the bit count of the xor bounds the overlap from above; pairs whose bound is too low go. What can be similar connects classes into clusters.
4. Within its cluster, the sorted arrays of the pairs that longer bitmaps leave are intersected exactly, until the two classes are connected.
Pairs exist inside tasks only; tasks put out spanning forests (see linkage).

Cases: null or wordless texts have no gram and link with nothing, not even each other; fewer words than n are one gram of the whole sequence; repeated rows (or ids) link by their
own text; a null id is returned with a null component; an empty table gives an empty result. Only id and text are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bounds import bitmap
from .common import BROADCAST_ROWS, cut, maybe_broadcast, slices, tidy, uncut
from .linkage import link
from .words import gram_sets

N, PERCENT = 3, 90
#: Most grams that count as common, and the least documents that hold a common gram.
COMMON, COMMON_DOCS = 4_000_000, 64
#: Bits at most of the bitmaps that travel with tiles.
MOST = 4096


def common_grams(base: DataFrame, n: int) -> np.ndarray:
    """Grams of very many documents: more than COMMON_DOCS, and more than all grams / COMMON, so that there are COMMON of them at most and they fit a broadcast.

    Counts cover all documents. Tasks pass on the grams that they meet twice or more; a gram of that many documents meets itself in most tasks, so
    half its count is asked of the sum. The set only sets the order in which tiles are opened: any set gives right results."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, 0

        def flush() -> pa.RecordBatch:
            x = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
            count = np.diff(np.concatenate((first, [len(x)])))
            g, c = x[first][count > 1].view(np.int64), count[count > 1]
            return pa.RecordBatch.from_arrays([pa.array(np.append(g, 0)), pa.array(np.append(c, 0)), pa.array(np.append(np.zeros(len(g), np.int64), total))], names=["g", "c", "total"])

        for _, texts in slices(batches, "text", 1 << 20):
            for x in gram_sets(texts, n):
                held.append(x)
                size += len(x)
            if size > 2_000_000:
                total = size
                yield flush()
                held, size = [], 0
        total = size
        yield flush()

    counts = cut(base.select("text").mapInArrow(scan, "g long, c long, total long").groupBy("g").agg(F.sum("c").alias("c"), F.sum("total").alias("total")))
    most = max(COMMON_DOCS, (counts.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]) // COMMON)
    top = np.sort(np.array([r[0] for r in counts.filter(F.col("c") > most // 2).select("g").toLocalIterator()], np.int64).view(np.uint64))
    uncut(counts)
    return top


def signatures(base: DataFrame, n: int, percent: int, hot: np.ndarray) -> DataFrame:
    """id, n_grams, digest, bits (the bitmap), tiles (grams of the prefix)."""
    held = base.sparkSession.sparkContext.broadcast(hot)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = held.value
        for batch, texts in slices(batches, "text", 1 << 20):
            size, digest, bits, tiles = [], [], [], []
            for x in gram_sets(texts, n):
                size.append(len(x))
                digest.append(xxhash.xxh3_128_digest(x.tobytes()))
                bits.append(bitmap(x, MOST).tobytes())
                p = len(x) - (percent * len(x) + 99) // 100 + 1 if len(x) else 0
                if len(x) and len(top):
                    at = np.searchsorted(top, x)
                    is_hot = top[np.minimum(at, len(top) - 1)] == x
                    x = np.concatenate([x[~is_hot], x[is_hot]])
                tiles.append(x[:p].view(np.int64))
            ends = pa.array(np.concatenate(([0], np.cumsum([len(v) for v in tiles]))), pa.int32())
            flat = pa.array(np.concatenate(tiles) if tiles else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(ends, flat)], names=["id", "n_grams", "digest", "bits", "tiles"])

    return base.mapInArrow(scan, "id long, n_grams long, digest binary, bits binary, tiles array<long>")


def gram_arrays(base: DataFrame, sig: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """key, cid, grams (the sorted set) of the wanted classes (cid, key, id, digest), one row each; their texts are read again."""
    narrow = cut(wanted.select("cid", "key", "id", "digest"))
    few = maybe_broadcast(narrow, n_narrow := narrow.count())
    rows = base.join(few, "id").select("cid", "key", "digest", "text")
    repeated = sig.join(few, ["id", "digest"]).count() > n_narrow

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 1 << 20):
            raw = [x.tobytes() for x in gram_sets(texts, n)]
            right = pa.array([xxhash.xxh3_128_digest(x) == d for x, d in zip(raw, batch.column(2).to_pylist(), strict=True)], pa.bool_())  # an id may repeat with another text
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(raw, pa.binary())], names=["key", "cid", "grams"]).filter(right)

    arrays = rows.mapInArrow(sets, "key long, cid long, grams binary")
    return arrays.dropDuplicates(["cid"]) if repeated else arrays


def arrays_of(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in t["grams"].combine_chunks()]


def ngram_join(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block: int | None = None) -> DataFrame:
    """id, n_shingles, component_id per row. block: classes of one tile or cluster that a task takes at once."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = cut(signatures(base, n, percent, common_grams(base, n)).withColumn("cid", F.monotonically_increasing_id()))
    whole = sig.filter("n_grams > 0 AND id IS NOT NULL")
    # The row of the smallest id stands for the rows of a digest; the others are named by number, and a narrow aggregate finds them.
    several = cut(whole.groupBy("digest").agg(F.min(F.struct("id", "cid")).alias("x"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("digest", F.col("x.cid").alias("first")))
    copies = cut(whole.select("cid", "digest").join(maybe_broadcast(several), "digest").filter("cid <> first").select("cid"))
    n_copies = copies.count()
    classes = whole.join(maybe_broadcast(copies, n_copies), "cid", "left_anti").select("cid", "digest", F.col("id").alias("rep"), F.col("n_grams").alias("n"), "bits", "tiles")
    held = cut(classes) if n_copies > BROADCAST_ROWS else None
    classes = held or classes
    tidy(docs.sparkSession)
    roots = link(
        classes.select(F.explode("tiles").alias("key"), "cid", "n"),
        lambda live: classes.select("cid", "n", "bits"),
        lambda wanted: gram_arrays(base, sig, wanted.join(classes.select("cid", F.col("rep").alias("id"), "digest"), "cid"), n),
        arrays_of,
        percent,
        block,
    )
    named = classes.select("cid", "rep", "digest").join(roots, F.col("cid") == F.col("node"), "left").select("digest", "rep", F.coalesce("root", "cid").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_digest = named.join(least, "root").select("digest", "component_id")
    rows = sig.select("id", "n_grams", F.when((F.col("n_grams") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(by_digest, "digest", "left")
    out = cut(rows.select(F.col("id").alias(id_col), F.col("n_grams").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")))
    uncut(sig, several, copies, held, roots)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row of each group of near copies stays, all columns: that with the smallest id, null ids last, and of equal ids the first by number. Rows are linked by their
    texts whatever their ids, by a number that each gets in a table; rows that link with nothing all stay."""
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = ngram_join(rows, id_col="__row", **how).select("__row", F.col("component_id").alias("__group"))
    shared = found.groupBy("__group").count().filter("count > 1").select("__group")
    members = cut(found.join(shared, "__group").join(rows.select("__row", F.col(id_col).alias("__id")), "__row"))
    stay = members.groupBy("__group").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__row")).alias("x")).select(F.col("x.__row").alias("__row"))
    gone = cut(members.select("__row").join(stay, "__row", "left_anti"))
    uncut(members)
    return rows.join(maybe_broadcast(gone), "__row", "left_anti").select(*docs.columns)


#: DuckDB: all pairs of distinct gram sets that share a gram, counted exactly; components by repeated minimum. For small inputs.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) END s FROM d),
k AS (SELECT doc_id, len(s) n, md5(array_to_string(list_sort(s), chr(10))) h FROM g),
c AS (SELECT h, min(doc_id) rep, any_value(n) n FROM k WHERE n > 0 GROUP BY h),
t AS (SELECT c.rep, c.n, unnest(g.s) x FROM c JOIN g ON g.doc_id = c.rep),
p AS (SELECT a.rep a, b.rep b FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep AND least(a.n, b.n) * 10 >= 9 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT rep node, rep root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node AND r.root < e.b),
m AS (SELECT node, min(root) root FROM r GROUP BY node)
SELECT k.doc_id, k.n::BIGINT n_shingles, coalesce(m.root, k.doc_id) component_id FROM k LEFT JOIN c ON c.h = k.h AND k.n > 0 LEFT JOIN m ON m.node = c.rep
"""
