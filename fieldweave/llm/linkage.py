"""Links between classes that share a bucket. Pairs live only inside tasks: what a task puts out is a spanning forest, at most one row for each class that it holds.

1. Buckets. Members without another of a fitting size go, and of buckets with the same members one stays. Each bucket's classes meet in one task, which bounds every pair by size band
   and bitmap and puts out the components of the pairs that can be similar.
2. Clusters. Those components over all buckets are clusters: linked classes are always in one. Each class is in one cluster, so its content is shuffled once; a task takes whole
   clusters, bounds their pairs by longer bitmaps, tests exactly what is left until two classes are connected, and puts out the forest of the links.

A bucket or cluster of more than BLOCK classes (or WEIGHT of content) is dealt over several tasks in blocks, by a hash of class and bucket, so that blocks of different buckets overlap and a
large group grows together in one pass. Members that are then outside of their bucket's largest component meet all its blocks in a second pass; those inside it need not meet again.
So every two classes of a bucket that are not connected by links have met, groups of copies cost rows in proportion to their size, and no task holds more than two blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bounds import Bitmaps, bitmap, fits
from .common import components, cut, maybe_broadcast, tidy, uncut

#: Classes, and elements of their sets, that a task takes at once of one bucket or cluster.
BLOCK, WEIGHT = 4096, 4_000_000
#: Bytes of rows that a task gathers before it works on the buckets that are complete.
CHUNK = 8 << 20
#: Rows of a key from which a task names it as one that may be hot.
OFTEN = 8
#: Bits of the bitmaps of step 2 at most; they are made in the task.
WIDEST = 1 << 16

#: From a table of rows (whole buckets, each from start to end) and the classes' labels to pairs of row numbers that are connected.
Kernel = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each its own label's label) after connecting the nodes a and b pair by pair."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(after := label[label], label):
            label = after


def forest(kernel: Kernel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, deal, root, ...) sorted by key and deal to the star links (a, b) between roots that the kernel connects."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size, most = [], 0, CHUNK
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                t = pa.Table.from_batches(held).combine_chunks()
                key, deal = t["key"].to_numpy(), t["deal"].to_numpy()
                last = int(np.flatnonzero((key != key[-1]) | (deal != deal[-1])).max(initial=-1)) + 1
                if last:
                    yield t.slice(0, last)
                rest = t.slice(last)
                held, size = rest.to_batches(), rest.nbytes
                most = max(CHUNK, 2 * size)
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(batches):
            key, deal = t["key"].to_numpy(), t["deal"].to_numpy()
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (deal[1:] != deal[:-1]))))
            ends = np.append(starts[1:], len(key))
            several = ends - starts > 1
            names, node = np.unique(t["root"].to_numpy(), return_inverse=True)
            a, b = kernel(t, starts[several], ends[several], node)
            label = unite(np.arange(len(names)), node[a], node[b])
            linked = np.flatnonzero(label != np.arange(len(names)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(names[linked], pa.int64()), pa.array(names[label[linked]], pa.int64())], names=["a", "b"])

    return run


def bitmap_kernel(percent: int) -> Kernel:
    """Rows (n, bits): pairs of a bucket that can be similar."""

    def kernel(t: pa.Table, starts: np.ndarray, ends: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = t["n"].to_numpy()
        raw = t["bits"].combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        flat = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(np.uint64)
        maps = Bitmaps(flat, (offsets[1:] - offsets[0]) // 8)
        size = ends - starts
        group = np.repeat(np.arange(len(starts)), size)
        rows = np.arange(len(group)) - np.repeat(np.cumsum(size) - size - starts, size)
        order = rows[np.lexsort((n[rows], group))]  # by bucket, and by size in it
        end = np.repeat(np.cumsum(size), size)
        label, left, right = np.arange(int(node.max(initial=-1)) + 1), [], []
        alive, far = np.arange(len(order)), 0
        while True:  # each row with the next, then the one after that, as long as sizes fit
            far += 1
            alive = alive[alive + far < end[alive]]
            if not len(alive):
                break
            i, j = order[alive], order[alive + far]
            near = fits(n[i], n[j], np.abs(n[i] - n[j]), percent)
            alive, i, j = alive[near], i[near], j[near]
            apart = label[node[i]] != label[node[j]]
            i, j = i[apart], j[apart]
            if len(i) and (can := maps.similar(i, j, n, percent)).any():
                left.append(i[can])
                right.append(j[can])
                label = unite(label, node[left[-1]], node[right[-1]])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])

    return kernel


def link_sets(sets: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of the links between sorted sets that have different labels."""
    if len(sets) == 2:
        x, y = sets
        same = len(np.intersect1d(x, y, assume_unique=True)) if label[0] != label[1] and fits(len(x), len(y), abs(len(x) - len(y)), percent) else 0
        return [(0, 1)] if same and 100 * same >= percent * (len(x) + len(y) - same) else []
    n = np.array([len(x) for x in sets])
    order = np.argsort(n, kind="stable")
    width = min(max(256, 1 << (4 * int(n.max()) - 1).bit_length()), WIDEST)
    maps = np.stack([bitmap(sets[i], width, width) for i in order])
    n, label, links = n[order], np.unique(label, return_inverse=True)[1][order], []
    for p in range(len(order) - 1):
        stop = int(np.searchsorted(n, n[p] * 100 // percent, side="right"))
        q = p + 1 + np.flatnonzero(label[p + 1 : stop] != label[p])
        if not len(q):
            continue
        can = fits(n[p], n[q], np.bitwise_count(maps[q] ^ maps[p]).sum(1, dtype=np.int64), percent)
        for r in q[can].tolist():
            if label[r] != label[p]:
                same = len(np.intersect1d(sets[order[p]], sets[order[r]], assume_unique=True))
                if 100 * same >= percent * (int(n[p]) + int(n[r]) - same):
                    links.append((int(order[p]), int(order[r])))
                    label[label == label[r]] = label[p]
    return links


def set_kernel(prepare: Callable[[pa.Table], list[np.ndarray]], percent: int) -> Kernel:
    """Rows with content that prepare turns into sorted sets: the links of a cluster."""

    def kernel(t: pa.Table, starts: np.ndarray, ends: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sets, a, b = prepare(t), [], []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            for i, j in link_sets(sets[s:e], node[s:e], percent):
                a.append(s + i)
                b.append(s + j)
        return np.array(a, np.int64), np.array(b, np.int64)

    return kernel


def within(rows: DataFrame, hot: DataFrame, kernel: Kernel) -> DataFrame:
    """Star links (a, b), materialised, of the rows (key, cid, ...) of each key. hot: (key, spread), materialised, the keys to be dealt over so many blocks."""
    run = lambda x: x.repartition("key", "deal").sortWithinPartitions("key", "deal").mapInArrow(forest(kernel), "a long, b long")
    n_hot = hot.count()
    if not n_hot:
        return cut(run(rows.withColumn("deal", F.lit(0).cast("long")).withColumn("root", F.col("cid"))))
    spread = maybe_broadcast(hot, n_hot)
    rows = cut(rows)
    deal = F.coalesce(F.pmod(F.xxhash64("cid", "key"), "spread"), F.lit(0).cast("long"))
    first = cut(run(rows.join(spread, "key", "left").withColumn("deal", deal).withColumn("root", F.col("cid")).drop("spread")))
    # What the first pass left apart in the dealt keys: all members outside of their key's largest component meet all blocks.
    roots = cut(components(first))
    named = cut(rows.join(spread, "key").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid")).drop("node"))
    tidy(rows.sparkSession)
    per = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    top = cut(top.select("key", F.col("top.root").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("groups")))
    left = named.join(maybe_broadcast(top), "key").withColumn("stray", F.col("root") != F.col("main"))
    group, block = F.pmod(F.xxhash64("key", "cid"), "groups"), F.pmod(F.xxhash64("cid", "key"), "spread")
    left = left.withColumn("block", F.when(F.col("stray"), F.col("spread") + group).otherwise(block)).withColumn("group", group)
    deals = F.transform(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1), lambda g: g * (F.col("spread") + F.col("groups")) + F.col("block"))
    probes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("spread") + F.col("groups") - 1), lambda x: F.col("group") * (F.col("spread") + F.col("groups")) + x)
    dealt = left.withColumn("deal", F.explode(F.when(F.col("stray"), F.array_union(deals, probes)).otherwise(deals)))
    second = cut(run(dealt.select(*rows.columns, "root", "deal")))
    both = cut(first.union(second))
    uncut(rows, first, roots, named, top, second)
    return both


def hot_keys(buckets: DataFrame, more_than: int) -> DataFrame:
    """(key, n) of most keys that so many classes share, found without a shuffle of the rows. Tasks count a million rows at a time and pass on keys that they meet OFTEN times or more in them, so a key
    can be missed: bucket_sets counts every key that is not named here, and gathers none of over a block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key[n >= OFTEN]), pa.array(n[n >= OFTEN])], names=["key", "n"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size >= 1_000_000:
                yield flush()
                held, size = [], 0
        yield flush()

    return cut(buckets.select("key").mapInArrow(scan, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > more_than))


def bucket_sets(buckets: DataFrame, block: int | None = None) -> DataFrame:
    """(key, times, x), materialised: the members (n, cid) by size of each key of two or more; x is empty for keys of over a block of rows. Rows are shuffled once; their number is known by a window,
    which spills, before any are gathered."""
    shared = buckets.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("times > 1")
    member = F.when(F.col("times") <= (block or BLOCK), F.struct("n", "cid"))
    return cut(shared.groupBy("key").agg(F.max("times").alias("times"), F.array_sort(F.collect_list(member)).alias("x")))


def distinct_buckets(sets: DataFrame, percent: int) -> DataFrame:
    """(key, cid) of bucket_sets: members that fit no other's size go, and of buckets with the same members the least key stays."""
    x = F.col("x")
    fitting = F.filter(x, lambda c, i: (F.get(x, i - 1)["n"] * 100 >= c["n"] * percent).eqNullSafe(True) | (c["n"] * 100 >= F.get(x, i + 1)["n"] * percent).eqNullSafe(True))
    fits_some = sets.select("key", fitting["cid"].alias("cids")).filter(F.size("cids") > 1)
    return fits_some.groupBy("cids").agg(F.min("key").alias("key")).select("key", F.explode("cids").alias("cid"))


def link(
    buckets: DataFrame, marks: Callable[[DataFrame], DataFrame], content: Callable[[DataFrame], DataFrame], prepare: Callable[[pa.Table], list[np.ndarray]], percent: int, block: int | None = None, weight: int | None = None
) -> DataFrame:
    """(node, root) of the linked classes, materialised. buckets: (key, cid, n), all long; n is the size of the set, or the same for all where it is not known yet. marks: from the classes that share a bucket (cid) to (cid, n, bits), the size of the set and its
    bitmap as bytes. content: from (cid, key, n) of classes in clusters to (key, cid, ...), which prepare turns into sorted sets of hashes."""
    block, weight = block or BLOCK, weight or WEIGHT
    often = hot_keys(buckets, block)
    few = maybe_broadcast(often.select("key"))
    sets = bucket_sets(buckets.join(few, "key", "left_anti"), block)
    hot = cut(often.union(sets.filter(F.col("times") > block).select("key", "times")).select("key", F.ceil(F.col("n") / block).alias("spread")))
    met = distinct_buckets(sets.filter(F.col("times") <= block), percent)
    met = cut(met.union(buckets.join(maybe_broadcast(hot.select("key")), "key", "left_semi").select("key", "cid")))
    tidy(buckets.sparkSession)
    sizes = marks(met.select("cid").distinct())
    first = within(met.join(sizes, "cid").select("key", "cid", "n", "bits"), hot, bitmap_kernel(percent))
    clusters = cut(components(first).join(sizes.select("cid", "n"), F.col("node") == F.col("cid")).select("cid", F.col("root").alias("key"), "n"))
    uncut(often, sets, met, hot, first)
    tidy(buckets.sparkSession)
    large = clusters.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / weight)).alias("spread")).filter("spread > 1")
    large = cut(large)
    links = within(content(clusters), large, set_kernel(prepare, percent))
    uncut(large, clusters)
    roots = cut(components(links))
    uncut(links)
    return roots
