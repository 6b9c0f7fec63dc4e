"""Ranked lexical search over a clustered index, exact.

1. Recursive graph bisection (Dhulipala et al. 2016) orders documents: a set of documents is halved so that the terms of each half take few bits, by swapping the documents that gain most, and the halves
   are halved again. It is fitted on a bounded sample (SAMPLE documents, TERMS_EACH terms of each, FEATURES terms in all); every document of the corpus is then led down the tree by the same costs, and
   the leaves, which split the sample evenly, are the clusters. The index is the table of all documents (cluster, id, n, terms, tfs) in order of cluster; a cluster of any size is parts of about PART_ENTRIES entries.
2. For the terms of a batch of items the index gives df and, per cluster and term, the greatest part of a score that a document of the cluster has from it. Summed with the items' weights these bound
   every score of a cluster.
3. Items visit clusters by falling bound, in rounds: a round scores its clusters' documents in blocks, by integers, and keeps the k best of each item; an item stops when the bound of its next cluster is
   below its k-th score. A bound that equals it is still visited, as ties go to the smaller id. Places in blocks are mapped back to ids before scores are compared.

Cases: null texts and texts without a term are in no result and not in N; items without terms have no rows; rows that share an item_id are one item of all their terms; repeated rows of documents are
ranked each for itself; a null doc_id comes after all others in ties; an empty table on either side gives an empty result. Only the named columns are read, so further columns cannot clash."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, slices, uncut

#: Bounds of the sample that the bisection is fitted on.
SAMPLE, TERMS_EACH, FEATURES = 4096, 256, 4096
#: Documents a cluster should have, and the most clusters.
CLUSTER_ROWS, MOST_CLUSTERS = 2000, 1024
#: Terms with their counts that a part of a cluster has at most, about.
PART_ENTRIES = 500_000
#: Items that are searched for at once: what goes to every task is bounded by their terms and clusters.
ITEMS_AT_ONCE = 1000
#: Documents that are scored at once.
BLOCK = 512
#: Terms are the runs of 0-9, A-Z, a-z and bytes over 0x7F; A-Z are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
NO_ID = (1 << 63) - 1


def terms(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(FOLD).split()


@dataclass
class Tree:
    """Bisections in level order: node k has the children 2 k + 1 and 2 k + 2; a document goes right where its features' weights sum to more than the cut."""

    features: list[str]
    weight: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaves(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """The cluster of each of n documents, by the features (doc, feature) that they have."""
        node = np.zeros(n, np.int64)
        for _ in range(self.depth):
            score = np.bincount(doc, self.weight[node[doc], feature], n)
            node = 2 * node + 1 + (score > self.cuts[node])
        return node - ((1 << self.depth) - 1)


def _bits(d: np.ndarray, n: int) -> np.ndarray:
    return d * np.log2(n / (d + 1.0))


def fit(own: list[np.ndarray], features: list[str], depth: int, rounds: int = 12) -> Tree:
    """The tree of a sample of documents, each the numbers of the features that it has."""
    some, sample = features, own
    tree = Tree(some, np.zeros(((1 << depth) - 1, max(1, len(some)))), np.zeros((1 << depth) - 1), depth)
    todo = [(0, np.arange(len(sample)))]
    while todo and some:
        node, docs = todo.pop()
        if node >= len(tree.cuts) or len(docs) < 2:
            continue
        feature, doc = np.concatenate([own[d] for d in docs]), np.repeat(np.arange(len(docs)), [len(own[d]) for d in docs])
        right = np.arange(len(docs)) >= len(docs) // 2
        for _ in range(rounds):
            n = (len(docs) - int(right.sum()), int(right.sum()))
            d = [np.bincount(feature[right[doc] == side], minlength=len(some)) for side in (False, True)]
            now = _bits(d[0], n[0]) + _bits(d[1], n[1])
            to_right, to_left = (now - _bits(np.maximum(d[0] + s, 0), n[0]) - _bits(np.maximum(d[1] - s, 0), n[1]) for s in (-1, 1))
            gain = np.bincount(doc, np.where(right[doc], to_left[feature], to_right[feature]), len(docs))
            l, r = (np.flatnonzero(right == side) for side in (False, True))
            l, r = l[np.argsort(-gain[l], kind="stable")], r[np.argsort(-gain[r], kind="stable")]
            m = min(len(l), len(r))
            swaps = int((gain[l[:m]] + gain[r[:m]] > 1e-9).sum())
            if not swaps:
                break
            right[l[:swaps]], right[r[:swaps]] = True, False
        n = (max(1, len(docs) - int(right.sum())), max(1, int(right.sum())))
        d = [np.bincount(feature[right[doc] == side], minlength=len(some)) for side in (False, True)]
        more = [_bits(d[k] + 1, n[k]) - _bits(d[k], n[k]) for k in (0, 1)]
        tree.weight[node] = more[0] - more[1]
        score = np.bincount(doc, tree.weight[node][feature], len(docs))
        tree.cuts[node] = np.median(score)
        goes = score > tree.cuts[node]
        todo += [(2 * node + 1, docs[~goes]), (2 * node + 2, docs[goes])]
    return tree


@dataclass
class Index:
    """table: (cluster, id, n, terms, tfs) of all documents that have terms; docs and words are N and L."""

    table: DataFrame
    docs: int
    words: int
    clusters: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cluster_rows: int = CLUSTER_ROWS) -> Index:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = rows.count()
    depth = max(0, min(MOST_CLUSTERS.bit_length() - 1, (n // cluster_rows).bit_length()))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, "text"):
            some = [sorted(set(terms(t)), key=hash_of)[:TERMS_EACH] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.binary())).cast(pa.list_(pa.string()))], ["terms"])

    chosen = rows.withColumn("x", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(max(1, n)))).filter(F.col("x") < SAMPLE).select("text")
    held = spark.sparkContext.broadcast(_fitted(chosen.mapInArrow(sampled, "terms array<string>").limit(2 * SAMPLE), depth))

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        features = pa.array(tree.features, pa.string())
        for batch, texts in slices(batches, "text"):
            words = [terms(t) for t in texts]
            keep = np.flatnonzero([len(w) > 0 for w in words])
            bags = [Counter(words[k]) for k in keep]
            flat = pa.array([t for b in bags for t in b], pa.binary()).cast(pa.string())
            ends = np.concatenate(([0], np.cumsum([len(b) for b in bags], dtype=np.int64))).astype(np.int32)
            tfs = pa.array([c for b in bags for c in b.values()], pa.int32())
            doc, feature = _known(flat, features, ends)
            ids = batch.column(batch.schema.get_field_index("id")).take(pa.array(keep))
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (flat, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaves(doc, feature, len(bags)).astype(np.int32)), ids, pa.array([len(words[k]) for k in keep], pa.int64()), *lists], ["cluster", "id", "n", "terms", "tfs"])

    found = cut(rows.mapInArrow(tokenised, "cluster int, id long, n long, terms array<string>, tfs array<int>"))
    # A cluster gets as many parts as its entries need: parts are even however long its documents are, and none holds two clusters.
    entries = found.groupBy("cluster").agg(F.sum(F.size("tfs")).alias("entries")).orderBy("cluster").collect()  # at most MOST_CLUSTERS rows
    parts = [-(-r["entries"] // PART_ENTRIES) for r in entries]
    places = spark.createDataFrame([(r["cluster"], sum(parts[:k]), parts[k]) for k, r in enumerate(entries)], "cluster int, first int, parts int")
    h = F.xxhash64("id", "n", F.monotonically_increasing_id())
    ranges = found.withColumn("h", h).join(F.broadcast(places), "cluster").repartitionById(max(1, sum(parts)), (F.col("first") + F.pmod("h", F.col("parts").cast("long"))).cast("int"))
    ranges = ranges.select("cluster", "id", "n", "terms", "tfs")
    table = cut(ranges)
    uncut(found)
    held.destroy()
    total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Index(table, total[0], total[1], 1 << depth)


def _fitted(sample: DataFrame, depth: int) -> Tree:
    """The tree of a sample (terms): its features are the terms of most documents that are not in more than half of them. The driver gets these, and numbers for the rest."""
    sample = cut(sample)
    n = sample.count()
    counts = sample.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c").between(2, max(2, n // 2)))
    features = [r["term"] for r in counts.orderBy(F.desc("c"), "term").limit(FEATURES).collect()]
    among = pa.array(features, pa.string())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = _lists(batch, "terms")
            doc, number = _known(flat, among, ends)
            to = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=batch.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(to), pa.array(number.astype(np.int32)))], ["numbers"])

    own = [np.array(x.values.to_numpy(), np.int64) for x in sample.mapInArrow(numbered, "numbers array<int>").toArrow().column("numbers").combine_chunks()]
    uncut(sample)
    return fit(own, features, depth)


def hash_of(word: bytes) -> bytes:
    """An order of words that has nothing to do with the alphabet."""
    return hashlib.blake2b(word, digest_size=8).digest()


def _known(flat: pa.Array, of: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, number) of the flat terms that are among `of`."""
    at = pc.index_in(flat, value_set=of)
    inside = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    doc = np.searchsorted(ends, inside, side="right") - 1
    return doc, at.drop_null().to_numpy().astype(np.int64)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
    x = batch.column(batch.schema.get_field_index(name))
    ends = x.offsets.to_numpy()
    return x.flatten(), ends - ends[0]


@dataclass
class Batch:
    """Items and their terms as numbers: terms of item k are number[ends[k]:ends[k + 1]], weighing `weight`."""

    ids: list
    words: list[str]
    number: np.ndarray
    ends: np.ndarray
    weight: np.ndarray


def _batches(items: DataFrame, id_col: str, text_col: str) -> Iterator[Batch]:
    """The items, ITEMS_AT_ONCE or so at a time."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            some = [sorted(set(terms(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("item_id")), pa.array(some, pa.list_(pa.binary())).cast(pa.list_(pa.string()))], ["item_id", "terms"])

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(split, f"item_id {rows.schema['item_id'].dataType.simpleString()}, terms array<string>")
    parts = -(-items.count() // ITEMS_AT_ONCE)
    whole = cut(found.select("item_id", F.explode("terms").alias("term"), F.pmod(F.xxhash64("item_id"), F.lit(max(1, parts))).alias("part")).distinct())
    for part in range(parts):
        own = whole.filter(F.col("part") == part).groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms")).collect()
        if own:
            words = sorted({t for r in own for t in r["terms"]})
            at = {t: k for k, t in enumerate(words)}
            ends = np.concatenate(([0], np.cumsum([len(r["terms"]) for r in own])))
            yield Batch([r["item_id"] for r in own], words, np.array([at[t] for r in own for t in r["terms"]], np.int64), ends, np.zeros(len(words), np.int64))
    uncut(whole)


def parts_of_scores(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """What a term gives to a score before its weight: (10^9 tf) div (1000 tf + 20 m), m = 100 - 50 + (50 n N) div L."""
    m = 50 + 50 * n * docs // words
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _trim(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    best = np.lexsort((ids, -score))[:k]
    return score[best], ids[best]


def search(index: Index, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id", log: list | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents of a score above 0. log gets (clusters visited, clusters with a bound above 0) of each batch of items."""
    spark = items.sparkSession
    kind = items.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, {doc_col} long, score long")
    for batch in _batches(items, id_col, text_col) if index.docs else ():
        best = _search(index, batch, k, log)
        names = spark.createDataFrame(list(enumerate(batch.ids)), f"item int, item_id {kind}")
        found = best.join(F.broadcast(names), "item").select("item_id", F.col("rank"), F.col("id").alias(doc_col), "score")
        out = out.unionByName(found)
    return out


def _search(index: Index, batch: Batch, k: int, log: list | None) -> DataFrame:
    spark = index.table.sparkSession
    words, docs, total = pa.array(batch.words, pa.string()), index.docs, index.words

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = _lists(b, "terms")
            doc, number = _known(flat, words, ends)
            at = np.flatnonzero(pc.is_in(flat, value_set=words).to_numpy(zero_copy_only=False))
            tf = _lists(b, "tfs")[0].to_numpy()[at]
            count = np.bincount(doc, minlength=b.num_rows)
            keep = np.flatnonzero(count)
            to = pa.array(np.concatenate(([0], np.cumsum(count[keep]))).astype(np.int32))
            own = b.select(["cluster", "id", "n"]).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(to, pa.array(number.astype(np.int32))), pa.ListArray.from_arrays(to, pa.array(tf))], ["cluster", "id", "n", "number", "tf"])

    view = cut(index.table.mapInArrow(matched, "cluster int, id long, n long, number array<int>, tf array<int>"))
    each = view.select("cluster", F.expr(f"50 + (50 * n * {docs}L) div {total}L").alias("m"), F.explode(F.arrays_zip("number", "tf")).alias("x"))
    part = F.expr("(1000000000L * x.tf) div (1000L * x.tf + 20 * m)")
    peaks = cut(each.groupBy("cluster", F.col("x.number").alias("number")).agg(F.count(F.lit(1)).alias("df"), F.max(part).alias("peak")))
    dfs = peaks.groupBy("number").agg(F.sum("df").alias("df")).toArrow()  # one row a term of the items
    for number, df in zip(*(dfs.column(c).to_pylist() for c in ("number", "df")), strict=True):
        batch.weight[number] = math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))
    owner = np.repeat(np.arange(len(batch.ids)), np.diff(batch.ends))
    pairs = spark.createDataFrame(pa.table({"item": owner.astype(np.int32), "number": batch.number.astype(np.int32), "weight": batch.weight[batch.number]}))
    tops = peaks.join(F.broadcast(pairs), "number").groupBy("item", "cluster").agg(F.sum(F.col("weight") * F.col("peak")).alias("bound")).toArrow()  # items by clusters, both bounded
    bound = np.zeros((len(batch.ids), index.clusters), np.int64)
    bound[tops.column("item").to_numpy(), tops.column("cluster").to_numpy()] = tops.column("bound").to_numpy()
    order, at = np.argsort(-bound, axis=1, kind="stable"), np.zeros(len(batch.ids), np.int64)
    floor, best, step = np.ones(len(batch.ids), np.int64), None, 1
    items = np.arange(len(batch.ids))
    while True:
        wanted = np.zeros((index.clusters, len(batch.ids)), bool)
        for _ in range(step):
            go = items[at < index.clusters]
            go = go[bound[go, order[go, at[go]]] >= floor[go]]
            wanted[order[go, at[go]], go] = True
            at[go] += 1
        if not wanted.any():
            break
        found = _round(view, batch, wanted, floor, k, docs, total)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        last, best = best, cut(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
        for item, score in best.filter(F.col("rank") == k).select("item", "score").collect():
            floor[item] = score
        if last is not None:
            uncut(last)
        step *= 4
    uncut(view, peaks)
    if log is not None:
        log.append((int(at.sum()), int((bound > 0).sum())))
    return best if best is not None else spark.createDataFrame([], "item int, id long, score long, rank int")


def _round(view: DataFrame, batch: Batch, wanted: np.ndarray, floor: np.ndarray, k: int, docs: int, total: int) -> DataFrame:
    """(item, id, score): scores of the documents of the wanted (cluster, item) that can be among the k best; each task gives at most k an item."""
    held = view.sparkSession.sparkContext.broadcast((batch.number, batch.ends, batch.weight, wanted, floor))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ends, weight, wanted, floor = held.value
        floor, kept = floor.copy(), {}
        dense = np.zeros((len(weight), BLOCK), np.int64)
        for b in batches:
            cluster, n = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("cluster", "n"))
            ids = b.column(b.schema.get_field_index("id")).fill_null(NO_ID).to_numpy()
            (which, at), (tf, _) = _lists(b, "number"), _lists(b, "tf")
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))
            which, part = which.to_numpy(), parts_of_scores(tf.to_numpy().astype(np.int64), n[doc], docs, total)
            starts = [*np.flatnonzero(np.diff(cluster, prepend=-1)).tolist(), b.num_rows]
            for lo, hi in ((s, min(s + BLOCK, e)) for a, e in zip(starts, starts[1:]) for s in range(a, e, BLOCK)):
                own = slice(at[lo], at[hi])
                dense[which[own], doc[own] - lo] = part[own]
                for item in np.flatnonzero(wanted[cluster[lo]]).tolist():
                    its = number[ends[item] : ends[item + 1]]
                    score = weight[its] @ dense[its, : hi - lo]
                    good = np.flatnonzero(score >= floor[item])
                    if len(good):
                        old = kept.get(item)
                        s, i = score[good], ids[lo + good]
                        kept[item] = s, i = _trim(np.concatenate((old[0], s)), np.concatenate((old[1], i)), k) if old else _trim(s, i, k)
                        if len(s) == k:
                            floor[item] = s[-1]
                dense[which[own], doc[own] - lo] = 0
        if kept:
            item = np.repeat(np.array(list(kept), np.int32), [len(s) for s, _ in kept.values()])
            score, ids = (np.concatenate(x) for x in zip(*kept.values()))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == NO_ID), pa.array(score)], ["item", "id", "score"])

    clusters = np.flatnonzero(wanted.any(1)).tolist()
    return view.filter(F.col("cluster").isin(clusters)).mapInArrow(scored, "item int, id long, score long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    index = build(docs)
    out = search(index, items, k)
    uncut(index.table)
    return out


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ts FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term FROM benchmark),
s AS (SELECT count(*)::BIGINT n, sum(len(ts))::BIGINT l FROM d WHERE len(ts) > 0),
t AS (SELECT doc_id, len(ts)::BIGINT n, term, count(*)::BIGINT tf FROM (SELECT doc_id, ts, unnest(ts) term FROM d) GROUP BY doc_id, ts, term),
w AS (SELECT term, floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT w FROM t, s WHERE term IN (SELECT term FROM b) GROUP BY term, s.n),
x AS (SELECT b.item_id, t.doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * t.n * s.n) // s.l))))::BIGINT score FROM b JOIN t USING (term) JOIN w USING (term), s GROUP BY b.item_id, t.doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT "rank", doc_id, score FROM x WHERE score > 0)
SELECT * FROM r WHERE "rank" <= 50
"""
