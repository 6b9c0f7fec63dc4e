"""Rows with null or repeated ids, other partitionings, and op8's places by plain Python."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fieldweave.llm import chunk_dedup, common, line_dedup, linkage, ngram_join, sharding

from .test_operators import SF, docs, hard_texts, shingle_set, union_find


def test_shards_by_plain_python(spark):
    """Slots, map and places of null and repeated ids too, counted out one by one."""
    texts = hard_texts() * 4
    ids = [None if i % 3 == 0 else i % 50 for i in range(len(texts))]
    slot, load, rows = {}, Counter(), defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        raw = (t or "").encode()
        s = int(hashlib.md5(f"{'' if i is None else i}:{zlib.crc32(raw)}".encode()).hexdigest()[:15], 16) % sharding.N_SLOTS
        slot[(i, t)] = s
        load[s] += len(raw) + 8
        rows[s].append((i, len(raw) + 8, zlib.crc32(raw)))
    heap, shard, first, at = [(0, k) for k in range(24)], {}, {}, Counter()
    for s in sorted(range(sharding.N_SLOTS), key=lambda x: (-load[x], x)):
        b, k = heapq.heappop(heap)
        shard[s] = k
        heapq.heappush(heap, (b + load[s], k))
    for s in range(sharding.N_SLOTS):
        first[s] = at[shard[s]]
        at[shard[s]] += len(rows[s])
    want = []
    for s, x in rows.items():
        for k, (i, size, crc) in enumerate(sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))):
            want.append((i, size, crc, "bytes", shard[s], first[s] + k, None))
    got = sharding.shard(docs(spark, texts, ids)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_null_ids_do_not_gather(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(10, 300))) for _ in range(3000)]
    load = Counter()
    for x in sharding.shard(docs(spark, texts, [None if i % 2 else i for i in range(3000)])).collect():
        load[x["shard"]] += x["size"]
    assert max(load.values()) <= 1.1 * min(load.values())


def test_stored_map_is_edited(spark):
    sums = {s: (s * 37) % 101 + 1 for s in range(256)}
    one = sharding.first_map(sums, 4, 256)
    stored = sharding.store(spark, one)
    two = sharding.rebalance(sharding.load(stored), sums, 5)
    both = stored.union(sharding.store(spark, two))
    assert sharding.load(stored) == one and sharding.load(both) == two and two.version == 2


def test_mixture_does_not_depend_on_partitions(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = (sorted(r["doc_id"] for r in corpus_pipeline.mixture(spark, d.repartition(k), SF).collect()) for k in (1, 7))
    assert one == many


def test_clean_by_row(spark):
    """Of rows of one id with different texts, each loses what it repeats itself and nothing else."""
    r = random.Random(3)
    free = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    a, b, c, d = free(60), free(60), free(60), free(60)
    rows = [(1, f"{a}\n{b}"), (1, f"{c}\n{a}"), (None, f"{d}\n{b}"), (1, None)]
    table = docs(spark, [t for _, t in rows], [i for i, _ in rows]).coalesce(1)
    lines = [x["text"] for x in line_dedup.clean(table).collect()]
    assert sorted(map(str, lines)) == sorted(map(str, [f"{a}\n{b}", c, d, None]))
    chunks = [x["text"] for x in chunk_dedup.clean(table).collect()]
    assert len(chunks) == 4 and f"{a}\n{b}" in chunks and sum(len((t or "").split()) for t in chunks) <= 240 + 2 * 25
    assert all(any((t or "").startswith(x) for t in chunks) for x in (c, d))


def test_small_blocks(spark):
    """Buckets and clusters dealt over many tasks give what one task gives."""
    r = random.Random(7)
    base = [f"w{r.randrange(500)}" for _ in range(100)]
    texts = []
    for _ in range(60):
        x = list(base)
        for _ in range(r.choice((1, 2, 3))):
            x[r.randrange(len(x))] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(x))
    sets = [shingle_set(t, 3) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.ngram_join(docs(spark, texts), block=8).collect()}
    assert got == dict(enumerate(union_find(len(texts), links)))


def test_buckets_of_the_same_members_meet_once(spark):
    rows = [(1, 10, 100), (1, 11, 101), (2, 10, 100), (2, 11, 101), (3, 10, 100), (3, 12, 300), (4, 10, 100), (4, 11, 101), (4, 12, 300), (5, 13, 5)]
    got = sorted(map(tuple, linkage.distinct_buckets(linkage.bucket_sets(spark.createDataFrame(rows, "key long, cid long, n long")), 80).collect()))
    assert got == [(1, 10), (1, 11)]


def test_keys_that_counting_misses(spark, monkeypatch):
    """Keys that no task meets often, and keys of over a block, give the same links and are not gathered."""
    r = random.Random(11)
    base = [f"w{r.randrange(400)}" for _ in range(60)]
    texts = []
    for k in range(90):
        x = list(base)
        x[r.randrange(len(x))] = f"n{k}"
        texts.append(" ".join(x))
    table = docs(spark, texts).repartition(6)
    want = {x["doc_id"]: x["component_id"] for x in ngram_join.ngram_join(table).collect()}
    monkeypatch.setattr(linkage, "OFTEN", 10**9)
    assert {x["doc_id"]: x["component_id"] for x in ngram_join.ngram_join(table, block=16).collect()} == want and len(set(want.values())) < 90
    rows = spark.range(2000).select((F.col("id") % 50).alias("key"), F.col("id").alias("cid"), F.lit(5).cast("long").alias("n"))
    assert linkage.hot_keys(rows, 16).count() == 0
    assert {(x["times"], len(x["x"])) for x in linkage.bucket_sets(rows, 16).collect()} == {(40, 0)}
    assert {(x["times"], len(x["x"])) for x in linkage.bucket_sets(rows, 40).collect()} == {(40, 40)}


def test_hot_keys_are_dealt(spark, monkeypatch):
    """A join by a table too large for a broadcast deals the rows of a hot key to many parts and gives what a plain join gives."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 700).cast("long").alias("d"))
    right = common.cut(left.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo")).filter("d % 2 = 0 OR d = -1"))
    plain = sorted(map(tuple, left.join(right.drop("n"), "d").select("id", "d", "lo").collect()))
    dealt = common.dealt_join(left, right, "d", ["id"], parts=40)
    assert sorted(map(tuple, dealt.select("id", "d", "lo").collect())) == plain and dealt.columns == ["d", "id", "lo"]
    semi = common.dealt_join(left, right, "d", ["id"], "left_semi", parts=40)
    assert sorted(map(tuple, semi.select("id", "d").collect())) == [x[:2] for x in plain]
    empty = common.cut(right.filter("false"))
    assert common.dealt_join(left, empty, "d", ["id"]).count() == 0
