"""The filter audit, paragraph sketches and lexical search against plain Python, on rows with nulls, ties, repeats and copies over many ranges."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from fieldweave.llm import filter_audit, lexical_search, paragraph_sketch

from .test_operators import docs, hard_texts

LABELS = "doc_id long, quality int, toxic int, text string, mask int, part string, id long"


def label_rows(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], LABELS)


def odd_texts():
    r = random.Random(2)
    many = " ".join(f"w{r.randrange(300)}" for _ in range(400))
    few = " ".join(r.choice(("a", "b", "c")) for _ in range(400))
    return [*hard_texts(), many, few, many.upper(), many + " 5%", many, "É" * 49 + "A", "É" * 50 + "A", "É" * 48 + "A", " ".join(f"W{i} x{i}" for i in range(150)), *([many] * 30), *([few] * 5), "\x0b\x0c", "a|b"]


def plain_masks(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        caps = sum("A" <= c <= "Z" for c in t)
        yield part or "", i, (len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * caps > 2 * len(t)) + 8 * bool(re.search(r"[#$%&*|]", t)) + 16 * (i is not None and least[t] < i)


@pytest.mark.parametrize("partitions", [1, 13])
def test_audit_by_plain_python(spark, partitions):
    texts = odd_texts()
    ids = [None if k % 11 == 5 else k // 2 if k % 7 == 3 else 1000 - k for k in range(len(texts))]
    table = docs(spark, texts, ids).repartition(partitions)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
    labels = [(i, q, x) for i, q, x in ((900 + k, k % 2, k % 3 == 0) for k in range(120))] + [(990, 1, 1), (990, 0, 0), (None, 1, 1), (985, None, 1)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(table, label_rows(spark, labels)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, shapley, own = {}, Counter(), defaultdict(list)
    for part, i, mask in plain_masks(rows):
        own[part].append((i, mask))
    for part, its in own.items():
        for order in permutations("ABCDE"):
            gone = 0
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                removed = [i for i, m in its if m & bit and not m & gone]
                shapley[part, letter] += len(removed)
                want[part, "".join(order), step] = [sum(not m & (gone | bit) for _, m in its), len(removed), sum(bool(m & bit and m & gone) for _, m in its), sum(m == bit for _, m in its), sum(i in good for i in removed), sum(i in toxic for i in removed)]
                gone |= bit
    assert got == {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_audit_of_nothing(spark):
    assert filter_audit.audit(docs(spark, ["a"]).filter("false"), label_rows(spark, [(1, 1, 1)])).count() == 0
    rows = filter_audit.audit(docs(spark, ["a", "a"]), label_rows(spark, [(1, 1, 1)]).filter("false")).filter("filter_order = 'EABCD' AND part = 's1'").orderBy("step").collect()
    assert [tuple(r)[3:] for r in rows] == [(0, 1, 0, 0, 0, 0, 60), (0, 0, 1, 0, 0, 0, 60), *[(0, 0, 0, 0, 0, 0, 0)] * 3]


def test_one_text_over_all_ranges(spark):
    """A group of copies that spans ranges: all rows but that of the smallest id fail E, wherever ranges end."""
    table = docs(spark, ["same text"] * 3000, [(k * 7) % 3000 for k in range(3000)]).repartition(9)
    rows = filter_audit.masks(table).collect()
    assert sorted(r["id"] for r in rows if not r["mask"] & filter_audit.DUPLICATE) == [0] and len(rows) == 3000


def pieces(t):
    return Counter(p for p in (x.strip(" \t\x0b\x0c") for x in re.split(r"[\r\n]+|(?<=[.!?]) ", t)) if p)


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def plain_fingerprints(rows):
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t)
        e = t[: n - n // 2] + following[: n // 2]
        yield i, n, hashlib.sha256(e.encode()).hexdigest(), jaccard(pieces(t), pieces(e)), jaccard(pieces(t), pieces(following))


@pytest.mark.parametrize("partitions", [1, 7])
def test_fingerprints_by_plain_python(spark, partitions):
    r = random.Random(4)
    lines = [" ".join(r.choice(("el", "ñu", "日本", "up", "go")) for _ in range(4)) + r.choice((".", "!", "?", "")) for _ in range(60)]
    texts = [r.choice((" ", "\n", "\r\n")).join(r.choice(lines) for _ in range(r.randint(0, 80))) for _ in range(120)] + [None, "", "\n\n", "a", "x. x. x. x.", "same. " * 4000]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = paragraph_sketch.fingerprints(docs(spark, texts, [3 * k for k in range(len(texts))]).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = list(plain_fingerprints([(3 * k, t or "") for k, t in enumerate(texts)]))
    assert sorted((x["doc_id"], x["n_chars"], x["edited_sha256"], x["near_edited"], x["near_next"]) for x in got) == want
    prints = {x["doc_id"] // 3: x["fingerprint"] for x in got}
    assert len({prints[120], prints[121], prints[122]}) == 1 and all("\n" not in p for p in prints.values())
    for x in got:
        by_sketch = paragraph_sketch.from_fingerprints(x["fingerprint"], x["edited_fingerprint"])
        assert by_sketch is None or by_sketch == x["near_edited"]
    assert sum(paragraph_sketch.from_fingerprints(x["fingerprint"], x["edited_fingerprint"]) is not None for x in got) > 20


def test_fingerprints_of_odd_ids(spark):
    texts = ["a. b.", "a. b.", "c. d.", None, "e", "e"]
    got = paragraph_sketch.fingerprints(docs(spark, texts, [1, 1, None, None, 2, 2])).collect()
    assert sorted((str(x["doc_id"]), x["n_chars"]) for x in got) == sorted([("1", 5), ("1", 5), ("None", 5), ("None", 0), ("2", 1), ("2", 1)])
    one = paragraph_sketch.fingerprints(docs(spark, ["a. b."])).collect()
    assert [(x["near_next"], x["edited_sha256"]) for x in one] == [(1.0, hashlib.sha256(b"a. a.").hexdigest()[:64])]
    assert paragraph_sketch.fingerprints(docs(spark, ["a"]).filter("false")).count() == 0


def test_versions_peel_to_their_paragraphs(spark):
    """What peeling gives back are the digests of the paragraphs that differ; large differences take larger tables; folding a sketch is making a smaller one."""
    r = random.Random(9)
    old = [f"line {k} {r.random()}" for k in range(500)]
    rows = [(k, "\n".join(old), "\n".join([*old[: 500 - k], *(f"new {k} {j}" for j in range(k // 2))])) for k in (0, 1, 5, 40, 500)] + [(7, None, None), (8, "a\na\nb", "a\nb")]
    got = {x["key"]: x for x in paragraph_sketch.compare_versions(spark.createDataFrame(rows, "key int, old string, new string"), "key", "old", "new").collect()}
    signed = lambda lines: sorted(np.array(paragraph_sketch.digests("\n".join(lines).encode())).view(np.int64).tolist())
    for k in (0, 1, 5, 40, 500):
        assert got[k]["removed"] == signed(old[500 - k :]) and got[k]["added"] == signed([f"new {k} {j}" for j in range(k // 2)])
    assert got[500]["cells"] > got[5]["cells"] == paragraph_sketch.CELLS and got[7]["likeness"] == 1.0
    assert len(got[8]["removed"]) == 1 and got[8]["added"] == [] and got[8]["likeness"] == 2 / 3
    sets = paragraph_sketch.Sets.of([paragraph_sketch.digests("\n".join(old).encode())])
    small, large = (paragraph_sketch.Sketches.of(sets, m) for m in (16, 128))
    folded = large.folded(16)
    assert (folded.count == small.count).all() and (folded.key == small.key).all() and (folded.check == small.check).all()


def plain_search(rows, items, k=50):
    cuts = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(cuts(t))) for i, t in rows]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n, total = len(bags), sum(m for _, _, m in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    words = defaultdict(set)
    for i, t in items:
        words[i] |= set(cuts(t))
    for item, its in words.items():
        scores = []
        for i, b, m in bags:
            part = 50 + (50 * m * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * part)) for t in its if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1):
            yield item, rank, None if none else i, -s


@pytest.mark.parametrize(("cluster_rows", "at_once"), [(2000, 1000), (20, 7)])
def test_search_by_plain_python(spark, monkeypatch, cluster_rows, at_once):
    monkeypatch.setattr(lexical_search, "ITEMS_AT_ONCE", at_once)
    monkeypatch.setattr(lexical_search, "BLOCK", 16)
    r = random.Random(6)
    words = ["".join(r.choice("aábcdé日") for _ in range(r.randint(1, 3))) for _ in range(250)]
    topic = [words[k : k + 60] for k in (0, 60, 120)]
    texts = [r.choice((" ", "-", "\n")).join(r.choice(topic[k % 3]) for _ in range(r.randint(1, 60))) for k in range(300)]
    texts += [None, "", "...", "A-a", *([texts[0]] * 70), "Words UP, up\x7fup", "long " * 20000 + texts[1]]
    ids = [None if k in (5, 6, 300) else 2 if k in (2, 3) else k for k in range(len(texts))]
    items = [(k, " ".join(r.choice(words) for _ in range(12))) for k in range(25)] + [(100, None), (101, "??"), (102, texts[0]), (103, "up"), (103, "WORDS"), (None, texts[7]), (104, "unknownterm")]
    table = docs(spark, texts, ids).repartition(6)
    queries = spark.createDataFrame([(*x, 3, "a", 1) for x in items], "item_id long, text string, n int, term string, cluster int")
    index, log = lexical_search.build(table, cluster_rows=cluster_rows), []
    got = sorted((str(x["item_id"]), x["rank"], str(x["doc_id"]), x["score"]) for x in lexical_search.search(index, queries, log=log).collect())
    assert got == sorted((str(a), b, str(c), d) for a, b, c, d in plain_search(list(zip(ids, texts, strict=True)), items))
    assert index.clusters == (1 if cluster_rows == 2000 else 32) and all(a <= b for a, b in log)


def test_search_of_nothing(spark):
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.lexical_search(docs(spark, ["a"]).filter("false"), some).count() == 0
    assert lexical_search.lexical_search(docs(spark, ["a", None]), some.filter("false")).count() == 0
    assert lexical_search.lexical_search(docs(spark, [None, "-"]), some).count() == 0


def test_bisection_parts_topics():
    """Documents of two vocabularies end up in halves of their own."""
    r = random.Random(8)
    sample = [[f"{'xy'[k % 2]}{r.randrange(80)}" for _ in range(30)] for k in range(400)]
    features = sorted({t for s in sample for t in s})
    own = [np.array(sorted({features.index(t) for t in s})) for s in sample]
    tree = lexical_search.fit(own, features, 1)
    leaf = tree.leaves(np.repeat(np.arange(400), [len(x) for x in own]), np.concatenate(own), 400)
    share = sum(leaf[::2]) / 200, sum(leaf[1::2]) / 200
    assert max(share) > 0.95 and min(share) < 0.05
