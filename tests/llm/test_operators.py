"""Brute force, round trips, held-out accuracy, and the cases that docstrings define."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import chat_format, chunk_dedup, common, decontaminate, exact_dedup, language_id, line_dedup, mixing, ngram_join, quality, queries, sharding
from fieldweave.llm.common import components

from ..conftest import DATA

SF = f"{DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, h string, digest string, size long, pattern string"


def docs(spark, texts, ids=None):
    rows = [((ids or range(len(texts)))[i], t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), "x", 7, "y", "z", 3, "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def hard_texts():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(400)]
    base = [r.choice(words) for _ in range(120)]
    near = []
    for _ in range(25):
        x = list(base)
        for _ in range(r.choice((1, 1, 2, 6))):
            x[r.randrange(len(x))] = "new" + r.choice(words)
        near.append(" ".join(x))
    other = [" ".join(r.choice(words) for _ in range(r.randint(1, 90))) for _ in range(40)]
    return [" ".join(base), *near, *other, None, "", " \t\n", "one", "one", "two words", "ONE", "a" * 5000, " ".join(base)]


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def shingle_set(t, n):
    w = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_brute_force(spark, n, percent):
    texts = hard_texts()
    sets = [shingle_set(t, n) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = union_find(len(texts), links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs(spark, texts), n, percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


def test_ngram_join_keeps_one_of_repeated_rows(spark):
    kept = ngram_join.keep_one(docs(spark, ["a b c d e f"] * 3 + [None, "x y"], [1, 1, 2, 3, None]))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"] is not None) == [(False, 1), (False, 3)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_exact_dedup(spark):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs(spark, ["a b", "ab", "a\n\tb ", "", None, "c"])).collect()}
    assert got == {0: (2, 3, False), 1: (2, 3, False), 2: (2, 3, True), 3: (3, 2, True), 4: (3, 2, False), 5: (5, 1, True)}


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("weak", [True, False])
def test_exact_dedup_with_collisions_and_a_hot_text(spark, monkeypatch, broadcast, weak):
    """A third of the rows has one text and half of those no id; a weak digest makes other texts collide."""
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    texts = ["hot  text" if i % 3 == 0 else ["a b", "ab", "a c", "ac ", "", None, f"x{i}", "a" * 50_000][i % 8] for i in range(600)]
    ids = [None if i % 6 == 0 else i // 2 for i in range(600)]  # ids repeat
    how = {"digest": lambda c: F.substring(c, 1, 1).cast("binary")} if weak else {}
    got = exact_dedup.exact_dedup(docs(spark, texts, ids), **how).collect()
    norm = lambda t: "".join(c for c in t or "" if c not in exact_dedup.BLANKS)
    groups = {}
    for i, t in zip(ids, texts, strict=True):
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    want = [(i, min(groups[norm(t)])[3], len(groups[norm(t)]), i == min(groups[norm(t)])[3], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_dedup_rows_keeps_columns(spark):
    d = docs(spark, ["a b", "ab", None, "", "c"]).withColumns({"keep_id": F.lit(7), "h": F.col("doc_id"), "n": F.lit("x")})
    got = exact_dedup.dedup_rows(d)
    assert got.columns == d.columns and sorted(r["doc_id"] for r in got.collect()) == [0, 2, 4]


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\s>", "<\\/s> [\\\\INST] \\", "[ROLE:AF] x [/ROLE:AF]", "[", "<", "a [/SYS]\n[ASST] b </s>\n", "", None, "x" * 20000]
    rows = [(c, t, role, text) for c, text in enumerate(hard) for t, role in enumerate(("system", "user", "assistant", "tool|]", None, ""))]
    out = chat_format.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in out:
        want = [(role or "", text or "") for c, _, role, text in rows if c == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["parsed"]] == want
        assert r["escaped"] == any(x in (hard[r["conv_id"]] or "") for x in ("</s>", "<\\", "[\\\\INST]", "[ROLE:AF]"))


def brute_hits(text, items):
    w, hit, ids = decontaminate.words_of((text or "").encode()), set(), set()
    for key, item in items.items():
        v = decontaminate.words_of((item or "").encode())
        m = min(10, len(v))
        for a in range(len(v) - m + 1) if m else ():
            for i in range(len(w) - m + 1):
                if w[i : i + m] == v[a : a + m]:
                    hit |= set(range(i, i + m))
                    ids.add(key)
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("shard_words", [400_000, 30])
def test_decontaminate_brute_force(spark, shard_words):
    r = random.Random(3)
    pick = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = {str(i): pick(n) for i, n in enumerate((1, 3, 12, 25, 40, 0, 9, 10, 11, 70))}
    items["0"], items["1"] = "zz", "c zz c"
    texts = [pick(n) for n in (0, 5, 30, 200, 400)] + [None, "q zz q", items["4"] + " " + items["9"], "A! B; " + items["3"].upper()]
    bench = spark.createDataFrame([(int(k), v) for k, v in items.items()] + [(99, None)], "item_id long, text string")
    got = {x[0]: tuple(x)[1:] for x in decontaminate.decontaminate(docs(spark, texts), bench, shard_words=shard_words).select("doc_id", "__n_words", "__n_hit", "__items").collect()}
    assert {k: (a, b, sorted(c)) for k, (a, b, c) in got.items()} == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_remove_spans():
    assert decontaminate.remove_spans("One two, three four.", [1, 3]) == "One  four."
    assert decontaminate.remove_spans("a b", [0, 2]) is None


def test_mix(spark):
    rows = mixing.mix(docs(spark, hard_texts())).collect()
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[(r["source_size"], r["target"])].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for (size, target), x in by.items():
        assert target <= 2 * size and sum(r["taken"] for r in x) == int(target)
    assert sum(t for _, t in by) == pytest.approx(1.5 * total)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs(spark, hard_texts())).collect()))


def test_flow_of_overlapping_sources():
    flow = mixing.min_cost_flow([100, 50, 30], [[0, 1], [0], [1]], [120, 90], 2)
    assert [sum(f[s] for f in flow) for s in range(2)] == [120, 90]
    assert all(sum(f) <= 2 * w for f, w in zip(flow, (100, 50, 30), strict=True))


def test_language_id_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.language_id(d).collect()}
    rows = d.collect()
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    fold = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in fold) >= 0.97 * len(fold)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_without_letters(spark):
    model = language_id.build({"x": ["the cat sat on the mat " * 20], "y": ["le chat est sur le tapis " * 20]})
    langs, scores = model.predict([None, "", "123 !?", "the mat", "le tapis", "é"])
    assert langs[:3] == ["und"] * 3 and langs[3:5] == ["x", "y"] and langs[5] in ("x", "y") and scores[:3] == [0.0] * 3


def test_cross_parse_brute_force():
    text = "abracadabra alakazam abracadabra"
    model = language_id.build({"x": [text]})
    seq = model.symbol[language_id.squeeze(language_id.tables()[0][language_id.points(text)])].tolist()
    line = model.symbol[language_id.points("cadabrala kaza zzz abrac")].tolist()
    has = lambda s: any(seq[i : i + len(s)] == s for i in range(len(seq)))
    phrases, at = 0, 0
    while at < len(line):
        n = 1
        while at + n < len(line) and has(line[at : at + n + 1]):
            n += 1
        phrases, at = phrases + 1, at + n
    import numpy as np

    lanes = np.array(line, np.uint8).reshape(-1, 1)
    assert model.phrases(lanes, np.array([len(line)]))[0, 0] in (phrases, phrases + 1)


def test_quality_held_out(spark):
    sf = f"{DATA}/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r["good"] for r in quality.quality(d, lab.filter("doc_id % 4 <> 0")).collect()}
    rest = lab.filter("doc_id % 4 = 0").collect()
    good, bad = [r["doc_id"] for r in rest if r["quality"]], [r["doc_id"] for r in rest if not r["quality"]]
    assert sum(got[i] for i in good) >= 0.9 * len(good) and sum(not got[i] for i in bad) >= 0.7 * len(bad)


def test_quality_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality(docs(spark, [None, "a"]), empty).collect()} == {0.5}


def test_shards(spark):
    rows = sharding.shard(docs(spark, hard_texts() * 8, list(range(75 * 8)))).collect()
    loads, places = defaultdict(int), defaultdict(list)
    for r in rows:
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert set(loads) <= set(range(24)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(loads.values()) - min(loads.values()) <= max(r["size"] for r in rows)


def test_rebalance_edits_only():
    sums = {s: (s * 37) % 101 + 1 for s in range(512)}
    one = sharding.first_map(sums, 4, 512)
    two = sharding.rebalance(one, sums, 5)
    moved = [s for s in range(512) if one.shards[s] != two.shards[s]]
    assert two.version == 2 and moved and all(two.shards[s] == 4 for s in moved)
    assert sharding.SlotMap.from_json(two.to_json()) == two


@pytest.mark.parametrize("broadcast", [True, False])
def test_line_dedup_brute_force(spark, monkeypatch, broadcast):
    """Half of the documents hold one line, and near copies of it; joins by digest and root deal it where nothing is broadcast."""
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(6))
    base = [" ".join(word() for _ in range(20)) for _ in range(6)]
    lines = []
    for b in base:
        w = b.split()
        w[r.randrange(20)] = word()
        lines += [b, " ".join(w), b + ".", " ".join(word() for _ in range(20)), "short"]
    texts = ["\n".join([lines[i], "", lines[(i * 7 + 3) % len(lines)]]) for i in range(len(lines))] + [None, "", "\n\n"]
    texts = [t if t is None or i % 2 else t + "\n" + base[0][: 110 + i % 3] for i, t in enumerate(texts)]
    flat = sorted({(i, k, x.strip()) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if x.strip()})
    sets = [{x.lower()[i : i + 8] for i in range(max(len(x) - 7, 1))} for _, _, x in flat]
    links = [(i, j) for i in range(len(flat)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = union_find(len(flat), links)
    want = {i: set() for i in range(len(texts))}
    for at, (i, k, _) in enumerate(flat):
        if root[at] != at:
            want[i].add(k)
    found = line_dedup.line_dedup(docs(spark, texts))
    assert {x["doc_id"]: set(x["removed"]) for x in found.collect()} == want
    clean = {x["doc_id"]: x["text"] for x in line_dedup.cleaned(docs(spark, texts), found).collect()}
    assert clean[0].split("\n") == [x for k, x in enumerate(texts[0].split("\n")) if k not in want[0]] and len(clean[1].split("\n")) == 3 - len(want[1])


def test_repeated_passages(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    free = lambda n: " ".join(word() for _ in range(n))
    passages = [free(55) for _ in range(30)]
    texts = [f"{free(40)} {p}\n{free(30)}" for p in passages] + [f"{free(17)}\n{p} {free(60)}" for p in passages] + [free(200) for _ in range(20)] + [None, "", "one two"]
    got = {x["doc_id"]: x for x in chunk_dedup.chunk_dedup(docs(spark, texts)).collect()}
    for i in range(30):
        assert 20 <= got[i]["repeat_words"] <= 55 and got[i]["removed_words"] == 0
        assert 20 <= got[30 + i]["removed_words"] <= 55
        s, e = got[30 + i]["spans"]
        assert " ".join(texts[30 + i].split()[s:e]) in " ".join(passages[i].split())
    assert all(got[i]["repeat_words"] == 0 for i in range(60, 83))
    clean = {x["doc_id"]: x["text"] for x in chunk_dedup.cleaned(docs(spark, texts), chunk_dedup.chunk_dedup(docs(spark, texts))).collect()}
    assert clean[0] == texts[0] and len(clean[30].split()) == 17 + 55 + 60 - got[30]["removed_words"] and clean[80] is None


def test_repeats_by_length(spark):
    """As brute force over all windows of 48 words says: passages of 51 words are found, those of 44 left alone, wherever a longer repeat surrounds one of their copies too."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    free = lambda n: " ".join(word() for _ in range(n))
    long, short, whole = [free(51) for _ in range(60)], [free(44) for _ in range(40)], free(150)
    inside = " ".join(whole.split()[50:102])
    texts = [f"{free(25)} {p} {free(30)}" for p in (*long, *short) for _ in range(2)] + [whole, f"{free(9)} {whole}", f"{free(30)} {inside} {free(12)}", f"{free(30)} {' '.join(inside.split()[:40])} {free(12)}"]
    places = {}
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 47):
            places.setdefault(tuple(w[k : k + 48]), set()).add(i)
    want = {i for owners in places.values() if len(owners) > 1 for i in owners}
    got = {x["doc_id"]: x for x in chunk_dedup.chunk_dedup(docs(spark, texts)).collect()}
    assert {i for i, x in got.items() if x["repeat_words"]} == want
    assert all(got[2 * i]["repeat_words"] >= 48 and got[2 * i + 1]["removed_words"] >= 16 for i in range(60))


def test_empty_tables(spark, tmp_path):
    empty = docs(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    for found in (ngram_join.ngram_join(empty), exact_dedup.exact_dedup(empty), decontaminate.decontaminate(empty, bench), mixing.mix(empty), language_id.language_id(empty), quality.quality(empty, spark.createDataFrame([], "doc_id long, quality int")), sharding.shard(empty), line_dedup.line_dedup(empty), chunk_dedup.chunk_dedup(empty)):
        assert found.count() == 0
    assert chat_format.digests(chat_format.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_null_ids_and_texts(spark):
    d = docs(spark, ["a b c d", None, "a b c d", None], [None, None, 1, 1])
    for found in (ngram_join.ngram_join(d), exact_dedup.exact_dedup(d), mixing.mix(d), language_id.language_id(d), sharding.shard(d)):
        assert found.count() == 4
    assert line_dedup.line_dedup(d).count() == chunk_dedup.chunk_dedup(d).count() == 2


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    seen = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == d.columns, name
        rows = out.count()
        assert rows > 0 and (name == "mixture" or rows <= seen.count())
        seen = out
    assert corpus_pipeline.run(spark, SF).count() == seen.count()
    assert set(queries.queries()) >= set(queries.oracle_sql())


def test_bands_meet_long_lines():
    """Of lines of 300 shingles at a similarity just over 0.8, at most one pair in a hundred shares no band."""
    r = random.Random(8)
    pick = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for _ in range(4000):
        x = pick(307)
        lines += [x, x[:-33] + pick(33)]
    sets = [set(a.tolist()) for a in line_dedup.shingle_sets(lines[:2])]
    assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.81
    keys = line_dedup.band_keys(lines)
    assert (keys[::2] != keys[1::2]).all(1).mean() <= 0.01


def test_decontaminate_keeps_rows_over_several_shards(spark):
    """All columns and the found spans, of repeated and null ids too, as one automaton gives them."""
    r = random.Random(6)
    pick = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    items = [pick(n) for n in (12, 25, 40, 9, 3, 70)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = docs(spark, [pick(40), "q " + items[1] + " q " + items[5], None, items[2], pick(200), "q q"], [0, 1, 1, None, None, 5])
    one, many = (decontaminate.decontaminate(d, bench, shard_words=k, keep=True) for k in (400_000, 30))
    assert many.columns == one.columns == [*d.columns, "__n_words", "__n_hit", "__spans", "__items"]
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
    assert sorted(map(str, decontaminate.cleaned(d, bench, shard_words=30).collect())) == sorted(map(str, decontaminate.cleaned(d, bench).collect()))


def test_keep_one_of_rows_whatever_their_ids(spark):
    """Of repeated and null ids no text without a copy is lost, and no copy stays."""
    copy, own = "a b c d e f g h", ["z y x w v u", "one two three four", "five six seven eight", "nine ten eleven"]
    rows = [(3, copy), (7, copy), (7, own[0]), (None, own[1]), (None, own[2]), (None, copy), (None, own[3]), (None, own[3]), (9, None), (9, None)]
    kept = ngram_join.keep_one(docs(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert kept.columns == docs(spark, []).columns
    want = [(3, copy), (7, own[0]), (None, own[1]), (None, own[2]), (None, own[3]), (9, None), (9, None)]
    assert sorted(map(str, (tuple(r) for r in kept.select("doc_id", "text").collect()))) == sorted(map(str, want))


def test_repetition_of_whole_texts():
    """What repeats after the first 400 words counts, and length alone does not."""
    slots = quality.Slots()
    share = lambda words: quality.content(" ".join(words).encode(), slots)[1][2]
    clean = [f"w{i}" for i in range(400)]
    assert share(clean + ["buy", "now"] * 800) == pytest.approx(0.8, abs=0.05) and share(clean * 5) == pytest.approx(share(clean), abs=1e-9)


def test_repeats_inside_a_document(spark):
    """A passage three times in one document, and twice in the keeper of another, stays once."""
    r = random.Random(4)
    free = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    p, q = free(60), free(60)
    texts = [f"{free(30)} {p} {free(30)} {p} {free(30)} {p}", f"{q} {free(25)} {q}", f"{free(20)} {q}", free(200)]
    d = docs(spark, [*texts, texts[3]], [0, 1, 2, 3, 3])
    found = chunk_dedup.chunk_dedup(d)
    got = {x["doc_id"]: x for x in found.collect()}
    assert 2 * 35 <= got[0]["removed_words"] <= 2 * 60 and all(35 <= got[i]["removed_words"] <= 60 for i in (1, 2)) and got[3]["repeat_words"] == 0
    clean = {x["doc_id"]: x["text"] for x in chunk_dedup.cleaned(d, found).collect()}
    assert clean[0].count(p) == 1 and clean[1].startswith(q) and clean[1].count(q) == 1


def test_language_id_of_many_letters():
    """Texts of two scripts of 500 letters, each letter about as frequent as the next, beside a common third; phrases as brute force parses them."""
    r = random.Random(9)
    word = lambda base: "".join(chr(base + r.randrange(500)) for _ in range(3))
    lexicon = {"p": [word(0x4E00) for _ in range(300)], "q": [word(0x4F00) for _ in range(300)], "r": ["the", "cat", "sat", "on", "mat"] * 60}
    text = lambda k, n: " ".join(r.choice(lexicon[k]) for _ in range(n))
    model = language_id.build({k: [text(k, 3000)] for k in lexicon})
    assert model.predict([text(k, 8) for k in "ppqqrr" * 10])[0] == list("ppqqrr" * 10)
    assert len({int(model.symbol[0x4E00 + i]) for i in range(500)}) > 400
    small = text("p", 60)
    model = language_id.build({"p": [small], "r": [text("r", 3000)]})
    seq, line = (language_id.points(x).tolist() for x in (small, small[31:90] + text("p", 20) + "\u3400x"))
    has = lambda s: any(seq[i : i + len(s)] == s for i in range(len(seq)))
    phrases, at = 0, 0
    while at < len(line):
        n = 1
        while at + n < len(line) and has(line[at : at + n + 1]):
            n += 1
        phrases, at = phrases + 1, at + n
    assert model.phrases(model.symbol[line].reshape(-1, 1), np.array([len(line)]))[0, 0] in (phrases, phrases + 1)
