"""Inference, transport, surrogates and clusters against known answers or brute force."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.operators import clustering as K
from fieldweave.operators import grid, inference, surrogate, transport
from fieldweave.plans import extended, registry
from fieldweave.sources import gml

from .conftest import DATA


def both_ways(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src int, dst int, weight double")


def cliques(n=5):
    one = list(itertools.combinations(range(n), 2))
    return one + [(a + n, b + n) for a, b in one] + [(0, n)]


@pytest.fixture(scope="module")
def pair(spark):
    return spark.range(10).selectExpr("cast(id as int) node"), both_ways(spark, cliques())


def parts(df, col="grp"):
    groups = {}
    for r in df.collect():
        groups.setdefault(r[col], set()).add(r["node"])
    return {frozenset(g) for g in groups.values()}


TWO = {frozenset(range(5)), frozenset(range(5, 10))}


def test_mtcov_finds_cliques(spark, pair):
    e = pair[1].select(F.lit(0).alias("layer"), "src", "dst", F.col("weight").alias("a"))
    fit = inference.mtcov(e, 2, rounds=12, seed=1)
    assert parts(inference.hard_groups(fit.u)) == TWO
    assert all(sum(r["x"]) == pytest.approx(1) for r in fit.u.collect())


def test_mtcov_restarts_and_starts(spark, pair):
    """The best of the seeds is kept; a fit begun from the planted groups stays with them."""
    e = pair[1].select(F.lit(0).alias("layer"), "src", "dst", F.col("weight").alias("a"))
    each = [inference.mtcov(e, 2, rounds=2, seed=k).loglik for k in (3, 4)]
    assert inference.mtcov_best(e, 2, runs=2, seed=3, rounds=2).loglik == pytest.approx(max(each))
    planted = pair[0].select("node", F.when(F.col("node") < 5, F.array(F.lit(0.9), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(0.9))).alias("x"))
    fit = inference.mtcov(e, 2, rounds=3, start=(planted, planted.filter("node <> 7")), steady=2)
    assert parts(inference.hard_groups(fit.u)) == TWO and fit.rounds >= 3


def test_mtcov_samples_and_rules(spark, pair):
    """The likelihood over a sample of all nodes is that over all; over fewer it is that of their links alone; the rule by change ends when memberships stand still; noise moves what is given."""
    e = pair[1].select(F.lit(0).alias("layer"), "src", "dst", F.col("weight").alias("a"))
    whole = inference.mtcov(e, 2, rounds=3, seed=1)
    assert inference.mtcov(e, 2, rounds=3, seed=1, sample=10).loglik == pytest.approx(whole.loglik)
    part = inference.mtcov(e, 2, rounds=3, seed=1, sample=4)
    assert math.isfinite(part.loglik) and part.loglik != pytest.approx(whole.loglik)
    own, all_ = ({r["node"]: list(r["x"]) for r in fit.u.collect()} for fit in (part, whole))
    assert all(own[k] == pytest.approx(x) for k, x in all_.items())
    still = inference.mtcov(e, 2, rounds=200, seed=1, tolerance=1e-3, by_change=True)
    assert 3 < still.rounds < 200 and parts(inference.hard_groups(still.u)) == TWO
    fixed = inference.mtcov(e, 2, rounds=1, start=(still.u, still.v), start_w=still.w, start_beta=still.beta)
    moved = inference.mtcov(e, 2, rounds=1, start=(still.u, still.v), start_w=still.w, start_beta=still.beta, noise=0.5)
    assert fixed.loglik > moved.loglik


def test_groups_by_latitude(spark):
    u = spark.createDataFrame([(0, [0.9, 0.1, 0.0]), (1, [0.8, 0.2, 0.0]), (2, [0.1, 0.9, 0.0])], "node int, x array<double>")
    nodes = spark.createDataFrame([(0, 50.0), (1, 40.0), (2, -30.0)], "node int, lat double")
    assert {r["node"]: list(r["x"]) for r in inference.groups_by_latitude(u, nodes).collect()} == {0: [0.1, 0.9], 1: [0.2, 0.8], 2: [0.9, 0.1]}


def planted(spark, sizes=(14, 9, 7), seed=5):
    """Groups of many links inside and few between."""
    r = np.random.RandomState(seed)
    of = [g for g, n in enumerate(sizes) for _ in range(n)]
    links = [(i, j) for i in range(len(of)) for j in range(i) if r.rand() < (0.8 if of[i] == of[j] else 0.06)]
    return spark.range(len(of)).selectExpr("cast(id as int) node"), both_ways(spark, links), of


def test_refined_communities(spark):
    nodes, edges, of = planted(spark)
    levels = inference.louvain(nodes, edges, refine=True)
    q = {lv: inference.modularity(edges, levels.filter(F.col("level") == lv)).first()[0] for (lv,) in levels.select("level").distinct().collect()}
    top = max(q)
    assert q[top] >= q[top - 1] - 1e-9 and all(q[k + 1] >= q[k] - 1e-9 for k in range(top - 1))
    assert parts(levels.filter(F.col("level") == top)) == {frozenset(k for k, g in enumerate(of) if g == x) for x in set(of)}


def test_moves_are_what_they_change(spark):
    """A move's change of the description, by the matrices before and after; and planted blocks are found from blocks that a hash dealt."""
    nodes, edges, of = planted(spark)
    start = nodes.select("node", (F.col("node") * 7 % 5).alias("grp"))
    before = inference.description_length(inference._block_counts(edges, start, list(range(5))), 30)
    after = inference.block_moves(edges, start, rounds=1)
    assert inference.description_length(inference._block_counts(edges, after, list(range(5))), 30) < before
    pairs = [(r["src"], r["dst"]) for r in edges.collect()]
    for node in (0, 13, 22, 29):
        own = [k * 7 % 5 for k in range(30)]

        def matrix(groups):
            m = np.zeros((5, 5))
            for a, b in pairs:
                m[groups[a], groups[b]] += 1
            return m + m.T

        c = np.zeros(5)
        for a, b in pairs:
            if a == node:
                c[own[b]] += 1
            if b == node:
                c[own[a]] += 1
        change = inference.move_changes(matrix(own), own[node], c)
        for s in range(5):
            moved = [s if k == node else g for k, g in enumerate(own)]
            assert change[s] == pytest.approx(inference.description_length(matrix(moved), 30) - before, abs=1e-6)
    levels = inference.inferred_blocks(nodes, edges, 8)
    assert parts(levels.filter("level = 0")) == {frozenset(k for k, g in enumerate(of) if g == x) for x in set(of)}
    assert levels.groupBy("level").count().filter("count <> 30").count() == 0


def test_registered_communities(spark):
    """On the query's own network: the refined partition is not worse than the unrefined one, and no single move of a node improves it by much."""
    from fieldweave.plans import registry

    sf = f"{DATA}/sf0.01"
    levels = registry.queries()["louvain"](spark, sf)
    nodes, edges = registry.network(spark, sf)
    top = levels.agg(F.max("level")).first()[0]
    q = [inference.modularity(edges, levels.filter(F.col("level") == k)).first()[0] for k in (top - 1, top)]
    assert q[1] >= q[0] - 1e-9
    com = {r["node"]: r["grp"] for r in levels.filter(F.col("level") == top).collect()}
    links = [(r["src"], r["dst"], r["weight"]) for r in edges.collect()]
    two_m, k, tot, near = sum(w for _, _, w in links), Counter(), Counter(), {}
    for a, b, w in links:
        k[a] += w
        tot[com[a]] += w
        near.setdefault(a, Counter())[com[b]] += w
    gain = lambda n, c: near[n][c] - k[n] * (tot[c] - (k[n] if c == com[n] else 0)) / two_m
    worse = [n for n in near if max(gain(n, c) for c in near[n]) > gain(n, com[n]) + 1e-6]
    assert len(worse) <= 0.05 * len(near)


def test_mtcov_covariates_decide(spark, pair):
    """With gamma 1 only the covariate counts: u follows h."""
    e = pair[1].select(F.lit(0).alias("layer"), "src", "dst", F.col("weight").alias("a"))
    x = pair[0].select("node", (F.col("node") % 2).alias("z"))
    fit = inference.mtcov(e, 2, x, 2, gamma=1.0, rounds=2)
    u = {r["node"]: r["x"] for r in fit.u.collect()}
    assert len(u) == 10 and all(sum(b) == pytest.approx(1) for b in fit.beta) and math.isfinite(fit.loglik)


def test_louvain_and_modularity(spark, pair):
    levels = inference.louvain(*pair, levels=3, rounds=6)
    last = levels.agg(F.max("level")).first()[0]
    found = levels.filter(F.col("level") == last)
    assert parts(found) == TWO
    m = inference.modularity(pair[1], found).first()[0]
    inside, total = 20 / 21, 42
    assert m == pytest.approx(inside - 2 * (21 / total) ** 2)


def test_louvain_without_edges(spark, pair):
    assert inference.louvain(pair[0], pair[1].limit(0)).count() == 10


def test_nested_blocks(spark):
    und = list(itertools.combinations(range(10), 2)) + list(itertools.combinations(range(10, 20), 2)) + [(0, 10)]
    nodes = spark.range(20).selectExpr("cast(id as int) node", "cast(id as int) grp")
    out = inference.nested_blocks(both_ways(spark, und), nodes)
    assert parts(out.filter("level = 0")) == {frozenset(range(10)), frozenset(range(10, 20))}
    assert out.groupBy("level").agg(F.countDistinct("grp").alias("b")).orderBy(F.desc("level")).first()["b"] == 1


def brute_transport(supply, demand, cost):
    """Units moved one by one in the best assignment."""
    a = [i for i, n in enumerate(supply) for _ in range(n)]
    b = [j for j, n in enumerate(demand) for _ in range(n)]
    return min(sum(cost[i][j] for i, j in zip(a, p, strict=True)) for p in itertools.permutations(b))


def test_transport_is_optimal():
    rng = np.random.RandomState(0)
    for _ in range(60):
        n, m = rng.randint(1, 4, 2)
        supply = rng.multinomial(6, np.ones(n) / n).tolist()
        demand = rng.multinomial(6, np.ones(m) / m).tolist()
        cost = rng.randint(0, 4, (n, m)).tolist()
        assert transport.cheapest_plan(supply, demand, cost) == brute_transport(supply, demand, cost)


def test_ollivier_of_known_graphs(spark):
    """Complete graph on n: W1 is |1/2 - 1/(2(n-1))|, so curvature is 1/2 + 1/(2(n-1)). A long cycle is flat."""
    k4 = {r[2] for r in transport.ollivier(both_ways(spark, list(itertools.combinations(range(4), 2)))).collect()}
    assert k4 == {round(0.5 + 1 / 6, 9)}
    ring = {r[2] for r in transport.ollivier(both_ways(spark, [(i, (i + 1) % 8) for i in range(8)])).collect()}
    assert ring == {0.0}


def test_iaaft_keeps_values_and_spectrum(spark):
    rng = np.random.RandomState(3)
    x = np.cumsum(rng.normal(size=128))
    y = surrogate.iaaft_series(x, np.random.RandomState(1))
    assert np.array_equal(np.sort(x), np.sort(y)) and not np.array_equal(x, y)
    a, b = np.abs(np.fft.rfft(x)), np.abs(np.fft.rfft(y))
    assert np.abs(a - b).sum() / a.sum() < 0.1
    f = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "node int, t int, v double")
    out = surrogate.iaaft(f, 2)
    assert out.count() == 256 and sorted(map(tuple, out.collect())) == sorted(map(tuple, surrogate.iaaft(f, 2).collect()))


def test_es_null_and_links(spark):
    counts = spark.createDataFrame([(3, 4), (3, 4), (1, 1)], "n1 int, n2 int")
    null = {(r["n1"], r["n2"]): r["q"] for r in surrogate.es_null(spark, counts, 50, 5, draws=40).collect()}
    assert set(null) == {(3, 4), (1, 1)} and all(list(q) == sorted(q) for q in null.values())
    assert surrogate.synchronised(np.array([0, 10]), np.array([0, 8]), 5) == 1.5
    assert surrogate.synchronised(np.array([0, 10]), np.array([0, 1]), 5) == 0.5


def test_chebyshev_passes_slow_and_stops_fast(spark):
    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * t / 100), np.sin(2 * np.pi * t / 4)
    y = surrogate.chebyshev_filter(slow + fast, 0.1)
    assert np.abs(y - slow)[50:-50].max() < 0.03
    flat = surrogate.chebyshev_filter(np.full(50, 3.0), 0.2)
    assert np.abs(flat / 3 - 1).max() < 0.02


def brute_merges(x, method):
    """Heights of merging the closest two clusters again and again, from all distances."""
    groups, out = [[i] for i in range(len(x))], []

    def d(a, b):
        pts = [float(np.linalg.norm(x[i] - x[j])) for i in a for j in b]
        if method == "ward":
            ca, cb = x[a].mean(0), x[b].mean(0)
            return float(np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * ((ca - cb) ** 2).sum()))
        return {"complete": max, "single": min, "average": lambda p: sum(p) / len(p)}[method](pts)

    while len(groups) > 1:
        h, i, j = min((d(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        out.append(h)
        groups[i] += groups.pop(j)
    return out


@pytest.mark.parametrize("method", ["ward", "complete", "single", "average"])
def test_merges_are_those_of_brute_force(method):
    x = np.random.RandomState(5).normal(size=(14, 3))
    assert K.merges(x, method)[:, 2] == pytest.approx(sorted(brute_merges(x, method)))


def test_merges_in_rounds_are_those_of_one_table(spark, monkeypatch):
    """More rows than are held at once were refused."""
    x = np.random.RandomState(2).normal(size=(300, 2))
    x[7] = x[90] = x[3]  # equal rows
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, x double, y double").repartition(3)
    whole = sorted(map(tuple, K.linkage(p, ["x", "y"]).collect()))
    monkeypatch.setattr(K, "MOST_ROWS", 20)
    monkeypatch.setattr(K, "BLOCK_ROWS", 30)
    z = sorted(map(tuple, K.linkage(p, ["x", "y"]).collect()))
    assert [r[0] for r in z] == list(range(300, 599)) and [r[3] for r in z] == pytest.approx([r[3] for r in whole])

    def groups(rows):
        under = {i: frozenset([i]) for i in range(300)}
        for k, a, b, _, n in rows:
            under[k] = under[a] | under[b]
            assert len(under[k]) == n and a < b
        return {g for g in under.values() if not g & {3, 7, 90} or len(g) > 2}

    assert groups(z) == groups(whole)


def test_tree_of_merges(spark):
    p = spark.createDataFrame([(0, 0.0), (1, 0.1), (2, 5.0), (3, 5.1), (4, 20.0)], "id int, x double")
    z = K.linkage(p, ["x"])
    assert {r["id"]: r["cluster"] for r in K.flat_clusters(z, 3).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    t = K.tree(z)
    assert t.filter("parent IS NULL").count() == 1
    top = K.split_group(t, spark.createDataFrame([(0,), (3,)], "id int"), miss=0).first()
    assert top["n"] == 2 and {r["leaf"] for r in K.leaves_of(t, spark.createDataFrame([(top["id"],)], "id int")).collect()} == {0, 1, 2, 3}


def test_kmeans_links(spark):
    nodes = spark.createDataFrame([(i, float(100 * (i // 4)), float(i % 4)) for i in range(8)], "node int, lon double, lat double")
    e = spark.createDataFrame([(a, b) for a in range(4) for b in range(4) if a < b] + [(a + 4, b + 4) for a in range(4) for b in range(4) if a < b], "src int, dst int")
    assert sorted(r[0] for r in K.kmeans_links(nodes, e, 2).groupBy("cluster").count().select("count").collect()) == [6, 6]


def test_fekete_spreads(spark):
    """Four points settle in a tetrahedron: every angle is acos(-1/3)."""
    g = grid.fekete(spark, 4, rounds=500)
    d = [r[0] for r in grid.distances(g).select("d").collect()]
    assert d == pytest.approx([math.acos(-1 / 3)] * 12, abs=0.01)


def test_snap_is_one_to_one(spark):
    g = spark.createDataFrame([(0, 0.4, 0.4), (1, 0.45, 0.45), (2, 100.0, 50.0)], "node int, lon double, lat double")
    out = {r["node"]: (r["lon"], r["lat"]) for r in grid.snap(g, 1.0).collect()}
    assert out[1] == (0.5, 0.5) and len(set(out.values())) == len(out) == 3


def test_nudge_never_worsens(spark):
    a = spark.createDataFrame([(i, 30.0 * i + 1, 0.0) for i in range(-3, 3)], "node int, lon double, lat double")
    b = spark.createDataFrame([(i, 30.0 * i, 0.0) for i in range(-3, 3)], "node int, lon double, lat double")
    spots = np.radians(30.0 * np.arange(-3, 3))

    def mean(p):
        lon, lat = (np.radians([r[c] for r in p.orderBy("node").collect()]) for c in ("lon", "lat"))
        return np.arccos(np.clip(np.cos(lat)[:, None] * np.cos(lon[:, None] - spots[None, :]), -1, 1)).min(1).mean()

    assert mean(grid.nudged(a, b, rounds=6)) < mean(a)



def test_gml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 1.5, -2.0), (1, 3.0, None)], "node int, lon double, lat double")
    edges = spark.createDataFrame([(0, 1, 0.25), (1, 0, 1e-7)], "src int, dst int, weight double")
    path = str(tmp_path / "net.gml")
    gml.write_gml(nodes, edges, path)
    n, e = gml.read_gml(spark, path)
    assert sorted(map(tuple, n.collect())) == [(0, 1.5, -2.0), (1, 3.0, None)]
    assert sorted(map(tuple, e.collect())) == [(0, 1, 0.25), (1, 0, 1e-7)]


def test_iaaft_limits_brute_force(spark):
    """All pairs, in blocks, against surrogates drawn one by one; the constant series is left out."""
    rng = np.random.RandomState(4)
    x = rng.normal(size=(13, 40)).cumsum(1)
    x[5] = 2.0
    f = spark.createDataFrame([(i, t, float(v)) for i, row in enumerate(x) for t, v in enumerate(row)], "node int, t int, v double")
    got = {(r["i"], r["j"]): r["limit"] for r in surrogate.iaaft_limits(f, 30, 0.9, block=4).collect()}
    live = [i for i in range(13) if i != 5]
    s = {i: [surrogate.iaaft_series(x[i], surrogate._seed(0, k, i)) for k in range(30)] for i in live}
    want = {(i, j): np.quantile([abs(round(np.corrcoef(a, b)[0, 1], 6)) for a, b in zip(s[i], s[j], strict=True)], 0.9) for i, j in itertools.combinations(live, 2)}
    assert set(got) == set(want) and got == pytest.approx(want, abs=2e-6)


def test_adj_iaaft_tests_every_node(spark, monkeypatch):
    """Links of nodes beyond the first 60 are found."""
    t = np.arange(24)
    x = np.random.RandomState(2).normal(size=(64, 24))
    x[62], x[63] = np.sin(t * t), np.sin(t * t) + 0.01 * np.cos(t)
    f = spark.createDataFrame([(i, int(k), float(v)) for i, row in enumerate(x) for k, v in enumerate(row)], "node int, t int, v double")
    monkeypatch.setattr(extended.S, "field_daily", lambda spark, sf_dir: f)
    assert (62, 63) in {(r["i"], r["j"]) for r in registry.queries()["adj_iaaft"](spark, "").collect()}
