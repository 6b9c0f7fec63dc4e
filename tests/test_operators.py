"""Analytic fixtures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldweave.functions import geo
from fieldweave.operators import community as C
from fieldweave.operators import field as T
from fieldweave.operators import graph as G
from fieldweave.operators import grid, paths, similarity
from fieldweave.plans import registry
from fieldweave.sources import tables


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, 0.5, 0.5) for a, b in pairs], "src int, dst int, corr double, weight double")


def nodes_of(spark, n):
    return spark.range(n).selectExpr("cast(id as int) node", "cast(id as double) lon", "0D lat")


def test_triangle_plus_tail(spark):
    und = [(0, 1), (1, 2), (0, 2), (2, 3)]
    e, n = edges_of(spark, und + [(b, a) for a, b in und]), nodes_of(spark, 4)
    assert sorted(map(tuple, G.triangles(n, e).collect())) == [(0, 1), (1, 1), (2, 1), (3, 0)]
    c = {r[0]: r[1] for r in G.clustering(n, e).collect()}
    assert c[0] == c[1] == 1 and c[2] == pytest.approx(1 / 3, abs=1e-8) and c[3] == 0
    assert {(r[0], r[1]): r[2] for r in G.forman(e).collect()} == {(0, 1): 3, (0, 2): 2, (1, 2): 2, (2, 3): 0}


def test_betweenness_of_a_path(spark):
    und = [(0, 1), (1, 2)]
    n, e = nodes_of(spark, 3), edges_of(spark, und + [(y, x) for x, y in und])
    for rows in (paths.BLOCK_ROWS, 3):
        assert {r[0]: r[1] for r in paths.betweenness(n, e, rows).collect()} == {0: 0.0, 1: 1.0, 2: 0.0}
        assert {r["betweenness"] for r in paths.edge_betweenness(n, e, rows).collect()} == {round(2 / 6, 9)}


def test_betweenness_by_counting_paths(spark):
    """Directed, with equal paths, a loop, a node without links and an unreachable part."""
    pairs = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 0), (4, 5), (5, 5), (6, 7)]
    n, e = nodes_of(spark, 9), edges_of(spark, pairs)
    out, every = {}, {}
    for s, d in pairs:
        if s != d:
            out.setdefault(s, []).append(d)
    through, over = dict.fromkeys(range(9), 0.0), {p: 0.0 for p in pairs if p[0] != p[1]}
    for s in range(9):
        level, seen = [[s]], {s}
        while level:
            for p in level:
                every.setdefault((s, p[-1]), []).append(p)
            level = [[*p, v] for p in level for v in out.get(p[-1], []) if v not in seen]
            seen |= {p[-1] for p in level}
    for (s, t), ps in every.items():
        for p in ps if s != t else []:
            for v in p[1:-1]:
                through[v] += 1 / len(ps)
            for x in zip(p, p[1:]):
                over[x] += 1 / len(ps)
    assert {r[0]: r[1] for r in paths.betweenness(n, e, 20).collect()} == {k: round(v / 56, 9) for k, v in through.items()}
    assert {(r[0], r[1]): r[2] for r in paths.edge_betweenness(n, e, 20).collect()} == {k: round(v / 72, 9) for k, v in over.items()}
    assert {(r["s"], r["v"]): (r["hops"], int(r["paths"])) for r in paths.distances(n, e).collect()} == {k: (len(p[0]) - 1, len(p)) for k, p in every.items()}


def test_betweenness_of_a_dense_network_needs_no_rows_of_paths(spark, monkeypatch):
    """The lists in tasks, cut in pieces and strips, give what joins give; steps of paths were rows of joins before."""
    from fieldweave.operators.lineage import settle

    rng = np.random.RandomState(3)
    a = np.argwhere((rng.random_sample((60, 60)) < 0.15) & ~np.eye(60, dtype=bool))
    n, e = nodes_of(spark, 60), edges_of(spark, [(int(x), int(y)) for x, y in a if x > 1]).repartition(3)  # two nodes that lead nowhere
    monkeypatch.setattr(paths, "PIECE", 90)
    joined = settle(paths.edge_shares(n, e.select("src", "dst")))
    monkeypatch.setattr(paths, "frontiers", None)  # what joins start with
    for rows in (paths.BLOCK_ROWS, 700):
        over = {(r[0], r[1]): r[2] for r in paths.edge_betweenness(n, e, rows).collect()}
        assert len(over) == e.count()
        assert over == pytest.approx({(r["src"], r["dst"]): r["share"] / (60 * 59) for r in joined.collect()}, abs=2e-9)
        through = {r["src"]: r["b"] for r in joined.groupBy("src").agg(F.sum("through").alias("b")).collect()}
        assert {r[0]: r[1] for r in paths.betweenness(n, e, rows).collect()} == pytest.approx({k: through.get(k, 0.0) / (59 * 58) for k in range(60)}, abs=2e-9)
    src, count = np.unique(a[:, 0].astype(np.int32), return_counts=True)
    piece = pd.DataFrame({"piece": [0], "src": [src.tobytes()], "count": [count.astype(np.int32).tobytes()], "dst": [a[:, 1].astype(np.int32).tobytes()]})
    whole = paths._brandes(paths._Lists(piece, 60), np.arange(60), 60, True)
    monkeypatch.setattr(paths, "STRIP", 400)
    cut = paths._brandes(paths._Lists(piece, 60), np.arange(60), 60, True)
    assert cut[0] == pytest.approx(whole[0]) and cut[1][0] == pytest.approx(whole[1][0])


def test_labels_spread_by_lists_as_by_joins(spark, monkeypatch):
    """Directed edges, some twice, far numbers, a neighbour that is no node and a node without links; edges were gone over and shuffled in each round before."""
    rng = np.random.RandomState(4)
    ids = np.cumsum(rng.randint(1, 60_000, 40))
    a = [(int(ids[x]), int(ids[y])) for x, y in np.argwhere(rng.random_sample((40, 40)) < 0.08) if 39 not in (x, y)]
    e = edges_of(spark, [*a, *a[:9], (int(ids[3]), int(ids[3])), (int(ids[0]), 7)]).repartition(3)
    n = spark.createDataFrame([(int(i),) for i in ids], "node int")
    want = sorted(map(tuple, C._propagated_by_joins(n.selectExpr("node", "node label"), e, 5).collect()))
    monkeypatch.setattr(C, "undirected", None)  # what joins start with
    assert sorted(map(tuple, C.label_propagation(n, e).collect())) == want and len({r[1] for r in want}) > 1


def test_one_way_prunes_to_nothing(spark):
    n, e = G.prune(nodes_of(spark, 3), edges_of(spark, [(0, 1), (1, 2)]))
    assert n.count() == 0 and e.count() == 0


def test_constant_series_is_left_out(spark):
    f = spark.createDataFrame([(k, t, float(v)) for k, s in enumerate(([1, 2, 3], [1, 1, 1], [3, 2, 1])) for t, v in enumerate(s)], "node int, t int, v double")
    assert list(map(tuple, similarity.pearson(f).collect())) == [(0, 2, -1.0)]
    assert list(map(tuple, similarity.pearson_blocked(f, 3).collect())) == [(0, 2, -1.0)]


def test_density_ties_stay_and_zero_is_empty(spark):
    p = spark.createDataFrame([(0, 1, 0.9), (0, 2, -0.5), (1, 2, 0.5)], "i int, j int, r double")
    assert similarity.density_edges(p, 3, 0.8).count() == 6  # k = 7: four off-diagonal places, second pair ties with the third
    assert similarity.density_edges(p, 3, 0.0).count() == 0
    assert similarity.density_edges(p, 3, 5.0).count() == 2 * p.count()  # more places than pairs


def test_average_ranks(spark):
    f = spark.createDataFrame([(0, t, v) for t, v in enumerate((1.0, 2.0, 2.0, 4.0))], "node int, t int, v double")
    assert [r["v"] for r in T.average_ranks(f).orderBy("t").collect()] == [1, 2.5, 2.5, 4]


def test_quantiles(spark):
    f = spark.range(10).selectExpr("0 node", "id t", "cast(id as double) v")
    assert T.quantiles(f, 0.95).first()["q"] == pytest.approx(8.55) and T.quantiles(f, 0.9).first()["q"] == pytest.approx(8.1)


def test_dateline(spark):
    p = spark.createDataFrame([(0, 175.0, 0.0), (1, -175.0, 0.0), (2, 0.0, 0.0)], "node int, lon double, lat double")
    assert sorted(r[0] for r in grid.cut(p, (170, -170), (-10, 10), dateline=True).collect()) == [0, 1]
    with pytest.raises(ValueError):
        grid.cut(p, (170, -170), (-10, 10))


def test_half_the_globe(spark):
    from pyspark.sql import functions as F

    d = spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0), 6371.0)).first()[0]
    assert d == pytest.approx(math.pi * 6371, abs=0.01)
    assert geo.num_points(geo.spacing_km(1000)) in (999, 1000)


def test_p_values_and_holm(spark):
    assert similarity.p_value(0.5, 30) == pytest.approx(0.00487, abs=2e-4)
    r = similarity.r_critical(30, 0.01)
    assert similarity.p_value(r, 30) == pytest.approx(0.01, rel=1e-6)
    p = spark.createDataFrame([(0, k, similarity.r_critical(30, a)) for k, a in enumerate((0.0099, 0.0399, 0.0299, 0.0049), 1)], "i int, j int, r double")
    assert sorted(x["j"] for x in similarity.holm(p, 30, 0.05, 4).collect()) == [1, 4]


def test_month_window_wraps(spark):
    f = spark.sql("SELECT 0 node, add_months(DATE '2000-01-01', cast(id as int)) t, 1D v FROM range(12)")
    assert [i + 1 for i, r in enumerate(T.month_window(f, 12, 2).orderBy("t").collect()) if r["v"]] == [1, 2, 12]


def test_shuffle_keeps_each_years_values(spark):
    f = spark.sql("SELECT 0 node, add_months(DATE '2000-01-01', cast(id as int)) t, cast(id as double) v FROM range(24)")
    key = lambda df: sorted((r["t"].year, r["v"]) for r in df.collect())
    assert key(T.shuffle_years(f, 1)) == key(f)
    assert sorted(map(tuple, T.shuffle_years(f, 1).collect())) == sorted(map(tuple, T.shuffle_years(f, 1).collect()))


def test_event_sync_half_counts(spark):
    ev = spark.createDataFrame([(0, 0), (0, 100), (1, 0), (1, 103)], "node int, t long")
    assert {(r[0], r[1]): r[2] for r in similarity.event_sync(ev, 10).collect()} == {(0, 1): 0.5, (1, 0): 1.5}


def test_tree(spark):
    t = spark.createDataFrame([(0, 4), (1, 4), (2, 5), (3, 5), (4, 6), (5, 6), (6, None)], "id int, parent int")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a int, b int")
    assert sorted(map(tuple, C.common_ancestor(t, pairs).collect())) == [(0, 1, 4), (0, 2, 6)]


def test_sinks(spark, tmp_path):
    tables.write_table(nodes_of(spark, 3), f"{tmp_path}/n", {"q": 0.9})
    assert tables.read_meta(spark, f"{tmp_path}/n") == {"q": 0.9} and spark.read.parquet(f"{tmp_path}/n").count() == 3


def test_link_null_of_many_links(spark):
    """Limits of every link count against densities drawn apart from the operator, for counts of few and of many links."""
    nodes = tables.fibonacci(spark, 70)
    counts = spark.createDataFrame([(1,), (2,), (9,), (40,), (9,)], "k long")
    got = {(r["k"], r["node"]): r["limit"] for r in G.link_null(nodes, counts, 0.5, 1500, 0.9, block=32).collect()}
    assert set(got) == {(k, i) for k in (2, 9, 40) for i in range(70)}
    p, rng = np.radians([tuple(r) for r in nodes.orderBy("node").select("lon", "lat").collect()]), np.random.RandomState(7)
    for k in (2, 9, 40):
        lon, lat = p[rng.randint(70, size=(1500, k)), 0], p[rng.randint(70, size=(1500, k)), 1]
        for i in (0, 20, 69):
            d = np.arccos(np.clip(np.sin(lat) * np.sin(p[i, 1]) + np.cos(lat) * np.cos(p[i, 1]) * np.cos(lon - p[i, 0]), -1, 1))
            assert got[k, i] == pytest.approx(np.quantile(np.exp(-((d / 0.5) ** 2) / 2).mean(1), 0.9), rel=0.12)


def test_lb_prune_keeps_bundles_of_many_links(spark, monkeypatch):
    """A source whose 12 links end side by side keeps them; one with 12 links all over the sphere loses some."""
    nodes = tables.fibonacci(spark, 200)
    near = [r["b"] for r in grid.k_nearest(nodes, 11).filter("a = 100").collect()] + [100]
    far = list(range(3, 200, 17))
    monkeypatch.setattr(registry, "network", lambda spark, sf_dir: (nodes, edges_of(spark, [(0, i) for i in near] + [(1, i) for i in far])))
    got = {(r["src"], r["dst"]) for r in registry.queries()["lb_prune"](spark, "").collect()}
    assert {d for s, d in got if s == 0} >= set(near[:6]) | {100} and len({d for s, d in got if s == 1}) < len(far)


def test_directed_clustering_and_triangles(spark):
    """Against matrices: diag((A + A^T)^3) over 2 (d (d - 1) - 2 reciprocal), on a seeded directed graph."""
    rng = np.random.RandomState(3)
    a = (rng.rand(25, 25) < 0.2).astype(int)
    np.fill_diagonal(a, 0)
    n = spark.createDataFrame([(i,) for i in range(25)], "node int")
    e = spark.createDataFrame([(int(i), int(j), 1.0, 1.0) for i, j in zip(*np.nonzero(a), strict=True)], "src int, dst int, corr double, weight double")
    s = a + a.T
    d, r = s.sum(1), (s == 2).sum(1)
    c = np.diag(s @ s @ s) / np.maximum(2 * (d * (d - 1) - 2 * r), 1)
    got = {x["node"]: x["clustering"] for x in G.clustering(n, e).collect()}
    assert all(abs(got[i] - c[i]) < 1e-8 for i in range(25))
    b = (s > 0).astype(int)
    assert {x["node"]: x["triangles"] for x in G.triangles(n, e).collect()} == {i: int(v) // 2 for i, v in enumerate(np.diag(b @ b @ b))}
