"""Nearest points and densities by cells against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from fieldweave.operators import sphere

P, Q = "node int, lon double, lat double", "q int, qlon double, qlat double"


def uneven(seed=3):
    """Points all over the sphere, many in one spot, some at the poles and along the date line, some twice in one place."""
    r = np.random.RandomState(seed)
    z = r.uniform(-1, 1, 150)
    a = np.stack([r.uniform(-180, 180, 150), np.degrees(np.arcsin(z))], 1)
    b = np.stack([10 + r.normal(0, 0.05, 400), 45 + r.normal(0, 0.05, 400)], 1)
    c = np.array([[0.0, 90.0], [120.0, -90.0], [180.0, 5.0], [-180.0, 5.0], [179.9, 5.0], [-179.9, 5.0], [10.0, 45.0], [10.0, 45.0]])
    return np.concatenate([a, b, c])


def arcs(x, y):
    lon, lat, lon2, lat2 = (np.radians(v) for v in (x[:, 0][:, None], x[:, 1][:, None], y[:, 0][None], y[:, 1][None]))
    h = np.sin((lat2 - lat) / 2) ** 2 + np.cos(lat) * np.cos(lat2) * np.sin((lon2 - lon) / 2) ** 2
    return 2 * np.arcsin(np.sqrt(np.minimum(1, h)))


def table(spark, x, schema):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], schema)


@pytest.mark.parametrize(("k", "degrees", "others"), [(1, False, False), (5, False, True), (3, True, False), (1000, False, True)])
def test_k_nearest(spark, k, degrees, others):
    x = uneven() if k < 1000 else uneven()[:40]
    q = np.concatenate([x[:60], [[-170.0, -80.0], [10.01, 45.0]]]) if not others else x
    d = ((q[:, None] - x[None]) ** 2).sum(2).round(9) if degrees else arcs(q, x).round(12)
    got = {}
    for r in sphere.k_nearest(table(spark, x, P), table(spark, q, Q), k, degrees, others).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["d"], r["node"]))
    for i in range(len(q)):
        own = [j for j in np.lexsort((np.arange(len(x)), d[i])) if not (others and j == i)][:k]
        mine = [n for _, _, n in sorted(got[i])]
        assert [round(v, 9) for _, v, _ in sorted(got[i])] == pytest.approx([float(d[i, j]) for j in own], abs=2e-9)
        assert len(mine) == len(own) and len(set(mine)) == len(own)
        ties = d[i][np.sort(own)]
        if len(np.unique(d[i].round(9))) == len(x) and len(ties):
            assert mine == own


def test_within_and_density(spark):
    x = uneven()
    q, d = x[::7], arcs(x[::7], x)
    got = sorted((r["q"], r["node"]) for r in sphere.within(table(spark, x, P), table(spark, q, Q), 0.2).collect())
    assert got == [(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 0.2), strict=True)]
    w = [(k, float(k % 3)) for k in range(0, len(x), 5)]
    dense = {r["node"]: r["density"] for r in sphere.density(table(spark, x, P), spark.createDataFrame(w, "node int, weight double"), 0.3, cut=math.pi / 0.3).collect()}
    ids, weight = np.array([i for i, _ in w]), np.array([v for _, v in w])
    want = (np.exp(-((arcs(x, x[ids]) / 0.3) ** 2) / 2) * weight).sum(1) / weight.sum()
    assert [dense[k] for k in range(len(x))] == pytest.approx(want.tolist(), abs=1e-9)


def test_density_in_parts_without_rows_of_pairs(spark, monkeypatch):
    x = uneven()
    near = arcs(x, x) <= 0.3
    want = np.where(near, np.exp(-((arcs(x, x) / 0.05) ** 2) / 2), 0).mean(1)

    def rows(*_):
        raise AssertionError("pairs are rows")

    monkeypatch.setattr(sphere, "within", rows)
    monkeypatch.setattr(sphere, "PART_POINTS", 40)
    for least in (1, 1000):
        monkeypatch.setattr(sphere, "CELL_POINTS", least)
        points = table(spark, x, P)
        dense = {r["node"]: r["density"] for r in sphere.density(points, points.selectExpr("node", "1D weight"), 0.05).collect()}
        assert [dense[k] for k in range(len(x))] == pytest.approx(want.tolist(), abs=1e-12)


def test_densities_without_rows_of_pairs(spark, monkeypatch):
    x = uneven()
    sets = {"a": [*range(0, 150, 2)], None: [*range(100, 400, 3)], "c": [555]}
    k = np.where(arcs(x, x) <= 0.6, np.exp(-((arcs(x, x) / 0.1) ** 2) / 2), 0)
    want = {(s, n): v / k[ids].sum(0).max() for s, ids in sets.items() for n, v in enumerate(k[ids].sum(0)) if v > 0}

    def rows(*_):
        raise AssertionError("pairs are rows")

    monkeypatch.setattr(sphere, "within", rows)
    monkeypatch.setattr(sphere, "PART_POINTS", 40)
    members = spark.createDataFrame([(s, n) for s, ids in sets.items() for n in [*ids, ids[0]]], "s string, node int")
    got = {(r["s"], r["node"]): r["density"] for r in sphere.densities(table(spark, x, P), members, ["s"], 0.1).collect()}
    assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key], abs=1e-12) for key in want)


def test_outliers_fall_out(spark):
    x = uneven()
    region = spark.createDataFrame([(k,) for k in [*range(150, 300), 3]], "node int")
    left = {r["node"] for r in sphere.without_outliers(table(spark, x, P), region, 0.02).collect()}
    assert left == set(range(150, 300))


def test_nothing(spark):
    x, none = table(spark, uneven()[:3], P), table(spark, [], Q)
    assert sphere.k_nearest(x, none).count() == 0 and sphere.k_nearest(x.filter("false"), table(spark, uneven()[:2], Q)).count() == 0
    assert sphere.within(x, none, 1.0).count() == 0 and sphere.bandwidth(x.filter("node = 0")) == 0.0
