"""Runs compared, regions that follow each other and prepared fields, against planted cases."""

from __future__ import annotations

import numpy as np
import pytest

from fieldweave.operators import runs, sphere, surrogate
from fieldweave.sources import tables


def test_regions_that_follow_each_other(spark):
    b = spark.createDataFrame([(1, t) for t in (10, 40, 70)] + [(3, t) for t in (10, 40)], "node int, t int")
    a = spark.createDataFrame([(0, t + 2) for t in (10, 40, 70)] + [(2, 12)], "node int, t int")
    times = spark.range(100).select("id").withColumnRenamed("id", "t").selectExpr("CAST(t AS INT) t")
    plain = surrogate.sync_times(a, b, times, 3, 0.9).collect()
    assert len(plain) == 200
    assert {(r["way"], r["t"]): r["v"] for r in plain if r["v"]} == {("a_after_b", 12): 4, ("a_after_b", 42): 2, ("a_after_b", 72): 1}
    assert sorted(r["t"] for r in plain if r["peak"]) == [12, 42, 72]
    filtered = surrogate.sync_times(a, b, times, 3, 0.9, cutoff=0.475).filter("way = 'a_after_b'").orderBy("t").collect()
    x = np.zeros(100)
    x[[12, 42, 72]] = 4, 2, 1
    assert np.allclose([r["v"] for r in filtered], surrogate.chebyshev_filter(x, 0.475), atol=1e-8)
    assert {12, 42} <= {r["t"] for r in filtered if r["peak"]}
    none = surrogate.sync_times(a.filter("false"), b, times, 3, 0.9).collect()
    assert len(none) == 200 and not any(r["v"] or r["peak"] for r in none)


def grid(spark, n=60):
    return tables.fibonacci(spark, n)


def test_groupings_of_runs(spark):
    points = grid(spark)
    rows = [(run, level, node, (node // 20 if run < 3 else node % 3) if level else node // 10) for run in (1, 2, 3) for level in (0, 1) for node in range(60)]
    rows += [(3, 2, node, 0) for node in range(60)]  # the third run has a level more
    levels = spark.createDataFrame(rows, "run int, level int, node int, grp int")
    last = runs.last_levels(levels, 1)
    rand = {(r["a"], r["b"]): r["rand"] for r in runs.agreement(last).collect()}
    assert rand[1, 2] == 1.0 and rand[1, 3] == rand[2, 3] == pytest.approx(3 * 190 / 1770)
    own = points.filter("node = 25").selectExpr("'p' AS place", "lon", "lat")
    assert [(r["place"], r["node"]) for r in runs.nodes_at(points, own).collect()] == [("p", 25)]
    found = runs.groups_of_places(last, runs.nodes_at(points, own)).collect()
    assert {(r["run"], r["node"]) for r in found} == {(run, n) for run in (1, 2) for n in range(20, 40)} | {(3, n) for n in range(60)}
    same = runs.compared(points, levels.filter("run < 3"), own, 1, 0.3).collect()
    assert same and all(r["std"] < 1e-6 and r["runs"] == 2 for r in same) and max(r["mean"] for r in same) == pytest.approx(1.0)


def test_densities_of_sets_are_those_of_each(spark):
    points = grid(spark)
    sets = spark.createDataFrame([("a", n) for n in range(8)] + [("b", n) for n in (3, 50)], "k string, node int")
    got = {(r["k"], r["node"]): r["density"] for r in sphere.densities(points, sets, ["k"], 0.3).collect()}
    for k in "ab":
        one = {r["node"]: r["density"] for r in sphere.density(points, sets.filter(f"k = '{k}'").selectExpr("node", "1.0D AS weight"), 0.3).collect()}
        top = max(one.values())
        assert all(got.get((k, n), 0.0) == pytest.approx(d / top, abs=1e-12) for n, d in one.items())


def test_scott_width():
    assert runs.scott_width(100, 6400, 0.5) == pytest.approx(0.25) and runs.scott_width(0, 0) == 1.0


def test_a_field_is_prepared_once(spark, tmp_path):
    path = tmp_path / "f.parquet"
    path.mkdir()
    (path / "part-of-a-lost-run.parquet").write_bytes(b"half")
    made = []
    make = lambda: made.append(1) or spark.range(5)
    assert tables.read_through(spark, f"file://{path}", make).count() == 5
    assert tables.read_through(spark, f"file://{path}", make).count() == 5 and made == [1]
