"""Common neighbours by bit rows against matrices."""

from __future__ import annotations

import numpy as np
import pytest

from fieldweave.operators import closed


def planted(seed: int, symmetric: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers far apart, and a matrix of edges among them with a loop and a node that only points to others."""
    rng = np.random.RandomState(seed)
    a = rng.random_sample((90, 90)) < 0.2
    a = a | a.T if symmetric else a
    a[np.diag_indices(90)] = False
    return np.cumsum(rng.randint(1, 3_000_000, 90)) if seed % 2 else np.arange(90) * 3, a


@pytest.mark.parametrize("seed, symmetric", [(1, True), (2, True), (3, False), (4, False)])
def test_counts_are_those_of_the_matrix(spark, seed, symmetric, monkeypatch):
    ids, a = planted(seed, symmetric)
    rows = [(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(a), strict=True)]
    e = spark.createDataFrame([*rows, rows[0], (int(ids[0]), int(ids[0]))], "src int, dst int").repartition(3)
    u, s = (a | a.T).astype(int), a.astype(int) + a.T.astype(int)
    k, common = u.sum(1), u @ u
    want = {(int(ids[i]), int(ids[j])): (k[i], k[j], common[i, j]) for i in range(90) for j in range(i + 1, 90) if u[i, j]}
    found = closed.of_links(e, 3).collect()
    assert len(found) == len(want) and {(r["src"], r["dst"]): (r["src_k"], r["dst_k"], r["t"]) for r in found} == want
    curved = (u * (4 - k[:, None] - k[None] + 3 * common)).sum(1)
    want = {int(ids[i]): (k[i], (s == 2)[i].sum(), (u @ common)[i, i] // 2, (s @ s @ s)[i, i], curved[i]) for i in range(90)}
    assert {r["node"]: tuple(r)[1:] for r in closed.of_nodes(e, 3).collect()} == want


def test_wedges_are_never_rows(spark):
    """Half of all pairs of 1200 nodes: 215 million wedges (before: as many rows of a join)."""
    n = 1200
    ids = spark.range(n).select("id")
    e = ids.crossJoin(ids.withColumnRenamed("id", "dst")).selectExpr("cast(id as int) src", "cast(dst as int) dst").filter("(src + dst) % 2 = 0 AND src <> dst")
    plan = closed.of_nodes(e)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert {tuple(r)[1:4] for r in closed.of_nodes(e).collect()} == {(599, 599, 599 * 598 // 2)}


def test_blocks_meet_without_a_shuffle(spark):
    """Lists are shuffled once, when blocks are written (before: each to all pairs of blocks)."""
    ids, a = planted(2, True)
    e = spark.createDataFrame([(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(a), strict=True)], "src int, dst int")
    plan = closed.of_links(e, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan
