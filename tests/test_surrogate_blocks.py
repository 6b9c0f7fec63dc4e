"""Limits of surrogates without a shuffle of what was drawn."""

from __future__ import annotations

import numpy as np

from fieldweave.operators import surrogate


def test_drawn_series_are_not_shuffled(spark):
    """Before, each node's surrogates went to every block of nodes, so that the shuffle grew with the square of the nodes."""
    x = np.random.RandomState(3).random_sample((9, 12))
    f = spark.createDataFrame([(i, t, float(x[i, t])) for i in range(9) for t in range(12)], "node int, t int, v double")
    out = surrogate.iaaft_limits(f, 20, 0.9, block=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    rows = out.collect()
    assert sorted((r["i"], r["j"]) for r in rows) == [(i, j) for i in range(9) for j in range(i + 1, 9)]
    want = {(r["i"], r["j"]): (r["r"], r["limit"]) for r in surrogate.iaaft_limits(f, 20, 0.9, block=50).collect()}
    assert {(r["i"], r["j"]): (r["r"], r["limit"]) for r in rows} == want
