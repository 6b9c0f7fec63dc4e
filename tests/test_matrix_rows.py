"""Rows of a network's matrix, made in tasks from lists of links."""

from __future__ import annotations

import numpy as np
import pytest

from fieldweave.operators import attributes


@pytest.mark.parametrize("symmetric", [True, False])
def test_rows_against_a_matrix(spark, symmetric, monkeypatch):
    monkeypatch.setattr(attributes, "AT_ONCE", 100)
    rng, n = np.random.RandomState(4), 40
    m = np.where(rng.random_sample((n, n)) < 0.3, rng.random_sample((n, n)).round(6), 0)
    m[3, 5], m[7, 7], m[:, 11], m[11] = 1.00005, 0.5, 0, 0
    if symmetric:
        m = np.maximum(m, m.T)
        np.fill_diagonal(m, 0)
    else:
        m[8, 2], m[9, 1] = -0.25, 12.34565
    i, j = np.nonzero(m)
    edges = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), m[i, j].tolist(), strict=True)), "src int, dst int, weight double").repartition(3)
    want = {k: m[k] for k in set(i.tolist())}
    got = {r["src"]: r["values"] for r in attributes.wide_rows(edges, n, "weight").collect()}
    assert got.keys() == want.keys() and all(got[k] == want[k].tolist() for k in want)
    text = {r["src"]: r["row"] for r in attributes.text_rows(edges, n, "weight", 4).collect()}
    up = lambda x: np.sign(x) * np.floor(abs(x) * 1e4 + 0.5) / 1e4
    assert text == {k: ",".join(f"{up(x) + 0.0:.4f}" for x in want[k]) for k in want}


def test_repeated_links_are_added_up(spark):
    edges = spark.createDataFrame([(0, 1, 0.25), (0, 1, 0.5), (1, 2, None)], "src int, dst int, weight double")
    assert sorted(tuple(r) for r in attributes.text_rows(edges, 3, "weight", 2).collect()) == [(0, "0.00,0.75,0.00"), (1, "0.00,0.00,0.00")]
    assert {r["src"]: r["values"] for r in attributes.wide_rows(edges, 2, "weight").collect()} == {0: [0.0, 0.75], 1: [0.0, 0.0]}


def test_no_row_is_spread_by_columns(spark):
    plan = attributes.wide_rows(spark.createDataFrame([(0, 1, 0.25)], "src int, dst int, weight double"), 3, "weight")._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at" not in plan and "transform" not in plan


def test_attributes_of_a_kind_are_counted_once(spark, monkeypatch):
    from fieldweave.operators import closed
    from fieldweave.operators import graph as G

    nodes = spark.createDataFrame([(k, 0.0, 0.0) for k in range(4)], "node int, lon double, lat double")
    links = [(0, 1), (1, 2), (0, 2), (2, 3)]
    edges = spark.createDataFrame([(a, b, 1.0) for x, y in links for a, b in ((x, y), (y, x))], "src int, dst int, weight double")
    calls = []
    for module, name in ((closed, "of_nodes"), (G, "degrees")):
        plain = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *x, plain=plain, name=name, **y: calls.append(name) or plain(*x, **y))
    found = attributes.with_node_attributes(nodes, edges, "degree", "triangles", "in_degree", "clustering", "forman").orderBy("node").collect()
    assert [(r["degree"], r["triangles"], r["in_degree"], round(r["clustering"], 6)) for r in found] == [(4, 1, 2, 1.0), (4, 1, 2, 1.0), (6, 1, 3, 0.333333), (2, 0, 1, 0.0)]
    assert sorted(calls) == ["degrees", "of_nodes"]
