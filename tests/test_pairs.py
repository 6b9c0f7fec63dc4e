from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.operators import graph as G
from fieldweave.operators import places as P


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_pairs_say_what_edges_say(spark):
    """The forms on pairs give the rows of those on edges, of which each direction is a row; without a shuffle if the edges are symmetric."""
    both = spark.createDataFrame([(a, b, (a * 7 + b) % 10 / 10 - 0.4) for a in range(12) for b in range(a + 1, 12) if (a * b) % 3], "i int, j int, c double")
    e = both.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("c").alias("corr"), F.abs("c").alias("weight"))
    e = e.union(e.select("dst", "src", "corr", "weight"))
    keep = (F.col("src") < F.col("dst")) | ((F.col("src") + F.col("dst")) % 3 == 0)
    g = e.filter(keep)
    nodes = spark.range(12).select(F.col("id").cast("int").alias("node"), (F.col("id") * 20.0 - 100).alias("lon"), (F.col("id") * 3.0).alias("lat"))
    quick = G.pairs_of_symmetric(e, (F.col("a") + F.col("b")) % 3 == 0)
    assert "Exchange hashpartitioning" not in quick._jdf.queryExecution().toString()
    one, two = nodes.filter("node < 5"), nodes.filter("node % 2 = 1")
    for p in (quick, G.pairs(g)):
        assert _rows(G.symmetrised_pairs(p), "src", "dst", "corr") == _rows(G.symmetrise(g), "src", "dst", "corr")
        assert _rows(G.stronger_pairs(p), "src", "dst", "weight") == _rows(G.make_undirected(g), "src", "dst", "weight")
        assert _rows(G.ends_of_pairs(p), "src", "dst") == _rows(G.undirected(g), "src", "dst")
        assert _rows(G.looked_up_pairs(p, "weight"), "u", "v", "weight") == _rows(G.lookup(g, e.select(F.col("src").alias("u"), F.col("dst").alias("v")), "weight"), "u", "v", "weight")
        assert _rows(G.pairs_between_regions(p, one, two), "src", "dst") == _rows(G.between_regions(g, one, two), "src", "dst")
        assert _rows(G.oriented_pairs(nodes, G.ends_of_pairs(p)), "u", "v", "u_lon") == _rows(G.oriented(nodes, g), "u", "v", "u_lon")
        assert P.info_of_pairs(nodes, p).first() == P.info(nodes, g).select("nodes", "edges", "directed", "weighted", "mean_degree").first()


def test_plans_over_all_edges_write_none(spark):
    """Edges are as many as the square of the nodes; a plan that goes over them once leaves no table of them and shuffles none."""
    from fieldweave.plans import registry

    from .conftest import DATA

    for name in ("symmetrise_dense", "edges_dedup", "edge_attr_lookup", "link_length"):
        plan = registry.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning(src" not in plan and "hashpartitioning(a" not in plan, name


def test_pruning_writes_nodes_alone(spark, monkeypatch):
    """A chain falls apart from both ends, round by round, and leaves the ring that it hangs on."""
    seen, plain = [], G.settle
    monkeypatch.setattr(G, "settle", lambda df: seen.append(df.columns) or plain(df))
    nodes = spark.createDataFrame([(k, float(k)) for k in range(9)], "node int, lon double")
    links = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6), (6, 7), (7, 99)]
    edges = spark.createDataFrame([(a, b, 0.5) for a, b in links], "src int, dst int, corr double")
    n, e = G.prune(nodes, edges)
    assert _rows(n, "node", "lon") == [(k, float(k)) for k in (3, 4, 5)] and n.columns == nodes.columns
    assert _rows(e, "src", "dst", "corr") == [(3, 4, 0.5), (4, 5, 0.5), (5, 3, 0.5)] and e.columns == edges.columns
    assert seen and all(columns == ["node"] for columns in seen)


def test_lengths_of_the_upper_quantile_write_no_edges(spark, monkeypatch):
    from fieldweave.plans import registry

    from .conftest import DATA

    def written(*_, **__):
        raise AssertionError("edges are written")

    monkeypatch.setattr(registry, "settle", written)
    assert registry.queries()["link_length_quantile"](spark, f"{DATA}/sf0.001").count() >= 0
    assert registry.queries()["prune_isolated"](spark, f"{DATA}/sf0.001").count() >= 0
