"""Measures and queries of a network: nodes (node, lon, lat, ...) and directed edges (src, dst, corr, weight, ...). No matrix is ever built."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import RADIUS_KM, haversine, in_box
from . import closed
from .lineage import drop, settle

#: Most nodes of a table that goes to every task (some 20 MB a million of a number and two coordinates).
SPREAD_NODES = 2_000_000


def spread(nodes: DataFrame) -> DataFrame:
    """A narrow table of nodes, given to every task if it is small: edges then stay where they are."""
    return F.broadcast(nodes) if nodes.count() <= SPREAD_NODES else nodes


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once, src < dst."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src < dst").distinct()


def symmetrise(edges: DataFrame) -> DataFrame:
    """A * A^T: edges whose reverse is there too."""
    return edges.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi")


def make_undirected(edges: DataFrame) -> DataFrame:
    """max(A, A^T) with the stronger weight."""
    return edges.select("src", "dst", "weight").union(edges.select(F.col("dst"), F.col("src"), "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def pairs(edges: DataFrame) -> DataFrame:
    """(a, b, there, back), a < b: each linked pair once, with the columns of the edge from a to b and of the one from b to a as structs, null where there is no such edge. Edges are distinct and no loops."""
    row = F.struct(*(c for c in edges.columns if c not in ("src", "dst")))
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"), row.alias("x"))
    return e.groupBy("a", "b").agg(F.first(F.when(F.col("up"), F.col("x")), True).alias("there"), F.first(F.when(~F.col("up"), F.col("x")), True).alias("back"))


def pairs_of_symmetric(edges: DataFrame, back: Column) -> DataFrame:
    """pairs() of edges that are there in both directions with equal columns, those from b to a kept where `back` (of a and b) holds: no row has to meet another."""
    e = edges.filter("src < dst").withColumnsRenamed({"src": "a", "dst": "b"})
    row = F.struct(*(c for c in edges.columns if c not in ("src", "dst")))
    return e.select("a", "b", row.alias("there"), F.when(back, row).alias("back"))


def ends_of_pairs(p: DataFrame) -> DataFrame:
    """Each pair once, src < dst."""
    return p.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _both(p: DataFrame, there: Column, back: Column) -> DataFrame:
    """(src, dst, x): both directions of each pair, with a value each."""
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), there.alias("x")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), back.alias("x")))
    return p.select(F.explode(ways).alias("e")).select("e.src", "e.dst", "e.x")


def symmetrised_pairs(p: DataFrame) -> DataFrame:
    """symmetrise() of pairs."""
    return _both(p.filter("there IS NOT NULL AND back IS NOT NULL"), F.col("there"), F.col("back")).select("src", "dst", "x.*")


def stronger_pairs(p: DataFrame) -> DataFrame:
    """make_undirected() of pairs."""
    w = F.greatest("there.weight", "back.weight")
    return _both(p, w, w).withColumnRenamed("x", "weight")


def looked_up_pairs(p: DataFrame, attr: str) -> DataFrame:
    """lookup() of pairs, both ways round."""
    x, y = F.col(f"there.{attr}"), F.col(f"back.{attr}")
    return _both(p, F.coalesce(x, y), F.coalesce(y, x)).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("x").alias(attr))


def intersected_pairs(p: DataFrame, first: Column, second: Column) -> DataFrame:
    """intersect() of two networks of the same pairs, given by conditions on a pair."""
    return ends_of_pairs(p.filter(first & second))


def oriented_pairs(nodes: DataFrame, u: DataFrame) -> DataFrame:
    """oriented() of pairs that are there once."""
    e = with_ends(u, nodes, "lon", "lat")
    swap = F.col("src_lon") > F.col("dst_lon")
    pick = lambda a, b, name: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(name)
    return e.select(pick("src", "dst", "u"), pick("dst", "src", "v"), pick("src_lon", "dst_lon", "u_lon"), pick("src_lat", "dst_lat", "u_lat"), pick("dst_lon", "src_lon", "v_lon"), pick("dst_lat", "src_lat", "v_lat"))


def pairs_between_regions(p: DataFrame, r1: DataFrame, r2: DataFrame) -> DataFrame:
    """between_regions() of pairs: those with an edge out of the one region and one out of the other."""
    for end in ("a", "b"):
        for k, r in ((1, r1), (2, r2)):
            p = p.join(spread(r.select(F.col("node").alias(end), F.lit(True).alias(f"{end}{k}"))), end, "left")
    out = lambda k: (F.col("there").isNotNull() & F.col(f"a{k}").isNotNull()) | (F.col("back").isNotNull() & F.col(f"b{k}").isNotNull())
    return ends_of_pairs(p.filter(out(1) & out(2)))


def sparsity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("n")).join(edges.agg(F.count(F.lit(1)).alias("e"))).select(F.round(F.col("e") / (F.col("n") * F.col("n")), 9).alias("sparsity"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an outgoing or without an incoming edge."""
    src, dst = edges.select(F.col("src").alias("node")).distinct(), edges.select(F.col("dst").alias("node")).distinct()
    return nodes.select("node").join(src, "node", "left_anti").union(nodes.select("node").join(dst, "node", "left_anti")).distinct()


def without(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = nodes.join(gone, "node", "left_anti")
    return left, within(edges, left)


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    s, d = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return edges.join(s, "src", "left_semi").join(d, "dst", "left_semi")


def prune(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take isolated nodes away until none is left. A round goes over the edges where they are and writes the nodes that stay; edges are as many as the square of the nodes and are neither written nor shuffled."""
    kept, left, count = None, edges, nodes.count()
    way = lambda end, out, into: F.struct(F.col(end).alias("node"), F.lit(out).alias("out"), F.lit(into).alias("into"))
    while True:
        ends = left.select(F.explode(F.array(way("src", True, False), way("dst", False, True))).alias("e")).groupBy("e.node").agg(F.max("e.out").alias("out"), F.max("e.into").alias("into"))
        now = settle((nodes if kept is None else kept).select("node").join(ends.filter("out AND into").select("node"), "node", "left_semi"))
        drop(kept)
        before, count = count, now.count()
        if count == before:
            return (nodes, edges) if left is edges else (nodes.join(spread(now), "node", "left_semi").select(*nodes.columns), between(edges, now, now).select(*edges.columns))
        kept, left = now, between(edges, now, now)


def cut_network(nodes: DataFrame, edges: DataFrame, lons: tuple[float, float], lats: tuple[float, float], dateline: bool = False) -> tuple[DataFrame, DataFrame]:
    inside = nodes.filter(in_box(F.col("lon"), F.col("lat"), lons, lats, dateline))
    return prune(inside, within(edges, inside))


def _counts(edges: DataFrame, end: str, name: str) -> DataFrame:
    return edges.groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias(name))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """in_degree is the row sum and out_degree the column sum (columns are outgoing), divergence their difference, degree their sum, weighted_degree that of weights. One pass over the edges counts all."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), one.alias("i"), none.alias("o")), F.struct(F.col("dst").alias("node"), none.alias("i"), one.alias("o"))))
    sums = edges.select(ends.alias("e"), "weight").groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.sum("weight").alias("weighted_degree"))
    out = nodes.select("node").join(sums, "node", "left").fillna(0)
    return out.select("node", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"), (F.col("in_degree") - F.col("out_degree")).alias("divergence"), F.round("weighted_degree", 6).alias("weighted_degree"))


def triangles(nodes: DataFrame, edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """found: closed.of_nodes(edges), if it is there already."""
    found = closed.of_nodes(edges) if found is None else found
    return nodes.select("node").join(found.select("node", "triangles"), "node", "left").fillna(0)


def _fagiolo() -> Column:
    """Directed clustering of a row of closed.of_nodes: the diagonal of (A + A^T)^3 over 2 (d (d - 1) - 2 reciprocal)."""
    d = F.col("k") + F.col("r")
    c = F.try_divide(F.col("cubes"), 2 * (d * (d - 1) - 2 * F.col("r")))
    return F.round(F.coalesce(c, F.lit(0.0)), 9)


def clustering(nodes: DataFrame, edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Directed clustering (Fagiolo 2007): closed directed triples over 2 (d (d - 1) - 2 reciprocal). On a symmetric edge set it equals 2T / (k (k - 1)). found: closed.of_nodes(edges), if it
    is there already."""
    found = closed.of_nodes(edges) if found is None else found
    return nodes.select("node").join(found.select("node", _fagiolo().alias("clustering")), "node", "left").fillna(0.0)


def with_ends(edges: DataFrame, nodes: DataFrame, *cols: str) -> DataFrame:
    s = nodes.select(F.col("node").alias("src"), *(F.col(c).alias(f"src_{c}") for c in cols))
    d = nodes.select(F.col("node").alias("dst"), *(F.col(c).alias(f"dst_{c}") for c in cols))
    return edges.join(spread(s), "src").join(spread(d), "dst")


def edge_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per edge: sum of the ends' clustering, sum of their inverses (null if one is 0), and half the sum of triangles over degree."""
    found = closed.of_nodes(edges).select("node", _fagiolo().alias("clustering"), "triangles", "k")
    n = settle(nodes.select("node").join(found, "node", "left").fillna(0))
    e = with_ends(edges.select("src", "dst"), n, "clustering", "triangles", "k")
    c1, c2 = F.col("src_clustering"), F.col("dst_clustering")
    ratio = (F.try_divide(F.col("src_triangles"), F.col("src_k")) + F.try_divide(F.col("dst_triangles"), F.col("dst_k"))) / 2
    return e.select("src", "dst", F.round(c1 + c2, 6).alias("cc"), F.round(F.try_divide(F.lit(1.0), c1) + F.try_divide(F.lit(1.0), c2), 4).alias("inv_cc"), F.round(ratio, 6).alias("cdr"))


def forman(edges: DataFrame) -> DataFrame:
    """Curvature 4 - k_u - k_v + 3 T_uv of each undirected edge."""
    return closed.of_links(edges).select("src", "dst", (4 - F.col("src_k") - F.col("dst_k") + 3 * F.col("t")).alias("forman"))


def lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = with_ends(edges, nodes, "lon", "lat")
    return e.withColumn("length", haversine(F.col("src_lon"), F.col("src_lat"), F.col("dst_lon"), F.col("dst_lat"), RADIUS_KM)).drop("src_lon", "src_lat", "dst_lon", "dst_lat")


def edges_threshold(edges: DataFrame, attr: str, limit: float, upper: bool = True) -> DataFrame:
    return edges.filter(F.col(attr) >= limit if upper else F.col(attr) <= limit)


def edges_quantile(edges: DataFrame, attr: str, q: float) -> DataFrame:
    """Below one half the edges at or under the quantile, else those at or over it."""
    limit = edges.agg(F.expr(f"percentile({attr}, {q})").alias("__limit"))
    test = F.col(attr) <= F.col("__limit") if q < 0.5 else F.col(attr) >= F.col("__limit")
    return edges.join(F.broadcast(limit), test).drop("__limit")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return undirected(a).intersect(undirected(b))


def among(edges: DataFrame, given: DataFrame) -> DataFrame:
    """The edges whose pair is in a given list, either way round, with all their columns."""
    pair = undirected(given).select(F.col("src").alias("__a"), F.col("dst").alias("__b"))
    return edges.join(pair, (F.least("src", "dst") == F.col("__a")) & (F.greatest("src", "dst") == F.col("__b")), "left_semi")


def oriented(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each pair once, from the smaller longitude to the larger, with coordinates."""
    return oriented_pairs(nodes, undirected(edges))


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    n = ids.select(F.col("node").alias("n"))
    return edges.join(n, F.col("src") == F.col("n"), "left_semi").union(edges.join(n, F.col("dst") == F.col("n"), "left_semi")).distinct()


def out_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(spread(ids.select(F.col("node").alias("src"))), "src", "left_semi")


def between(edges: DataFrame, ids1: DataFrame, ids2: DataFrame) -> DataFrame:
    return out_edges(edges, ids1).join(spread(ids2.select(F.col("node").alias("dst"))), "dst", "left_semi")


def endpoint_counts(edges: DataFrame, binary: bool = False) -> DataFrame:
    c = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("n", F.lit(1).cast("long")) if binary else c


def target_counts(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return _counts(out_edges(edges, ids), "dst", "n")


class RegionLinks(NamedTuple):
    """Edges from a region, its nodes, the nodes that the edges lead to, and how many ends of the edges each node is."""

    edges: DataFrame
    sources: DataFrame
    targets: DataFrame
    counts: DataFrame


def region_links(nodes: DataFrame, edges: DataFrame, lons: tuple[float, float], lats: tuple[float, float], attr: str | None = None, q: float | None = None, dateline: bool = False, binary: bool = False) -> RegionLinks:
    """All that leaves a box; with an attribute and a quantile, of the edges that lie in that quantile of the whole network."""
    ids = nodes.filter(in_box(F.col("lon"), F.col("lat"), lons, lats, dateline)).select("node")
    own = out_edges(edges if attr is None or q is None else edges_quantile(edges, attr, q), ids)
    return RegionLinks(own, ids, own.select(F.col("dst").alias("node")).distinct(), endpoint_counts(own, binary))


def between_regions(edges: DataFrame, r1: DataFrame, r2: DataFrame) -> DataFrame:
    return intersect(out_edges(edges, r1), out_edges(edges, r2))


def lookup(edges: DataFrame, wanted: DataFrame, attr: str) -> DataFrame:
    """Attribute of (u, v), else of (v, u)."""
    fwd = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col(attr).alias("x"))
    rev = edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), F.col(attr).alias("y"))
    return wanted.join(fwd, ["u", "v"], "left").join(rev, ["u", "v"], "left").select("u", "v", F.coalesce("x", "y").alias(attr))


def normalised(edges: DataFrame, attr: str) -> DataFrame:
    """Attribute scaled to [-1, 1]."""
    m = edges.agg(F.min(attr).alias("__a"), F.max(attr).alias("__b"))
    return edges.join(F.broadcast(m), F.lit(True)).withColumn("norm", F.try_divide(2 * (F.col(attr) - F.col("__a")), F.col("__b") - F.col("__a")) - 1).drop("__a", "__b")


def ranked(edges: DataFrame, attr: str) -> DataFrame:
    """Average rank over the number of edges. Ranks come from counts per distinct value, so the window runs over values, not edges."""
    per = settle(edges.groupBy(attr).agg(F.count(F.lit(1)).alias("c")))
    below = per.withColumn("b", F.coalesce(F.sum("c").over(Window.orderBy(attr).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = per.agg(F.sum("c").alias("n"))
    rank = below.join(F.broadcast(total), F.lit(True)).select(attr, ((F.col("b") + (F.col("c") + 1) / 2) / F.col("n")).alias("rank"))
    return edges.join(spread(rank), attr)


def node_from_edges(nodes: DataFrame, edges: DataFrame, attr: str, mean: bool = True) -> DataFrame:
    agg = (F.avg if mean else F.sum)(attr).alias(attr)
    return nodes.select("node").join(edges.groupBy(F.col("src").alias("node")).agg(agg), "node", "left")


def node_quantile(nodes: DataFrame, edges: DataFrame, attr: str, q: float) -> DataFrame:
    """Mean of a node's out-edge values beyond the quantile of all."""
    return node_from_edges(nodes, edges_quantile(edges, attr, q), attr)


def fill_quantile(values: DataFrame, attr: str, q: float = 0.5) -> DataFrame:
    m = values.agg(F.expr(f"percentile({attr}, {q})").alias("__m"))
    return values.join(F.broadcast(m), F.lit(True)).withColumn(attr, F.coalesce(attr, "__m")).drop("__m")


def kde(nodes: DataFrame, edges: DataFrame, bandwidth: float) -> DataFrame:
    """(src, node, density): Gaussian great-circle kernel over the targets of each source, at every node that it links to. Sources are dealt in blocks; a source's targets meet in NumPy, strip by strip, so
    their pairs are never rows."""
    pts = nodes.select(F.col("node").alias("dst"), "lon", "lat")
    t = edges.select("src", "dst").join(pts, "dst")

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        lon, lat = np.radians(pdf["lon"].to_numpy(float)), np.radians(pdf["lat"].to_numpy(float))
        out = np.empty(len(pdf))
        for at in range(0, len(pdf), 1024):
            p = slice(at, at + 1024)
            h = np.sin((lat[None] - lat[p, None]) / 2) ** 2 + np.cos(lat[p, None]) * np.cos(lat[None]) * np.sin((lon[None] - lon[p, None]) / 2) ** 2
            out[p] = np.exp(-((2 * np.arcsin(np.sqrt(np.minimum(1.0, h))) / bandwidth) ** 2) / 2).mean(1)
        return pd.DataFrame({"src": pdf["src"], "node": pdf["dst"], "density": out})

    return t.groupBy("src").applyInPandas(sums, "src int, node int, density double")


def link_bundles(nodes: DataFrame, edges: DataFrame, null: DataFrame, bandwidth: float) -> DataFrame:
    """Edges whose density at the target exceeds the null model's limit (k, node, limit) for the source's number of links; sources of fewer than two links lose all."""
    k = edges.groupBy("src").agg(F.count(F.lit(1)).alias("k")).filter("k >= 2")
    dense = kde(nodes, edges, bandwidth).withColumnRenamed("node", "dst")
    return edges.join(k, "src").join(dense, ["src", "dst"]).join(null.withColumnRenamed("node", "dst"), ["k", "dst"]).filter("density > limit").select(*edges.columns)


def link_null(nodes: DataFrame, counts: DataFrame, bandwidth: float, draws: int, q: float = 0.999, seed: int = 0, block: int = 50) -> DataFrame:
    """(k, node, limit): per link count k of at least 2, the quantile at each node of the density of k places whose longitude and latitude are drawn apart from the nodes' own.

    Each of the draws is a sequence of places, and k links are its first k, so every k has as many independent draws. A task holds the densities at one block of nodes as running
    sums over its draws and gives limits only. Nodes and link counts, bounded by the grid, go to every task."""
    pts = nodes.select("node", "lon", "lat").orderBy("node").toPandas()
    wanted = {r[0] for r in counts.filter("k >= 2").select(F.col("k").cast("long")).distinct().collect()}
    held = nodes.sparkSession.sparkContext.broadcast((pts["node"].to_numpy(), np.radians(pts["lon"].to_numpy(float)), np.radians(pts["lat"].to_numpy(float)), wanted))

    def limits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, lon, lat, ks = held.value
        for first in (int(x) for b in batches for x in b["id"]):
            at = slice(first, first + block)
            # Haversines of places and nodes are sums of a part by latitude and a part by longitude.
            by_lat, by_lon = np.sin((lat[:, None] - lat[at]) / 2) ** 2, np.sin((lon[:, None] - lon[at]) / 2) ** 2
            scale, total, rng = np.cos(lat)[:, None] * np.cos(lat[at]), np.zeros((draws, len(node[at]))), np.random.RandomState(seed)
            for k in range(1, max(ks, default=0) + 1):
                n1, n2 = rng.randint(len(node), size=(2, draws))
                half = np.arcsin(np.sqrt(np.minimum(1.0, by_lat[n2] + scale[n2] * by_lon[n1])))
                total += np.exp(-2 * (half / bandwidth) ** 2)
                if k in ks:
                    yield pd.DataFrame({"k": k, "node": node[at], "limit": np.quantile(total, q, axis=0) / k})

    starts = nodes.sparkSession.range(0, len(pts), block, -(-len(pts) // block) or 1)
    return starts.mapInPandas(limits, "k long, node int, limit double")
