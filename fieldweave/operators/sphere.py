"""Nearest points by cells, and densities over them: no pair of distant points ever meets.

Points go into cubes of a grid in space (the sphere's points as unit vectors, so that poles and the date line are nothing special) or squares of a plane of degrees. A query meets the points of its cell and
the cells around it, and what is found within one cell's width is certain; queries whose k-th point lies further (or that found fewer) go on with cells twice as wide, until a cell spans everything."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import haversine, to_xyz
from .lineage import drop, settle

#: Points that a point should find in its own cell at most, on average, where searching begins.
CROWD = 8
#: For densities: points of a cell on average at least, points that a task has at most, about, and pairs that it holds at once.
CELL_POINTS, PART_POINTS, PAIRS = 256, 8192, 1_000_000

Coordinates = Callable[[Column, Column], tuple[Column, ...]]


def _space(lon: Column, lat: Column) -> tuple[Column, ...]:
    return to_xyz(lon, lat)


def _plane(lon: Column, lat: Column) -> tuple[Column, ...]:
    return lon, lat


def _cells(df: DataFrame, at: tuple[str, ...], step: float) -> DataFrame:
    return df.withColumns({f"c{i}": F.floor(F.col(c) / step) for i, c in enumerate(at)})


def _around(df: DataFrame, at: tuple[str, ...], step: float) -> DataFrame:
    """Each row once for every cell around its own."""
    out = _cells(df, at, step)
    for i in range(len(at)):
        out = out.withColumn(f"c{i}", F.explode(F.array(*(F.col(f"c{i}") + k for k in (-1, 0, 1)))))
    return out


def _placed(df: DataFrame, lon: str, lat: str, coordinates: Coordinates, prefix: str) -> tuple[DataFrame, tuple[str, ...]]:
    own = coordinates(F.col(lon), F.col(lat))
    names = tuple(f"{prefix}{i}" for i in range(len(own)))
    return df.withColumns(dict(zip(names, own, strict=True))), names


def first_step(placed: DataFrame, at: tuple[str, ...], widest: float, crowd: float = CROWD) -> float:
    """A cell width at which points share their cells with few others: halved from the widest until they do. Crowds are measured, so points may lie unevenly."""
    step = widest
    for _ in range(40):
        near = _cells(placed, at, step).groupBy(*(f"c{i}" for i in range(len(at)))).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
        if near is None or near <= crowd:
            break
        # Where points spread evenly over a surface, half the width leaves a quarter of the crowd.
        step /= 2 ** max(1, int(math.log(near / crowd, 4)))
    return step


def k_nearest(points: DataFrame, queries: DataFrame, k: int = 1, degrees: bool = False, others: bool = False) -> DataFrame:
    """(q, node, d, rank): the k nearest points (node, lon, lat) of each query (q, qlon, qlat), by great circles in radians or, with `degrees`, by squared distance in the plane of longitudes and
    latitudes (9 places). Equal distances (12 places) go to the smaller node. others: points whose node is q do not count. Queries with fewer than k points have all of them."""
    coordinates, widest = (_plane, 360.0) if degrees else (_space, 2.0)
    p, names = _placed(points.select("node", "lon", "lat"), "lon", "lat", coordinates, "p")
    q, qnames = _placed(queries.select("q", "qlon", "qlat"), "qlon", "qlat", coordinates, "x")
    p, left = settle(p), settle(q)
    if degrees:
        d = F.round(F.pow(F.col("qlon") - F.col("lon"), 2) + F.pow(F.col("qlat") - F.col("lat"), 2), 9)
        reach = lambda step: step * step * (1 - 1e-9)
    else:
        d = F.round(haversine(F.col("qlon"), F.col("qlat"), F.col("lon"), F.col("lat")), 12)
        reach = lambda step: 2 * math.asin(min(1.0, step / 2)) * (1 - 1e-9)
    cells, step, out = [f"c{i}" for i in range(len(names))], first_step(p, names, widest), None
    keep, used = [], [p, left]
    w = Window.partitionBy("q").orderBy("d", "node")
    while True:
        met = _around(left, qnames, step).join(_cells(p, names, step).select("node", "lon", "lat", *cells), cells)
        met = met.filter(F.col("node") != F.col("q")) if others else met
        best = settle(met.select("q", "node", d.alias("d")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
        used.append(best)
        if step >= widest:
            keep.append(best)
            break
        sure = settle(best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")).filter((F.col("n") == k) & (F.col("far") <= reach(step))).select("q"))
        keep.append(best.join(sure, "q", "left_semi"))
        rest = settle(left.join(sure, "q", "left_anti"))
        used += [sure, rest]
        if rest.isEmpty():
            break
        left, step = rest, min(2 * step, widest)
    for part in keep:
        out = part if out is None else out.unionByName(part)
    done = settle(out)
    drop(*used)
    return done


def within(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """(q, node, d, and the other columns of both): all points within a great circle of `radius` radians, below pi, of each query."""
    step = 2 * math.sin(min(radius, math.pi) / 2) * (1 + 1e-9)
    p, names = _placed(points, "lon", "lat", _space, "p")
    x, qnames = _placed(queries, "qlon", "qlat", _space, "x")
    cells = [f"c{i}" for i in range(3)]
    met = _around(x, qnames, step).join(_cells(p, names, step), cells)
    return met.withColumn("d", haversine(F.col("qlon"), F.col("qlat"), F.col("lon"), F.col("lat"))).filter(F.col("d") <= radius).drop(*names, *qnames, *cells)


def bandwidth(points: DataFrame, neighbours: int = 1) -> float:
    """Kernel width of a grid, in radians: so many times the largest distance of a point to its nearest other."""
    q = points.select(F.col("node").alias("q"), F.col("lon").alias("qlon"), F.col("lat").alias("qlat"))
    return neighbours * (k_nearest(points, q, others=True).agg(F.max("d")).first()[0] or 0.0)


def _kernel(p: np.ndarray, q: np.ndarray, width: float, radius: float) -> np.ndarray:
    """The kernel between unit vectors p and q; 0 where the arc is over the radius."""
    h = np.zeros((len(p), len(q)))
    for k in range(3):
        d = p[:, k][:, None] - q[:, k]
        h += np.multiply(d, d, out=d)
    h = np.minimum(1.0, np.divide(h, 4, out=h), out=h)
    far = h > math.sin(radius / 2) ** 2
    x = np.arcsin(np.sqrt(h, out=h), out=h)
    x = np.exp(np.multiply(np.multiply(x, x, out=x), -2 / width**2, out=x), out=x)
    x[far] = 0
    return x


def _summed(points: DataFrame, sources: DataFrame, width: float, radius: float) -> DataFrame:
    """(node, set, x > 0): at the points (node, lon, lat), the sums of each set's weights under a Gaussian kernel that ends at the radius. sources: (lon, lat, sets array<int>, weights array<double>), a row a place.

    Pairs of points are never rows: a task gets some points of a cell and the sources of the cells around it, and puts out sums. Crowded cells are dealt in parts."""
    there = "lon IS NOT NULL AND lat IS NOT NULL"
    p, names = _placed(points.select("node", "lon", "lat").filter(there), "lon", "lat", _space, "p")
    w, wnames = _placed(sources.filter(there), "lon", "lat", _space, "p")
    p, w, cells = settle(p.select("node", *names)), settle(w.select("sets", "weights", *wnames)), [f"c{i}" for i in range(3)]
    # No narrower than the radius, and with some points to a cell.
    step = max(2 * math.sin(radius / 2) * (1 + 1e-9), math.sqrt(4 * math.pi * CELL_POINTS / max(1, p.count())))
    crowd = _cells(p, names, step).groupBy(*cells).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-crowd // PART_POINTS))
    ends = math.floor(-1 / step) - 1, math.floor(1 / step) + 1
    x = _cells(p, names, step).withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)))
    y = _around(w, wnames, step).filter(" AND ".join(f"{c} BETWEEN {ends[0]} AND {ends[1]}" for c in cells)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            place = np.repeat(np.arange(len(b)), b["sets"].map(len).to_numpy())
            of, weight = np.concatenate(b["sets"].to_list()), np.concatenate(b["weights"].to_list())
            order = np.argsort(of, kind="stable")
            of, place, weight = of[order], place[order], weight[order]
            start = np.flatnonzero(np.concatenate((np.ones(1, bool), of[1:] != of[:-1])))
            p, q, node = a[[*names]].to_numpy(), b[[*wnames]].to_numpy(), a["node"].to_numpy()
            for at in range(0, len(a), step := max(1, PAIRS // len(of))):
                k = _kernel(p[at : at + step], q, width, radius)
                total = (k[:, place] * weight) @ np.ones((len(of), 1)) if len(start) == 1 else np.add.reduceat(k[:, place] * weight, start, axis=1)
                i, j = np.nonzero(total)
                out.append(pd.DataFrame({"node": node[at : at + step][i], "set": of[start][j], "x": total[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"node": a["node"][:0], "set": np.zeros(0, np.int32), "x": np.zeros(0)})

    return x.groupBy(*cells, "part").cogroup(y.groupBy(*cells, "part")).applyInPandas(sums, f"node {dict(p.dtypes)['node']}, set int, x double")


def density(points: DataFrame, weights: DataFrame, width: float, cut: float = 6.0) -> DataFrame:
    """(node, density) at every point: the sum of weights (node, weight) under a Gaussian kernel of great circles, over the sum of all weights. The kernel ends at `cut` widths, where it is below 2e-8 of
    its peak at the default, so a weight reaches the points around it alone."""
    own = points.select("node", "lon", "lat").join(weights.filter("weight <> 0").select("node", "weight"), "node")
    sources = own.select("lon", "lat", F.array(F.lit(0)).alias("sets"), F.array(F.col("weight").cast("double")).alias("weights"))
    total = weights.agg(F.sum("weight").alias("__total"))
    found = _summed(points, sources, width, min(cut * width, math.pi)).select("node", "x")
    return points.select("node").join(found, "node", "left").join(F.broadcast(total)).select("node", F.coalesce(F.try_divide(F.col("x"), F.col("__total")), F.lit(0.0)).alias("density"))


def without_outliers(points: DataFrame, region: DataFrame, width: float, cut: float = 6.0) -> DataFrame:
    """(node, density): the region's nodes that lie where the density of the region exceeds its mean over all points; lone nodes away from the rest fall out."""
    dense = settle(density(points, region.select("node", F.lit(1.0).alias("weight")).distinct(), width, cut))
    mean = dense.agg(F.avg("density").alias("__mean"))
    return dense.join(region.select("node").distinct(), "node", "left_semi").join(F.broadcast(mean)).filter(F.col("density") > F.col("__mean")).select("node", "density")


def densities(points: DataFrame, members: DataFrame, keys: list[str], width: float, cut: float = 6.0) -> DataFrame:
    """(keys, node, density) of many sets of nodes (keys, node) at every point that has one of them within reach, each over its own greatest value. The kernel of two points is found once for all sets."""
    members = members.select(*keys, "node").distinct()
    sets = settle(members.select(*keys).distinct().withColumn("__set", (F.row_number().over(Window.orderBy(*keys)) - 1).cast("int")))  # a row a set
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    named = members.join(sets.withColumnsRenamed({k: f"__{k}" for k in keys}), same).select("node", "__set")
    of = named.groupBy("node").agg(F.collect_list("__set").alias("sets")).withColumn("weights", F.transform("sets", lambda _: F.lit(1.0)))
    found = _summed(points, points.select("node", "lon", "lat").join(of, "node"), width, min(cut * width, math.pi))
    sums = settle(found.withColumnsRenamed({"set": "__set", "x": "__x"}))
    top = sums.groupBy("__set").agg(F.max("__x").alias("__top")).join(sets, "__set")
    return sums.join(top, "__set").select(*keys, "node", (F.col("__x") / F.col("__top")).alias("density"))
