"""Grids on the sphere and nearest points."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine, in_box, to_lon_lat, to_xyz
from . import sphere
from .lineage import settle


def gaussian(spark: SparkSession, step: float) -> DataFrame:
    """Regular mesh, latitude-major."""
    n_lat, n_lon = int(-(-180 // step)), int(-(-360 // step))
    return spark.range(n_lat * n_lon).select(F.col("id").cast("int").alias("node"), (F.lit(-179.5) + (F.col("id") % n_lon) * step).alias("lon"), (F.lit(-89.5) + F.floor(F.col("id") / n_lon) * step).alias("lat")).filter("lat <= 90 AND lon < 180")


def cut(points: DataFrame, lons: tuple[float, float], lats: tuple[float, float], dateline: bool = False) -> DataFrame:
    if lons[0] > lons[1] and not dateline:
        raise ValueError("longitudes run the wrong way; say dateline=True to cross it")
    return points.filter(in_box(F.col("lon"), F.col("lat"), lons, lats, dateline))


def distances(points: DataFrame) -> DataFrame:
    """(a, b, d): great circles between all ordered pairs of points, radians. Grids are bounded; one side is spread, the other is each task's."""
    a = points.select(F.col("node").alias("a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"))
    b = points.select(F.col("node").alias("b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"))
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", haversine(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b")).alias("d"))


def _as_queries(points: DataFrame) -> DataFrame:
    return points.select(F.col("node").alias("q"), F.col("lon").alias("qlon"), F.col("lat").alias("qlat"))


def min_dists(points: DataFrame, radius: float = 6371.009, onto: DataFrame | None = None) -> DataFrame:
    """(node, d): km to the nearest point of another grid, or to the nearest other point of the same."""
    near = sphere.k_nearest(points if onto is None else onto, _as_queries(points), others=onto is None)
    return near.select(F.col("q").alias("node"), (F.col("d") * radius).alias("d"))


def nearest(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, node): the nearest point of each query (q, qlon, qlat); ties go to the smaller node."""
    return sphere.k_nearest(points, queries).select("q", "node")


def k_nearest(points: DataFrame, k: int) -> DataFrame:
    """(a, b, d, rank): the k nearest others of each point, in radians."""
    return sphere.k_nearest(points, _as_queries(points), k, others=True).select(F.col("q").alias("a"), F.col("node").alias("b"), "d", "rank")


def neighbour_distance(points: DataFrame, radius: float = 6371.0) -> DataFrame:
    """(node, d): km to the nearest other point."""
    return min_dists(points, radius)


def regrid_map(source: DataFrame, target: DataFrame) -> DataFrame:
    """(node, from): for each target point the nearest source point in degrees of longitude and latitude, the smaller number of equals. Found once, used for all times."""
    return sphere.k_nearest(source, _as_queries(target), degrees=True).select(F.col("q").alias("node"), F.col("node").alias("from"))


def regrid(field: DataFrame, where: DataFrame) -> DataFrame:
    """(node, t, v) on the target points, by a table of regrid_map."""
    return where.join(field.select(F.col("node").alias("from"), "t", "v"), "from").select("node", "t", "v")


def masked(field: DataFrame, mask: DataFrame) -> DataFrame:
    """Values where the mask (node, mask) is 1, null elsewhere; land-sea masks and removed points alike."""
    return field.join(mask, "node", "left").withColumn("v", F.when(F.col("mask") == 1, F.col("v"))).drop("mask")


def masked_from(field: DataFrame, points: DataFrame, mesh: DataFrame, mask: DataFrame) -> DataFrame:
    """masked() by a mask (node, mask) on another grid: each point of the field has the mask of the mesh's nearest point."""
    own = regrid_map(mesh, points).join(mask.select(F.col("node").alias("from"), "mask"), "from").select("node", "mask")
    return masked(field, own)


def force_directions(x: np.ndarray, rows: int = 512) -> np.ndarray:
    """The part of each point's repulsion (inverse squares) that is tangent to the sphere, over its size."""
    out = np.empty_like(x)
    for at in range(0, len(x), rows):
        p = x[at : at + rows]
        d = p[:, None, :] - x[None, :, :]
        r = np.sqrt((d * d).sum(-1))
        np.put_along_axis(r, np.arange(at, at + len(p))[:, None], np.inf, 1)
        f = (d / r[..., None] ** 3).sum(1)
        out[at : at + rows] = (f - (f * p).sum(1, keepdims=True) * p) / np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-300)
    return out


def fekete(spark: SparkSession, n: int, rounds: int = 1000, seed: int = 42, stop: float = 1e-3, start: DataFrame | None = None) -> DataFrame:
    """(node, lon, lat): points of least repulsion, by descent along the tangential forces (Bendito et al. 2007) from seeded or given points.

    A step is as long as the least distance times the direction. Grids have thousands of points, so the driver descends; forces are formed in strips of rows."""
    if start is None:
        x = np.random.RandomState(seed).normal(size=(n, 3))
    else:
        x = np.array([[math.cos(math.radians(r.lon)) * math.cos(math.radians(r.lat)), math.sin(math.radians(r.lon)) * math.cos(math.radians(r.lat)), math.sin(math.radians(r.lat))] for r in start.orderBy("node").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for _ in range(rounds if n > 1 else 0):
        w = force_directions(x)
        if np.linalg.norm(w, axis=1).max() <= stop:
            break
        near = 2 - 2 * max(float(np.partition(x[i : i + 512] @ x.T, -2, axis=1)[:, -2].max()) for i in range(0, n, 512))
        x += math.sqrt(max(near, 0.0)) * w
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    lon, lat = np.degrees(np.arctan2(x[:, 1], x[:, 0])), np.degrees(np.arcsin(np.clip(x[:, 2], -1, 1)))
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat, strict=True))], "node int, lon double, lat double")


def snap(points: DataFrame, step: float, rounds: int = 50) -> DataFrame:
    """(node, lon, lat): points moved to corners of the regular mesh around them, one point a corner and the shortest moves first; points left without a corner are dropped.

    Each round takes the pairs that are each other's shortest, which is what taking pairs one by one in order of length would take."""
    lo, la = F.floor((F.col("lon") + 179.5) / step), F.floor((F.col("lat") + 89.5) / step)
    corners = F.explode(F.array(*(F.struct((lo + i).alias("i"), (la + j).alias("j")) for i in (0, 1) for j in (0, 1))))
    c = points.select("node", "lon", "lat", corners.alias("c")).select("node", "lon", "lat", (F.col("c.i") * step - 179.5).alias("clon"), (F.col("c.j") * step - 89.5).alias("clat")).filter("clat BETWEEN -90 AND 90")
    c = settle(c.select("node", "clon", "clat", F.round(haversine(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat")), 12).alias("d")))
    taken = None
    for _ in range(rounds):
        best = c.groupBy("node").agg(F.min(F.struct("d", "clon", "clat")).alias("x")).select("node", "x.*")
        pick = best.groupBy("clon", "clat").agg(F.min(F.struct("d", "node")).alias("x")).select(F.col("x.node").alias("node"), "clon", "clat")
        pick = settle(pick)
        taken = pick if taken is None else taken.union(pick)
        c = settle(c.join(pick.select("node"), "node", "left_anti").join(pick.select("clon", "clat"), ["clon", "clat"], "left_anti"))
        if c.isEmpty():
            break
    return taken.select("node", F.col("clon").alias("lon"), F.col("clat").alias("lat"))


def rotated(points: DataFrame, lon: float, tilt: float) -> DataFrame:
    """Points turned by lon degrees about the axis and by tilt degrees about the x axis."""
    x, y, z = to_xyz(F.col("lon") + lon, F.col("lat"))
    c, s = math.cos(math.radians(tilt)), math.sin(math.radians(tilt))
    new_lon, new_lat = to_lon_lat(x, y * c - z * s, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y * s + z * c)))
    return points.withColumns({"lon": new_lon, "lat": new_lat})


def nudged(points: DataFrame, onto: DataFrame, rounds: int = 8, step: float = 0.01, seed: int = 0) -> DataFrame:
    """The grid turned as a whole toward another: seeded small turns are tried, and the one that lowers the mean distance to the nearest point of the other is kept."""
    rng = np.random.RandomState(seed)
    loss = lambda p: sphere.k_nearest(onto, _as_queries(p)).agg(F.avg("d")).first()[0]
    best, now = loss(points), points
    for _ in range(rounds):
        trial = rotated(now, *(math.degrees(float(v)) * step for v in rng.normal(size=2)))
        cost = loss(trial)
        if cost < best:
            best, now = cost, trial
    return now
