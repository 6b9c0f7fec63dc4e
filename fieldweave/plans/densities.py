"""Queries of densities on the sphere. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import kernel_width
from ..operators import grid, sphere
from .places import PROB, _places, _sure
from .registry import BASE, hav, points, query, rounded


@query(BASE + f"SELECT 2::INT neighbours, round(2 * max(d), 9) width, round(2 * 2 * asin(sin(radians(5.0) / 2)), 9)::DOUBLE by_step FROM (SELECT min({hav('a', 'b')}) d FROM pts a JOIN pts b ON a.node <> b.node GROUP BY a.node)")
def kde_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel widths of two spacings: the grid's own, and that of a grid of 5 degrees."""
    width = sphere.bandwidth(points(spark, sf_dir), 2)
    return rounded(spark.createDataFrame([(2, width, kernel_width(5.0, 2))], "neighbours int, width double, by_step double"), "width", "by_step", places=9)


KDE = f", dn AS (SELECT p.node, sum(exp(-pow({hav('p', 'q')} / 0.2, 2) / 2)) / (SELECT count(*) FROM sure) density FROM pts p JOIN (SELECT pts.* FROM pts JOIN sure USING (node)) q ON {hav('p', 'q')} <= 1.2 GROUP BY p.node) "


@query(BASE + PROB + KDE + "SELECT p.node::INT node, round(coalesce(density, 0), 9) + 0.0 density FROM pts p LEFT JOIN dn ON dn.node = p.node")
def region_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of a region's nodes at all points."""
    region = _sure(spark, sf_dir).select("node", F.lit(1.0).alias("weight"))
    return rounded(sphere.density(points(spark, sf_dir), region, 0.2), "density", places=9)


@query(BASE + PROB + KDE + ", al AS (SELECT p.node, coalesce(density, 0) density FROM pts p LEFT JOIN dn ON dn.node = p.node) SELECT al.node::INT node, round(density, 9) density FROM al JOIN sure USING (node) WHERE density > (SELECT avg(density) FROM al)")
def region_without_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region's nodes where it is denser than on average."""
    return rounded(sphere.without_outliers(points(spark, sf_dir), _sure(spark, sf_dir), 0.2), "density", places=9)


@query(BASE + f", q AS (SELECT n_nationkey q, -180 + n_nationkey * 14.0 lon, -60 + n_nationkey * 5.0 lat FROM nation) SELECT q, p.node::INT node, round({hav('q', 'p')}, 9) d FROM q, pts p WHERE {hav('q', 'p')} <= 0.3")
def points_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points within a radius of places."""
    return rounded(sphere.within(points(spark, sf_dir), _places(spark, sf_dir), 0.3), "d", places=9).select("q", "node", "d")


@query(BASE + f", k AS (SELECT q.node q, p.node, round({hav('q', 'p')}, 12) d FROM pts q JOIN pts p ON q.node <> p.node), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, node) rank FROM k) SELECT q::INT a, node::INT b, rank::INT rank FROM r WHERE rank <= 4")
def four_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.k_nearest(points(spark, sf_dir), 4).select("a", "b", "rank")


@query(BASE + f", gg AS (SELECT i node, -179.5 + (i % 24) * 15.0 lon, -89.5 + (i // 24) * 15.0 lat FROM range(288) r(i)) SELECT a.node::INT node, round(min({hav('a', 'b', '6371.009')}), 4) d FROM pts a, gg b GROUP BY a.node")
def dists_to_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the points of one grid to the nearest of another."""
    return rounded(grid.min_dists(points(spark, sf_dir), onto=grid.gaussian(spark, 15.0)), "d", places=4)
