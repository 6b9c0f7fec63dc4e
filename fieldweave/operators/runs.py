"""Several runs of grouping compared: where the group of a place lies in each run, level by level, and how far the runs agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sphere import densities, k_nearest


def scott_width(n_nodes: int, n_edges: int, factor: float = 1.0) -> float:
    """Scott's rule in two dimensions, from the mean number of links of a node."""
    return factor * (n_edges / n_nodes) ** (-1 / 6) if n_nodes and n_edges else factor


def nodes_at(points: DataFrame, places: DataFrame) -> DataFrame:
    """(place, node): the node nearest to each place (place, lon, lat)."""
    q = places.select(F.col("place").alias("q"), F.col("lon").alias("qlon"), F.col("lat").alias("qlat"))
    return k_nearest(points.select("node", "lon", "lat"), q).select(F.col("q").alias("place"), "node")


def last_levels(runs: DataFrame, n: int) -> DataFrame:
    """The n highest levels of each run (run, level, node, grp), numbered `up` from 0, the highest, downwards: runs may have unlike numbers of levels."""
    top = runs.groupBy("run").agg(F.max("level").alias("__top"))
    return runs.join(top, "run").withColumn("up", (F.col("__top") - F.col("level")).cast("int")).filter(F.col("up") < n).drop("__top", "level")


def groups_of_places(runs: DataFrame, places: DataFrame) -> DataFrame:
    """(place, run, up, node): the members, in each run and level, of the group that holds the place's node (place, node)."""
    own = runs.join(places.select("place", "node"), "node").select("place", "run", "up", "grp")
    return runs.join(own, ["run", "up", "grp"]).select("place", "run", "up", "node")


def compared(points: DataFrame, runs: DataFrame, places: DataFrame, levels: int, width: float, cut: float = 6.0) -> DataFrame:
    """(place, up, node, mean, std, runs): over runs, the density of the group that holds the place, each run's scaled to a greatest value of 1. std is that of the population; nodes that no run's group
    comes near have no row, and a run whose density is absent at a node counts as 0 there."""
    found = groups_of_places(last_levels(runs, levels), nodes_at(points, places))
    each = densities(points, found, ["place", "run", "up"], width, cut)
    n = found.groupBy("place", "up").agg(F.count_distinct("run").alias("runs"))
    sums = each.groupBy("place", "up", "node").agg(F.sum("density").alias("s"), F.sum(F.col("density") * F.col("density")).alias("s2"))
    mean = F.col("s") / F.col("runs")
    return sums.join(n, ["place", "up"]).select("place", "up", "node", mean.alias("mean"), F.sqrt(F.greatest(F.col("s2") / F.col("runs") - mean * mean, F.lit(0.0))).alias("std"), "runs")


def agreement(runs: DataFrame) -> DataFrame:
    """(up, a, b, nodes, rand): Rand's index of every two runs at each level (run, up, node, grp), the share of pairs of nodes that both put together or both put apart; from counts of shared groups, not pairs."""
    a = runs.select("up", F.col("run").alias("a"), "node", F.col("grp").alias("ga"))
    b = runs.select("up", F.col("run").alias("b"), "node", F.col("grp").alias("gb"))
    both = a.join(b, ["up", "node"]).filter("a < b").groupBy("up", "a", "b", "ga", "gb").agg(F.count(F.lit(1)).alias("n"))
    square = lambda c: F.sum(F.col(c) * F.col(c))
    at = ["up", "a", "b"]
    one = both.groupBy(*at, "ga").agg(F.sum("n").alias("n")).groupBy(*at).agg(square("n").alias("sa"))
    two = both.groupBy(*at, "gb").agg(F.sum("n").alias("n")).groupBy(*at).agg(square("n").alias("sb"))
    joint = both.groupBy(*at).agg(square("n").alias("s"), F.sum("n").alias("nodes"))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return joint.join(one, at).join(two, at).select(*at, "nodes", F.try_divide(pairs + 2 * F.col("s") - F.col("sa") - F.col("sb"), pairs).alias("rand"))
