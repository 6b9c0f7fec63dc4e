"""Places and attributes of a network: links of a place, long links, values in a box, maps and series of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import closed
from .graph import degrees, edges_quantile, lengths, lookup, out_edges, undirected
from .grid import cut, nearest


def strict_box(points: DataFrame, lons: tuple[float, float], lats: tuple[float, float]) -> DataFrame:
    """Points inside the box, its border left out; bounds may come in any order."""
    inside = lambda c, r: (F.col(c) > min(r)) & (F.col(c) < max(r))
    return points.filter(inside("lon", lons) & inside("lat", lats))


def renumbered(points: DataFrame) -> DataFrame:
    """(node, old, ...): numbers 0 to n - 1 in the old order, as after a cut. The window runs over a grid's points, which are bounded."""
    return points.withColumnRenamed("node", "old").withColumn("node", (F.row_number().over(Window.orderBy("old")) - 1).cast("int"))


def values_in_box(nodes: DataFrame, values: DataFrame, attr: str, lons: tuple[float, float], lats: tuple[float, float], more_than: float | None = None, dateline: bool = False) -> DataFrame:
    """(node, lon, lat, attr) of the points of a box, those with a value over the limit if there is one."""
    found = cut(nodes.select("node", "lon", "lat"), lons, lats, dateline).join(values.select("node", attr), "node")
    return found if more_than is None else found.filter(F.col(attr) > more_than)


def targets_at(nodes: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """(q, src, dst): links of the node nearest to each place (q, qlon, qlat)."""
    return nearest(nodes, places).withColumnRenamed("node", "src").join(edges.select("src", "dst"), "src").select("q", "src", "dst")


def linked_to_any(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, linked): whether any of the ids links to the node."""
    hit = out_edges(edges, ids).select(F.col("dst").alias("node")).distinct().withColumn("linked", F.lit(True))
    return nodes.select("node").join(hit, "node", "left").fillna(False)


def long_links(nodes: DataFrame, edges: DataFrame, at_least_km: float, attr: str | None = None, q: float | None = None) -> DataFrame:
    """Edges of a length and over, of those beyond the attribute's quantile if one is given; with their length."""
    some = edges if q is None else edges_quantile(edges, attr or "weight", q)
    return lengths(nodes, some).filter(F.col("length") >= at_least_km)


def count_map(nodes: DataFrame, counts: DataFrame, name: str = "n") -> DataFrame:
    """(node, count), zero where there is none."""
    return nodes.select("node").join(counts.select("node", name), "node", "left").fillna(0, [name])


def node_sums(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, attr: str, normalise: bool = True) -> DataFrame:
    """(node, attr) of all nodes that wanted edges (u, v) touch: the sum of the attribute of the wanted edges that end there (that of the edge, or else of its reverse), over the node's degree
    in the whole network; 0 for nodes at which none ends."""
    return sums_of(nodes, edges, lookup(edges, wanted.select("u", "v"), attr), attr, normalise)


def sums_of(nodes: DataFrame, edges: DataFrame, found: DataFrame, attr: str, normalise: bool = True) -> DataFrame:
    """node_sums() of wanted edges that have been looked up (u, v, attr)."""
    sums = found.groupBy(F.col("v").alias("node")).agg(F.sum(attr).alias("__sum"))
    ends = found.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    found = ends.join(sums, "node", "left").join(degrees(nodes, edges).select("node", "degree"), "node", "left").withColumn("__sum", F.coalesce("__sum", F.lit(0.0)))
    return found.select("node", (F.try_divide(F.col("__sum"), F.col("degree")) if normalise else F.col("__sum")).alias(attr))


def transitivity(edges: DataFrame) -> DataFrame:
    """Three times the triangles over the connected triples of the undirected graph."""
    found = closed.of_nodes(edges).agg(F.sum("triangles").alias("t"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("w"))
    return found.select(F.round(F.coalesce(F.try_divide("t", "w"), F.lit(0.0)), 9).alias("transitivity"))


def info(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, directed (some edge lacks its reverse), weighted (weights are not all 1), mean_degree (edges at a node)."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.bool_or(F.col("weight") != 1), F.lit(False)).alias("weighted"))
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    lone = edges.join(back, ["src", "dst"], "left_anti").agg((F.count(F.lit(1)) > 0).alias("directed"))
    return n.join(F.broadcast(e)).join(F.broadcast(lone)).select("nodes", "edges", "directed", "weighted", F.round(F.try_divide(2.0 * F.col("edges"), F.col("nodes")), 9).alias("mean_degree"))


def info_of_pairs(nodes: DataFrame, p: DataFrame) -> DataFrame:
    """info() of graph.pairs(), in one pass."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    either = lambda of: F.coalesce(F.bool_or(of("there") | of("back")), F.lit(False))
    e = p.agg((F.count("there") + F.count("back")).alias("edges"), either(lambda x: F.col(x).isNull()).alias("directed"), either(lambda x: F.coalesce(F.col(f"{x}.weight") != 1, F.lit(False))).alias("weighted"))
    return n.join(F.broadcast(e)).select("nodes", "edges", "directed", "weighted", F.round(F.try_divide(2.0 * F.col("edges"), F.col("nodes")), 9).alias("mean_degree"))


def link_density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected edges over n (n - 1) / 2."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    return undirected(edges).agg(F.count(F.lit(1)).alias("e")).join(F.broadcast(n)).select(F.round(F.try_divide(2.0 * F.col("e"), F.col("n") * (F.col("n") - 1)), 9).alias("density"))


def region_series(field: DataFrame, ids: DataFrame) -> DataFrame:
    """(t, v): mean over the region's nodes."""
    return field.join(ids.select("node").distinct(), "node", "left_semi").groupBy("t").agg(F.avg("v").alias("v"))


def yearly_series(field: DataFrame, ids: DataFrame, first: int, last: int) -> DataFrame:
    """(y, total, mean, spread) of the region's values per year of the range; years without values are there with nulls."""
    years = field.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("y"))
    v = field.join(ids.select("node").distinct(), "node", "left_semi").groupBy(F.year("t").alias("y"))
    return years.join(v.agg(F.sum("v").alias("total"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread")), "y", "left")


def day_counts(times: DataFrame, col: str = "t") -> DataFrame:
    """(m, d, n): how many times fall on each day of each month."""
    return times.groupBy(F.month(col).alias("m"), F.dayofmonth(col).alias("d")).agg(F.count(F.lit(1)).alias("n"))
