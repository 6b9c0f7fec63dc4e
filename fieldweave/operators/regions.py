"""Regions as a column: boxes with month windows, all regions at once.

A region is a row (region, lon0, lon1, lat0, lat1, month0, month1). A box with lon0 > lon1 goes over the date line, a window with month0 > month1 over the year's end; such a window's months after the end belong
to the year in which it began."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sphere import without_outliers

#: Degrees of the cells by which points find the boxes that may hold them.
CELL = 10
COLUMNS = "region string, lon0 double, lon1 double, lat0 double, lat1 double, month0 int, month1 int"


def members(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, node) of the points in each box, its border included: an equi-join on cells, as a box covers few."""
    lat = F.sequence(F.floor(F.col("lat0") / CELL), F.floor(F.col("lat1") / CELL))
    across = F.col("lon0") > F.col("lon1")
    low, high = F.floor(F.col("lon0") / CELL), F.floor(F.col("lon1") / CELL)
    lon = F.when(across, F.array_union(F.sequence(low, F.lit(180 // CELL)), F.sequence(F.lit(-180 // CELL), high))).otherwise(F.sequence(F.least(low, high), high))
    boxes = regions.withColumn("cy", F.explode(lat)).withColumn("cx", F.explode(lon))
    p = points.select("node", "lon", "lat").withColumn("cy", F.floor(F.col("lat") / CELL)).withColumn("cx", F.floor(F.col("lon") / CELL))
    x, y = F.col("lon"), F.col("lat")
    inside = y.between(F.col("lat0"), F.col("lat1")) & F.when(across, (x >= F.col("lon0")) | (x <= F.col("lon1"))).otherwise(x.between(F.col("lon0"), F.col("lon1")))
    return p.join(boxes, ["cy", "cx"]).filter(inside).select("region", "node").distinct()


def probability(runs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(region, node, mean, std) over runs (run, node, grp) of whether a node is in the group that most of the region's seeds (region, node) are in, the smallest of equals; all regions in one pass."""
    votes = runs.join(seeds.select("region", "node").distinct(), "node").groupBy("region", "run", "grp").agg(F.count(F.lit(1)).alias("n"))
    main = votes.groupBy("region", "run").agg(F.min(F.struct(-F.col("n"), F.col("grp").alias("grp"))).alias("x")).select("region", "run", F.col("x.grp").alias("grp"))
    share = runs.join(main, ["run", "grp"]).groupBy("region", "node").agg(F.count(F.lit(1)).alias("hits"))
    n = main.groupBy("region").agg(F.count(F.lit(1)).alias("runs"))
    p = share.join(F.broadcast(n), "region").withColumn("mean", F.col("hits") / F.col("runs"))
    # A hit is 0 or 1, so its deviation follows from the mean; nodes without a hit are 0 in both and not listed.
    return p.select("region", "node", F.round("mean", 9).alias("mean"), F.round(F.sqrt(F.col("mean") * (1 - F.col("mean"))), 9).alias("std"))


def sure_members(prob: DataFrame, over: float = 0.95, inside: DataFrame | None = None) -> DataFrame:
    """(region, node) of the nodes whose probability is over the limit, of those in the region's box if members are given."""
    sure = prob.filter(F.col("mean") > over).select("region", "node")
    return sure if inside is None else sure.join(inside.select("region", "node"), ["region", "node"], "left_semi")


def dense_members(points: DataFrame, found: DataFrame, width: float) -> DataFrame:
    """(region, node) without outliers: of each region the nodes where its own density exceeds its mean over all points. Regions are few, and each is a search of its own."""
    out = None
    for (name,) in found.select("region").distinct().orderBy("region").collect():
        own = found.filter(F.col("region").eqNullSafe(name))
        part = without_outliers(points, own, width).select(F.lit(name).alias("region"), "node")
        out = part if out is None else out.union(part)
    return found.filter("false") if out is None else out


def season(t: Column, month0: Column, month1: Column) -> Column:
    """The year in which the window that holds t began; null outside of the window."""
    m, y = F.month(t), F.year(t)
    straight = F.when(m.between(month0, month1), y)
    wrapped = F.when(m >= month0, y).when(m <= month1, y - 1)
    return F.when(month0 <= month1, straight).otherwise(wrapped)


def series(field: DataFrame, found: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, season, t, v, an, nodes): a region's mean over its nodes at the times of its window, and that less its mean over the same month of all years."""
    own = field.join(found.select("region", "node").distinct(), "node").groupBy("region", "t").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("nodes"))
    x = own.join(F.broadcast(regions.select("region", "month0", "month1")), "region").withColumn("season", season(F.col("t"), F.col("month0"), F.col("month1"))).filter("season IS NOT NULL")
    climate = x.groupBy("region", F.month("t").alias("m")).agg(F.avg("v").alias("c"))
    return x.withColumn("m", F.month("t")).join(climate, ["region", "m"]).select("region", "season", "t", "v", (F.col("v") - F.col("c")).alias("an"), "nodes")


def by_year(found_series: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """(region, season, total, mean, spread, an, times) per window; with years given, all of them, empty ones with nulls."""
    per = found_series.groupBy("region", "season").agg(F.sum("v").alias("total"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread"), F.avg("an").alias("an"), F.count(F.lit(1)).alias("times"))
    if first is None or last is None:
        return per
    grid = found_series.select("region").distinct().withColumn("season", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return grid.join(per, ["region", "season"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def table(points: DataFrame, runs: DataFrame, field: DataFrame, regions: DataFrame, over: float = 0.95, only_inside: bool = False, width: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Members and series of all regions: seeds are the points of the boxes; width removes outliers."""
    inside = members(points, regions)
    found = sure_members(probability(runs, inside), over, inside if only_inside else None)
    found = found if width is None else dense_members(points, found, width)
    return found, series(field, found, regions)
