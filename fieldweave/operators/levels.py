"""Levels of groups: which nodes and groups are in which group above, and back. Levels count from 0; group numbers of a level run from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .community import dense_levels


def members(levels: DataFrame) -> DataFrame:
    """(level, grp, n, nodes) of levels (level, node, grp); the list of a group's nodes rises."""
    return levels.groupBy("level", "grp").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("node")).alias("nodes"))


def missing_groups(levels: DataFrame) -> DataFrame:
    """(level, missing): how many of the numbers up to the largest no node has."""
    return levels.groupBy("level").agg((F.max("grp") + 1 - F.count_distinct("grp")).cast("long").alias("missing")).filter("missing > 0")


def node_levels(groups: DataFrame) -> DataFrame:
    """(level, node, grp) from group levels (level, id, grp): ids of level 0 are nodes, those of a further level the groups of the one below. A join for each level."""
    at = [r[0] for r in groups.select("level").distinct().orderBy("level").collect()]
    now = groups.filter(F.col("level") == at[0]).select(F.col("id").alias("node"), "grp") if at else groups.select(F.col("id").alias("node"), "grp")
    out = now.select(F.lit(at[0] if at else 0).alias("level"), "node", "grp")
    for level in at[1:]:
        up = groups.filter(F.col("level") == level).select(F.col("id").alias("grp"), F.col("grp").alias("above"))
        now = now.join(up, "grp").select("node", F.col("above").alias("grp"))
        out = out.union(now.select(F.lit(level).alias("level"), "node", "grp"))
    return out


def group_levels(levels: DataFrame) -> DataFrame:
    """(level, id, grp): the reverse of node_levels."""
    below = levels.select((F.col("level") + 1).alias("level"), "node", F.col("grp").alias("id"))
    up = levels.join(below, ["level", "node"]).select("level", "id", "grp").distinct()
    return levels.filter("level = 0").select("level", F.col("node").alias("id"), "grp").union(up)


def reduced_group_levels(groups: DataFrame) -> DataFrame:
    """Group levels with the groups of each level renumbered without gaps."""
    return group_levels(dense_levels(node_levels(groups)))


def path(levels: DataFrame) -> DataFrame:
    """(node, path): a node's groups from the lowest level to the highest."""
    steps = levels.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("level", "grp"))).alias("x"))
    return steps.select("node", F.col("x.grp").alias("path"))


def level_counts(levels: DataFrame) -> DataFrame:
    return levels.groupBy("level", "grp").agg(F.count(F.lit(1)).alias("n"))


def main_group_share(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """(grp, share, majority): the region's most frequent group, the smallest of equals, its share of the region's nodes, and whether that is a half or more."""
    n = groups.join(ids.select("node").distinct(), "node", "left_semi").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    top = n.agg(F.min(F.struct(-F.col("n"), F.col("grp").alias("grp"), F.col("n").alias("n"))).alias("x"), F.sum("n").alias("all"))
    share = F.col("x.n") / F.col("all")
    return top.filter("x IS NOT NULL").select(F.col("x.grp").alias("grp"), F.round(share, 9).alias("share"), (share >= 0.5).alias("majority"))


def sure_nodes(prob: DataFrame, over: float = 0.95) -> DataFrame:
    """(node, mean) of the nodes whose probability is over the limit."""
    return prob.filter(F.col("mean") > over).select("node", "mean")


def sure_at(prob: DataFrame, limits: tuple[float, ...]) -> DataFrame:
    """(limit, node, mean): the nodes over each of several limits, all in one pass."""
    each = F.explode(F.array(*map(F.lit, limits))).alias("limit")
    return prob.select(each, "node", "mean").filter(F.col("mean") > F.col("limit"))
