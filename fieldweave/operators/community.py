"""Communities: label propagation, levels, trees and ensembles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import closed
from .graph import SPREAD_NODES, undirected
from .lineage import drop, settle


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """(node, pieces): a row a node that has links, whichever way its edges go, with pieces (first, gaps) of its list of neighbours, which may overlap; written. Passes over a network then read two bytes a
    link each way, where numbers lie close, and shuffle none; edges are gone over once."""
    return settle(closed.packed(edges.select("src", "dst")).groupBy("node").agg(F.collect_list(F.struct("first", "gaps")).alias("pieces")))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): each node takes its neighbours' most frequent label, the smallest of equals, for a fixed number of synchronous rounds.

    Lists of neighbours are written once; a round gives the labels, two numbers a node, to every task and counts votes where the lists lie. With more than SPREAD_NODES nodes votes are joins."""
    labels = settle(nodes.select("node", F.col("node").alias("label")))
    if labels.count() > SPREAD_NODES:
        return _propagated_by_joins(labels, edges, rounds)
    kind, lists = nodes.schema["node"].dataType.simpleString(), neighbour_lists(edges)
    for _ in range(rounds):
        now = labels.toPandas().sort_values("node")
        held = labels.sparkSession.sparkContext.broadcast((now["node"].to_numpy(np.int64), now["label"].to_numpy(np.int64)))

        def vote(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            known, label = held.value
            for b in batches:
                node, best = [], []
                for n, pieces in zip(b["node"].tolist(), b["pieces"], strict=True):
                    ids = np.unique(np.concatenate([np.cumsum(np.concatenate(([p["first"]], p["gaps"])), dtype=np.int64) for p in pieces]))
                    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                    votes = label[at[known[at] == ids]]
                    if len(votes):
                        values, count = np.unique(votes, return_counts=True)
                        node.append(n)
                        best.append(values[count.argmax()])
                yield pd.DataFrame({"node": node, "next": best})

        last, labels = labels, settle(labels.join(lists.mapInPandas(vote, f"node {kind}, next {kind}"), "node", "left").select("node", F.coalesce("next", "label").alias("label")))
        drop(last)
        held.unpersist()
    return labels


def _propagated_by_joins(labels: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    u = undirected(edges)
    both = u.union(u.select(F.col("dst"), F.col("src")))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct(-F.col("n"), F.col("label").alias("label"))).alias("x")).select("node", F.col("x.label").alias("next"))
        labels = labels.join(best, "node", "left").select("node", F.coalesce("next", "label").alias("label"))
    return labels


def dense_levels(levels: DataFrame) -> DataFrame:
    """(level, node, grp) with groups renumbered 0..k-1 in each level."""
    ids = levels.select("level", "grp").distinct().withColumn("g", F.row_number().over(Window.partitionBy("level").orderBy("grp")) - 1)
    return levels.join(ids, ["level", "grp"]).select("level", "node", F.col("g").alias("grp"))


def order_by_latitude(levels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Groups renumbered by mean latitude in each level."""
    mean = levels.join(nodes.select("node", "lat"), "node").groupBy("level", "grp").agg(F.round(F.avg("lat"), 9).alias("lat"))
    ids = mean.withColumn("g", F.row_number().over(Window.partitionBy("level").orderBy("lat", "grp")) - 1)
    return levels.join(ids, ["level", "grp"]).select("level", "node", F.col("g").alias("grp"))


def block_matrix(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(r, s, n): edges between groups (node, grp)."""
    s = groups.select(F.col("node").alias("src"), F.col("grp").alias("r"))
    d = groups.select(F.col("node").alias("dst"), F.col("grp").alias("s"))
    return edges.join(s, "src").join(d, "dst").groupBy("r", "s").agg(F.count(F.lit(1)).alias("n"))


def main_group(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """The most frequent group of the region's nodes, the smallest of equals."""
    n = groups.join(ids, "node", "left_semi").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min(F.struct(-F.col("n"), F.col("grp").alias("grp"))).alias("x")).select(F.col("x.grp").alias("grp"))


def probability_map(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, mean, std) over runs (run, node, grp) of whether a node is in the region's main group of the run."""
    n = runs.join(ids, "node", "left_semi").groupBy("run", "grp").agg(F.count(F.lit(1)).alias("n"))
    main = n.groupBy("run").agg(F.min(F.struct(-F.col("n"), F.col("grp").alias("grp"))).alias("x")).select("run", F.col("x.grp").alias("main"))
    hit = runs.join(F.broadcast(main), "run").withColumn("hit", (F.col("grp") == F.col("main")).cast("double"))
    return hit.groupBy("node").agg(F.round(F.avg("hit"), 9).alias("mean"), F.round(F.stddev_pop("hit"), 9).alias("std"))


def ancestors(tree: DataFrame, depth: int = 64) -> DataFrame:
    """(id, ancestor, hops), each id its own at 0, of a tree (id, parent)."""
    spark = tree.sparkSession
    return spark.sql(f"WITH RECURSIVE r(id, ancestor, hops) MAX RECURSION LEVEL {depth} AS (SELECT id, id, 0 FROM {{t}} UNION ALL SELECT r.id, x.parent, hops + 1 FROM r JOIN {{t}} x ON x.id = r.ancestor WHERE x.parent IS NOT NULL) SELECT id, ancestor, hops FROM r", t=tree)


def common_ancestor(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, lca) of pairs of ids."""
    up = ancestors(tree)
    x = pairs.join(up.select(F.col("id").alias("a"), "ancestor", F.col("hops").alias("ha")), "a").join(up.select(F.col("id").alias("b"), "ancestor", F.col("hops").alias("hb")), ["b", "ancestor"])
    return x.groupBy("a", "b").agg(F.min(F.struct((F.col("ha") + F.col("hb")).alias("h"), "ancestor")).alias("x")).select("a", "b", F.col("x.ancestor").alias("lca"))
