"""Trees of nested levels with pre-order intervals.

Levels (level, node, grp) say which group a node is in on each level; a group lies in one group of the level above. Their tree is binary, as dendrograms are: the members of a group, in order, are merged one
by one. Every tree node has an interval of pre-order numbers, so what lies under what is a question of ranges: subtrees, traversals, ancestors of many leaves and where chosen leaves meet need no walk.
Tables are built level by level with joins and windows inside groups; no step follows a chain of merges, and nothing but the list of levels comes to the driver.

Tree nodes: leaves keep their node number, merges are numbered from the number of leaves on, in order of level, group and member. (id, lft, rgt, level, grp, n, pre, last, parent): level 0 are leaves, a
merge has the level (from 1) and group that it builds; n counts leaves, [pre, last] is the interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import settle

#: Numbers of a tree over which one running sum goes.
STRETCH = 50_000


def level_tree(levels: DataFrame) -> DataFrame:
    """The tree of nested levels."""
    at = [r[0] for r in levels.select("level").distinct().orderBy("level").collect()]
    if not at:
        raise ValueError("no level")
    by = {lv: levels.filter(F.col("level") == lv).select("node", F.col("grp").alias(f"g{k}")) for k, lv in enumerate(at)}
    leaves = by[at[0]].count()
    # Upward: (child, zid, n, grp) of a level; children of level 0 are nodes, later ones the groups below.
    child = by[at[0]].select(F.col("node").alias("child"), F.col("node").alias("zid"), F.lit(1).cast("long").alias("n"), F.col("g0").alias("grp"))
    built, used = [], leaves
    in_order = Window.partitionBy("grp").orderBy("child")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    for k in range(len(at)):
        x = child.withColumn("k", F.row_number().over(in_order) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("grp")))
        x = x.withColumn("sum", F.sum("n").over(so_far)).withColumn("before", F.lag("zid").over(in_order))
        sizes = x.groupBy("grp").agg((F.count(F.lit(1)) - 1).alias("merges"))
        first = sizes.withColumn("first", F.coalesce(F.sum("merges").over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + used)  # groups of a grid's level
        x = settle(x.join(first, "grp").withColumn("at", F.col("first") + F.col("k") - 1))
        built.append(x)
        used += x.filter("k > 0").count()
        if k + 1 < len(at):
            above = by[at[k]].join(by[at[k + 1]], "node").select(F.col(f"g{k}").alias("child"), F.col(f"g{k + 1}").alias("grp")).distinct()
            top = x.filter("k = m - 1").select(F.col("grp").alias("child"), F.when(F.col("m") == 1, F.col("zid")).otherwise(F.col("at")).cast("int").alias("zid"), F.col("sum").alias("n"))
            child = top.join(above, "child").select("child", "zid", "n", "grp")
    # Downward: a group's last merge is its top; before it in pre-order come the tops of later members' merges and those members with all under them.
    heads = built[-1].groupBy("grp").agg(F.sum("n").alias("n")).withColumn("start", F.coalesce(F.sum(2 * F.col("n") - 1).over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts, out = heads.select("grp", "start"), []
    so_far, whole = Window.partitionBy("grp").orderBy("child").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("grp")
    for k in range(len(at) - 1, -1, -1):
        x = built[k].join(starts, "grp").withColumn("skip", F.sum(2 * F.col("n")).over(whole) - F.sum(2 * F.col("n")).over(so_far))  # of each later member its own 2 n - 1 and one merge
        x = x.withColumn("own", F.col("start") + F.col("skip")).withColumn("n0", F.first("n").over(Window.partitionBy("grp").orderBy("child"))).withColumn("own1", F.max(F.when(F.col("k") == 1, F.col("own"))).over(Window.partitionBy("grp")))
        place = F.when(F.col("m") == 1, F.col("start")).when(F.col("k") == 0, F.col("own1") + 1).when(F.col("k") == 1, F.col("own") + 2 * F.col("n0")).otherwise(F.col("own") + 1)
        x = settle(x.withColumn("place", place))
        merge = x.filter("k > 0").select(F.col("at").cast("int").alias("id"), F.when(F.col("k") == 1, F.col("before")).otherwise(F.col("zid")).cast("int").alias("lft"), F.when(F.col("k") == 1, F.col("zid")).otherwise(F.col("at") - 1).cast("int").alias("rgt"), F.lit(k + 1).alias("level"), "grp", F.col("sum").alias("n"), F.col("own").alias("pre"))
        out.append(merge)
        if k:
            starts = x.select(F.col("child").alias("grp"), F.col("place").alias("start"))
        else:
            none = F.lit(None).cast("int")
            out.append(x.select(F.col("child").cast("int").alias("id"), none.alias("lft"), none.alias("rgt"), F.lit(0).alias("level"), F.col("child").alias("grp"), F.lit(1).cast("long").alias("n"), F.col("place").alias("pre")))
    every = out[0]
    for t in out[1:]:
        every = every.union(t)
    every = settle(every.withColumn("last", F.col("pre") + 2 * F.col("n") - 2))
    parent = every.filter("lft IS NOT NULL").select(F.explode(F.array("lft", "rgt")).alias("id"), F.col("id").alias("parent"))
    return settle(every.join(parent, "id", "left"))


def merges(tree: DataFrame) -> DataFrame:
    """(id, lft, rgt, level, n): the linkage table."""
    return tree.filter("lft IS NOT NULL").select("id", "lft", "rgt", "level", "n")


def covering(points: DataFrame, tree: DataFrame) -> DataFrame:
    """(all columns of both) of each point (at, ...) and every tree node whose interval holds it: an equi-join. An interval of up to 2^k numbers touches at most two aligned blocks of 2^k; a point is in one
    block of each size."""
    top = tree.agg(F.max("last")).first()[0] or 0
    bits = int(top).bit_length()
    k = F.ceil(F.log2((F.col("last") - F.col("pre") + 1).cast("double"))).cast("int")
    blocks = F.array_distinct(F.array(F.expr("shiftright(pre, __k)"), F.expr("shiftright(last, __k)")))
    spans = tree.withColumn("__k", k).withColumn("__block", F.explode(blocks))
    places = points.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("__block", F.expr("shiftright(at, __k)"))
    return places.join(spans, ["__k", "__block"]).filter("at BETWEEN pre AND last").drop("__k", "__block")


def subtree(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """(top, id, level, pre) of all tree nodes under each of the ids, itself first in pre-order."""
    tops = tree.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("top"), "pre", "last")
    return covering(tree.select("id", "level", F.col("pre").alias("at")), tops).select("top", "id", "level", F.col("at").alias("pre"))


def leaves_under(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """(top, leaf)"""
    return subtree(tree, ids).filter("level = 0").select("top", F.col("id").alias("leaf"))


def ancestors_of(tree: DataFrame, leaves: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """(leaf, id, level, pre) of everything above each leaf (node), itself included; of the rows of tree alone, if these are not the whole tree."""
    at = (tree if whole is None else whole).filter("level = 0").join(leaves.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("leaf"), F.col("pre").alias("at"))
    return covering(at, tree.select("id", "level", "pre", "last")).select("leaf", "id", "level", "pre")


def forward_path(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf, level, id): of each level the last tree node on the way from the leaf to the root. Levels do not fall on the way, so that is the one whose parent is of another level, and a leaf meets no more
    rows than there are levels; all its ancestors would be as many as the members of its groups."""
    last = tree.join(tree.select(F.col("id").alias("parent"), F.col("level").alias("above")), "parent", "left").filter("above IS NULL OR above <> level")
    return ancestors_of(last, leaves, tree).select("leaf", "level", "id")


def chosen_under(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """(id, chosen): how many of the leaves (node, a leaf as often as it comes) lie under each tree node that has some: those before its interval's end less those before its start. Running sums go over
    stretches of the numbers of the tree."""
    at = tree.filter("level = 0").select(F.col("id").alias("node"), F.col("pre").alias("at")).join(leaves.groupBy("node").agg(F.count(F.lit(1)).alias("times")), "node")
    stretch = F.floor(F.col("at") / STRETCH).alias("s")
    steps = settle(at.select("at", "times", stretch))
    ahead = steps.groupBy("s").agg(F.sum("times").alias("c")).select("s", F.sum("c").over(Window.orderBy("s")).alias("whole"), "c")  # a row a stretch
    ends = F.explode(F.array(F.struct((F.col("pre") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("last").alias("at"), F.lit(1).alias("sign"))))
    asked = tree.select("id", ends.alias("e")).select("id", "e.at", "e.sign").filter("at >= 0").withColumn("s", stretch)
    both = steps.withColumns({"id": F.lit(None).cast("int"), "sign": F.lit(None).cast("int")}).unionByName(asked.withColumn("times", F.lit(0).cast("long")))
    own = both.withColumn("own", F.sum("times").over(Window.partitionBy("s").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))).filter("sign IS NOT NULL")
    # A stretch without leaves is not in the table of stretches: the last one before it counts.
    spans = ahead.select("s", (F.col("whole") - F.col("c")).alias("base"), F.lead("s").over(Window.orderBy("s")).alias("next"), "whole")
    filled = spans.select("base", "whole", F.explode(F.sequence("s", F.coalesce(F.col("next") - 1, "s"))).alias("to"), "s").select(F.col("to").alias("s"), F.when(F.col("to") == F.col("s"), F.col("base")).otherwise(F.col("whole")).alias("base"))
    total = steps.agg(F.sum("times").alias("all"))
    last = steps.agg(F.max("s").alias("end"))
    based = own.join(F.broadcast(filled), "s", "left").join(F.broadcast(total)).join(F.broadcast(last))
    sum_ = F.coalesce("base", F.when(F.col("s") > F.col("end"), F.col("all")).otherwise(0)) + F.col("own")
    return based.groupBy("id").agg(F.sum(F.col("sign") * sum_).alias("chosen")).filter("chosen > 0")


def meeting_points(tree: DataFrame, leaves: DataFrame, more_than: int = 0) -> DataFrame:
    """(id, level, pairs): at which merge how many pairs of the chosen leaves meet first. A pair meets where it comes from both sides, so a merge has left times right pairs, and no pair is ever a row."""
    n = chosen_under(tree, leaves.select("node").distinct())
    m = tree.filter("lft IS NOT NULL").select("id", "level", "lft", "rgt")
    both = m.join(n.select(F.col("id").alias("lft"), F.col("chosen").alias("a")), "lft").join(n.select(F.col("id").alias("rgt"), F.col("chosen").alias("b")), "rgt")
    return both.select("id", "level", (F.col("a") * F.col("b")).alias("pairs")).filter(F.col("pairs") > more_than)


def main_meeting_point(tree: DataFrame, leaves: DataFrame, more_than: int = 2) -> DataFrame:
    """(id, level, pairs) of the merge at which most pairs meet, the lowest of equals."""
    top = meeting_points(tree, leaves, more_than).agg(F.min(F.struct((-F.col("pairs")).alias("p"), "id", "level", "pairs")).alias("x"))
    return top.filter("x IS NOT NULL").select("x.id", "x.level", "x.pairs")


def common_levels(tree: DataFrame, sets: DataFrame, min_level: int = 4) -> DataFrame:
    """(id, level, chosen, all) of the tree nodes of a level and above over some leaf of every set (part, node)."""
    parts = sets.select("part").distinct().count()
    at = tree.filter("level = 0").select(F.col("id").alias("node"), F.col("pre").alias("at")).join(sets.select("part", "node"), "node")
    over = covering(at.select("part", "at"), tree.filter(F.col("level") >= min_level).select("id", "level", "pre", "last"))
    per = over.groupBy("id", "level").agg(F.count_distinct("part").alias("parts"), F.count(F.lit(1)).alias("chosen"))
    return per.filter(F.col("parts") == parts).select("id", "level", "chosen").join(F.broadcast(sets.agg(F.count(F.lit(1)).alias("all"))))


def split_point(tree: DataFrame, sets: DataFrame, miss: int = 2, share: float = 0.1, min_level: int = 4) -> DataFrame:
    """One row (id, level): the first tree node, in order of numbers, over all but `miss` and at least a share of all leaves of the sets, if its level is below that of the highest common one; else that."""
    c = common_levels(tree, sets, min_level)
    good = (F.col("all") - F.col("chosen") <= miss) & (F.col("chosen") / F.col("all") >= share)
    x = c.agg(F.max(F.struct("id", "level")).alias("top"), F.min(F.when(good, F.struct("id", "level"))).alias("first")).filter("top IS NOT NULL")
    pick = F.when(F.col("first.level") < F.col("top.level"), F.col("first")).otherwise(F.col("top"))
    return x.select(pick.alias("x")).select("x.id", "x.level")


def split_point_of_each(tree: DataFrame, sets: DataFrame, miss: int = 10, share: float = 1.0, min_level: int = 4) -> DataFrame:
    """As split_point, where each single set too must lie under the node but for `miss`, and by that share; of the lowest level with such nodes the last is taken."""
    c = common_levels(tree, sets, min_level)
    size = sets.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    at = tree.filter("level = 0").select(F.col("id").alias("node"), F.col("pre").alias("at")).join(sets.select("part", "node"), "node")
    held = covering(at.select("part", "at"), tree.filter(F.col("level") >= min_level).select("id", "pre", "last")).groupBy("id", "part").agg(F.count(F.lit(1)).alias("own")).join(F.broadcast(size), "part")
    each = held.groupBy("id").agg(F.min(((F.col("size") - F.col("own") <= miss) & (F.col("own") / F.col("size") >= share)).cast("int")).alias("all_fit"), F.count(F.lit(1)).alias("parts"))
    every = each.join(F.broadcast(size.agg(F.count(F.lit(1)).alias("of"))), F.col("parts") == F.col("of")).filter("all_fit = 1").select("id", F.lit(True).alias("fits"))
    good = F.coalesce("fits", F.lit(False)) & (F.col("all") - F.col("chosen") <= miss) & (F.col("chosen") / F.col("all") >= share)
    x = settle(c.join(every, "id", "left").withColumn("good", good))
    top = x.agg(F.max(F.struct("id", "level")).alias("top"))
    low = x.filter("good").groupBy("level").agg(F.max("id").alias("id")).agg(F.min(F.struct("level", "id")).alias("low"))
    return top.join(low).filter("top IS NOT NULL").select(F.coalesce(F.when(F.col("low.level") <= F.col("top.level"), F.struct(F.col("low.id").alias("id"), F.col("low.level").alias("level"))), F.col("top")).alias("x")).select("x.id", "x.level")


def chosen_levels(levels: DataFrame, leaves: DataFrame) -> DataFrame:
    """(level, node, grp) of the chosen leaves alone, leaves and groups numbered anew without gaps: the tree reduced to what matters."""
    some = levels.join(leaves.select("node").distinct(), "node", "left_semi")
    new = lambda col, *by: F.dense_rank().over(Window.partitionBy(*by).orderBy(col)) - 1
    return some.select("level", new("node", "level").alias("node"), new("grp", "level").alias("grp"))
