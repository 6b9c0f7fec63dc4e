"""Queries of trees of levels. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees
from .registry import BASE, points, query

#: Groups of a level by those below: 12 of nodes, then 4, 2 and 1.
GROUPS = ("node % 12", "node % 12 // 3", "node % 12 // 6", "0")


def _tree_sql() -> str:
    """Merges level by level: a group's members in order, their tree nodes, and how many merges come before."""
    out, child, used = BASE, "SELECT node c, node z, 1::BIGINT n, node % 12 g FROM pts", "(SELECT n FROM size)"
    for k in range(4):
        up = {0: "g // 3", 1: "g // 2", 2: "0", 3: "0"}[k]
        out += f""", c{k} AS ({child}),
k{k} AS (SELECT *, row_number() OVER w - 1 k, count(*) OVER (PARTITION BY g) m, sum(n) OVER w s, lag(z) OVER w b FROM c{k} WINDOW w AS (PARTITION BY g ORDER BY c)),
f{k} AS (SELECT g, {used} + coalesce(sum(m - 1) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) f FROM (SELECT DISTINCT g, m FROM k{k})),
z{k} AS (SELECT g, f + k - 1 id, CASE WHEN k = 1 THEN b ELSE z END lft, CASE WHEN k = 1 THEN z ELSE f + k - 2 END rgt, {k + 1} AS level, s n, m, k, z FROM k{k} JOIN f{k} USING (g))"""
        child = f"SELECT g c, CASE WHEN m = 1 THEN z ELSE id END z, n, {up} g FROM z{k} WHERE k = m - 1"
        used = f"(SELECT {used} + sum(m - 1) FROM (SELECT DISTINCT g, m FROM k{k}))"
    out += ", zz AS (" + " UNION ALL ".join(f"SELECT id, lft, rgt, level, n, g FROM z{k} WHERE k > 0" for k in range(4)) + "), par AS (SELECT lft id, id AS parent FROM zz UNION ALL SELECT rgt, id FROM zz), al AS (SELECT node id, 0 AS level, node g FROM pts UNION ALL SELECT id, level, g FROM zz) "
    return "WITH RECURSIVE" + out.strip()[4:]


TREE = _tree_sql()
UP = TREE + ", up(leaf, id) AS (SELECT node, node FROM pts UNION ALL SELECT up.leaf, par.parent FROM up JOIN par ON par.id = up.id) "


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = points(spark, sf_dir)
    g = F.col("node") % 12
    each = (g, F.floor(g / 3), F.floor(g / 6), F.lit(0))
    levels = nodes.select(F.lit(0).alias("level"), "node", each[0].cast("int").alias("grp"))
    for k, x in enumerate(each[1:], 1):
        levels = levels.union(nodes.select(F.lit(k), "node", x.cast("int")))
    return trees.level_tree(levels)


@query(TREE + "SELECT id::INT id, lft::INT lft, rgt::INT rgt, level::INT AS level, n::BIGINT n FROM zz")
def level_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linkage table of nested levels."""
    return trees.merges(_tree(spark, sf_dir))


@query(TREE + "SELECT id::INT id, level::INT AS level, g::INT grp FROM al")
def tree_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and group of every tree node."""
    return _tree(spark, sf_dir).select("id", "level", F.col("grp").cast("int").alias("grp"))


@query(TREE + ", t(id, path) AS (SELECT max(id), [0] FROM zz UNION ALL SELECT c.id, list_append(t.path, c.side) FROM t JOIN (SELECT id p, lft id, 0 side FROM zz UNION ALL SELECT id, rgt, 1 FROM zz) c ON c.p = t.id) SELECT id::INT id, row_number() OVER (ORDER BY path) - 1 AS place FROM t")
def tree_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tree nodes in pre-order from the root."""
    tree = _tree(spark, sf_dir)
    return trees.subtree(tree, tree.filter("parent IS NULL").select("id")).select("id", F.col("pre").cast("long").alias("place"))


@query(UP + "SELECT up.id::INT top, leaf::INT leaf FROM up JOIN zz ON zz.id = up.id WHERE zz.level = 2 AND zz.id % 2 = 0")
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves under some merges."""
    tree = _tree(spark, sf_dir)
    return trees.leaves_under(tree, tree.filter("level = 2 AND id % 2 = 0").select("id"))


@query(UP + "SELECT leaf::INT leaf, al.level::INT AS level, max(up.id)::INT id FROM up JOIN al ON al.id = up.id WHERE leaf % 4 = 1 GROUP BY leaf, al.level")
def tree_forward_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way from leaves to the root, the last tree node of each level."""
    return trees.forward_path(_tree(spark, sf_dir), points(spark, sf_dir).filter("node % 4 = 1"))


@query(UP + ", pr2 AS (SELECT a.leaf, b.leaf leaf2, min(a.id) id FROM up a JOIN up b ON a.id = b.id AND a.leaf < b.leaf WHERE a.leaf % 4 = 1 AND b.leaf % 4 = 1 GROUP BY 1, 2) SELECT pr2.id::INT id, level::INT AS level, count(*) pairs FROM pr2 JOIN zz USING (id) GROUP BY pr2.id, level HAVING count(*) > 2")
def tree_meeting_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where how many pairs of chosen leaves meet first."""
    return trees.meeting_points(_tree(spark, sf_dir), points(spark, sf_dir).filter("node % 4 = 1"), 2)


SETS = UP + ", st AS (SELECT (node % 3)::INT part, node FROM pts WHERE node % 12 IN (1, 2, 4, 5) AND node < 100), cm AS (SELECT up.id, al.level, count(*) c, (SELECT count(*) FROM st) a FROM up JOIN st ON st.node = up.leaf JOIN al ON al.id = up.id WHERE al.level >= 1 GROUP BY up.id, al.level HAVING count(DISTINCT part) = (SELECT count(DISTINCT part) FROM st)) "


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).filter("node % 12 IN (1, 2, 4, 5) AND node < 100").select((F.col("node") % 3).alias("part"), "node")


@query(SETS + ", x AS (SELECT (SELECT max(id) FROM cm) top, (SELECT min(id) FROM cm WHERE a - c <= 2 AND c >= 0.1 * a) f), y AS (SELECT CASE WHEN (SELECT level FROM al WHERE id = f) < (SELECT level FROM al WHERE id = top) THEN f ELSE top END id FROM x) SELECT y.id::INT id, level::INT AS level FROM y JOIN al USING (id)")
def tree_split_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge that parts sets of leaves from the rest."""
    return trees.split_point(_tree(spark, sf_dir), _sets(spark, sf_dir), min_level=1)


@query(SETS + ", sz AS (SELECT part, count(*) s FROM st GROUP BY part), hd AS (SELECT up.id, part, count(*) o FROM up JOIN st ON st.node = up.leaf GROUP BY 1, 2), gd AS (SELECT cm.* FROM cm WHERE a - c <= 10 AND (SELECT count(*) FROM hd JOIN sz USING (part) WHERE hd.id = cm.id AND s - o <= 10) = (SELECT count(*) FROM sz)), lo AS (SELECT max(id) id, level FROM gd WHERE level = (SELECT min(level) FROM gd) GROUP BY level), tp AS (SELECT max(id) id FROM cm) SELECT y.id::INT id, al.level::INT AS level FROM (SELECT coalesce((SELECT id FROM lo), (SELECT id FROM tp)) id) y JOIN al USING (id)")
def tree_split_point_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As before, where each set has to lie under it."""
    return trees.split_point_of_each(_tree(spark, sf_dir), _sets(spark, sf_dir), miss=10, share=0.0, min_level=1)
