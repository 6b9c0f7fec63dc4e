"""Queries of places, attributes, regions and levels. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import community as C
from ..operators import graph as G
from ..operators import levels as L
from ..operators import places as P
from ..operators import regions as R
from ..sources import tables as S
from .registry import BASE, LEN, R1, R2, TRI, _regions, hav, network, points, query, rounded, streamed, streamed_pairs

AT = BASE + f", q AS (SELECT n_nationkey q, -180 + n_nationkey * 14.0 lon, -60 + n_nationkey * 5.0 lat FROM nation), nn AS (SELECT q.q, arg_min(p.node, row(round({hav('q', 'p')}, 12), p.node)) node FROM q, pts p GROUP BY q.q) "


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.col("n_nationkey").alias("q"), (F.col("n_nationkey") * 14.0 - 180).alias("qlon"), (F.col("n_nationkey") * 5.0 - 60).alias("qlat"))


@query(AT + "SELECT q, src::INT src, dst::INT dst FROM nn JOIN g ON g.src = nn.node")
def targets_for_coord(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = network(spark, sf_dir, True)
    return P.targets_at(nodes, edges, _places(spark, sf_dir))


@query(BASE + f"SELECT node::INT node, node IN (SELECT dst FROM g WHERE src IN ({R1})) linked FROM pts")
def linked_to_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = streamed(spark, sf_dir, True)
    return P.linked_to_any(nodes, edges, _regions(nodes)[0])


@query(LEN + "SELECT src::INT src, dst::INT dst, round(len, 4) length FROM l WHERE len >= 5000 AND weight >= (SELECT quantile_cont(weight, 0.5) FROM e)")
def long_range_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.long_links(*streamed(spark, sf_dir), 5000, "weight", 0.5), "length", places=4).select("src", "dst", "length")


@query(BASE + "SELECT node::INT node FROM pts WHERE lon > -90 AND lon < 90 AND lat > -45 AND lat < 45")
def box_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.strict_box(points(spark, sf_dir), (90, -90), (-45, 45)).select("node")


@query(BASE + "SELECT (row_number() OVER (ORDER BY node) - 1)::INT node, node::INT AS old FROM pts WHERE lon BETWEEN -30 AND 90 AND lat BETWEEN -40 AND 40")
def box_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = points(spark, sf_dir)
    return P.renumbered(nodes.filter("lon BETWEEN -30 AND 90 AND lat BETWEEN -40 AND 40")).select("node", "old")


@query(BASE + ", d AS (SELECT src node, count(*) n FROM g GROUP BY 1) SELECT p.node::INT node, n FROM pts p JOIN d ON d.node = p.node WHERE lon BETWEEN 20 AND 160 AND lat BETWEEN -60 AND 60 AND n > 3")
def values_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = network(spark, sf_dir, True)
    n = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return P.values_in_box(nodes, n, "n", (20, 160), (-60, 60), 3).select("node", "n")


@query(BASE + f", c AS (SELECT dst node, count(*) n FROM g WHERE src IN ({R1}) GROUP BY 1) SELECT p.node::INT node, coalesce(n, 0) n FROM pts p LEFT JOIN c ON c.node = p.node")
def count_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = network(spark, sf_dir, True)
    return P.count_map(nodes, G.target_counts(edges, _regions(nodes)[0]))


#: Wanted are all pairs of the symmetric network that end in a region; the directed one lacks some of them and has the reverse.
@query(BASE + f", w AS (SELECT src u, dst v FROM e WHERE dst IN ({R2}) AND src % 2 = 0), x AS (SELECT v node, sum(coalesce((SELECT weight FROM g WHERE g.src = u AND g.dst = v), (SELECT weight FROM g WHERE g.src = v AND g.dst = u))) s FROM w GROUP BY 1), k AS (SELECT node, count(*) k FROM (SELECT unnest([src, dst]) node FROM g) GROUP BY 1) SELECT n.node::INT node, round(coalesce(x.s, 0) / k.k, 10) + 0.0 weight FROM (SELECT DISTINCT unnest([u, v]) node FROM w) n LEFT JOIN x ON x.node = n.node LEFT JOIN k ON k.node = n.node")
def node_attr_for_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, pairs = streamed_pairs(spark, sf_dir, True)
    ends = G.spread(_regions(nodes)[1].select(F.col("node").alias("v")))
    found = G.looked_up_pairs(pairs, "weight").filter("u % 2 = 0").join(ends, "v", "left_semi")
    return rounded(P.sums_of(nodes, streamed(spark, sf_dir, True)[1], found, "weight"), "weight", places=10)


@query(TRI + "SELECT coalesce(round(3 * (SELECT count(*) FROM t) / (SELECT sum(k * (k - 1) / 2) FROM k), 9), 0)::DOUBLE transitivity")
def transitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.transitivity(streamed(spark, sf_dir)[1])


@query(BASE + "SELECT (SELECT count(*) FROM pts) AS nodes, count(*) AS edges, (SELECT count(*) FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.src = a.dst AND b.dst = a.src)) > 0 directed, coalesce(bool_or(weight <> 1), false) weighted, round(2.0 * count(*) / (SELECT count(*) FROM pts), 9)::DOUBLE mean_degree FROM g")
def network_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.info_of_pairs(*streamed_pairs(spark, sf_dir, True))


@query(BASE + "SELECT round(2.0 * (SELECT count(*) FROM u) / (n * (n - 1)), 9)::DOUBLE density FROM size")
def link_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.link_density(*streamed(spark, sf_dir))


PROB = ", rn AS (SELECT run, node, (node * run) % 4 grp FROM pts, range(1, 6) r(run)), kc AS (SELECT run, grp, count(*) c FROM rn WHERE node < 30 GROUP BY run, grp), k AS (SELECT run, grp, row_number() OVER (PARTITION BY run ORDER BY c DESC, grp) o FROM kc), pm AS (SELECT rn.node, avg((rn.grp = k.grp)::INT) mean FROM rn JOIN k ON k.run = rn.run AND k.o = 1 GROUP BY rn.node), sure AS (SELECT * FROM pm WHERE mean > 0.5) "


def _sure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = points(spark, sf_dir)
    runs = nodes.join(spark.range(1, 6).withColumnRenamed("id", "run")).select("run", "node", (F.col("node") * F.col("run") % 4).alias("grp"))
    return L.sure_nodes(C.probability_map(runs, nodes.filter("node < 30")), 0.5)


@query(BASE + PROB + "SELECT node::INT node, round(mean, 9) mean FROM sure")
def sure_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sure(spark, sf_dir)


@query(BASE + PROB + "SELECT t, round(avg(v), 6) + 0.0 v FROM f WHERE node IN (SELECT node FROM sure) GROUP BY t")
def prob_map_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.region_series(S.field_daily(spark, sf_dir), _sure(spark, sf_dir)), "v")


@query(BASE + PROB + ", x AS (SELECT year(t) y, sum(v) total, avg(v) mean, stddev_pop(v) spread FROM m WHERE node IN (SELECT node FROM sure) GROUP BY 1) SELECT r.y::INT y, round(total, 6) total, round(mean, 6) mean, round(spread, 6) spread FROM range(1990, 2000) r(y) LEFT JOIN x ON x.y = r.y")
def prob_map_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.yearly_series(S.field_monthly(spark, sf_dir), _sure(spark, sf_dir), 1990, 1999), "total", "mean", "spread")


@query("SELECT month(l_shipdate)::INT m, day(l_shipdate)::INT d, count(*) n FROM lineitem GROUP BY ALL")
def day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.day_counts(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_shipdate")


GL = BASE + ", gl AS (SELECT 0 level, node id, node % 7 * 3 grp FROM pts UNION ALL SELECT 1, i * 3, i // 3 * 5 FROM range(7) r(i)), nl AS (SELECT 0 level, node, node % 7 * 3 grp FROM pts UNION ALL SELECT 1, node, node % 7 // 3 * 5 FROM pts) "


def _group_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = points(spark, sf_dir).select(F.lit(0).alias("level"), F.col("node").alias("id"), (F.col("node") % 7 * 3).alias("grp"))
    return zero.union(spark.range(7).select(F.lit(1), (F.col("id") * 3).cast("int"), (F.floor(F.col("id") / 3) * 5).cast("int")))


@query(GL + "SELECT level, node::INT node, grp::INT grp FROM nl")
def node_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.node_levels(_group_levels(spark, sf_dir))


@query(GL + ", dn AS (SELECT level, node, dense_rank() OVER (PARTITION BY level ORDER BY grp) - 1 grp FROM nl) SELECT DISTINCT 0 level, node::INT id, grp::INT grp FROM dn WHERE level = 0 UNION ALL SELECT DISTINCT 1, a.grp::INT, b.grp::INT FROM dn a JOIN dn b ON a.node = b.node WHERE a.level = 0 AND b.level = 1")
def reduced_group_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reduced_group_levels(_group_levels(spark, sf_dir))


@query(GL + "SELECT level, grp::INT grp, count(*) n, string_agg(node::VARCHAR, ',' ORDER BY node) AS nodes FROM nl GROUP BY ALL")
def level_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.members(L.node_levels(_group_levels(spark, sf_dir))).withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ","))


@query(GL + "SELECT level, (max(grp) + 1 - count(DISTINCT grp))::BIGINT missing FROM nl GROUP BY level HAVING missing > 0")
def missing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.missing_groups(L.node_levels(_group_levels(spark, sf_dir)))


@query(GL + "SELECT node::INT node, string_agg(grp::VARCHAR, ',' ORDER BY level) AS path FROM nl GROUP BY node")
def level_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.path(L.node_levels(_group_levels(spark, sf_dir))).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


@query(BASE + ", c AS (SELECT node % 7 grp, count(*) n FROM pts WHERE node % 3 = 1 GROUP BY 1) SELECT grp::INT grp, round(n / (SELECT sum(n) FROM c), 9)::DOUBLE share, n / (SELECT sum(n) FROM c) >= 0.5 majority FROM c ORDER BY n DESC, grp LIMIT 1")
def main_group_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = points(spark, sf_dir)
    return L.main_group_share(nodes.select("node", (F.col("node") % 7).alias("grp")), nodes.filter("node % 3 = 1"))


BOXES = [("west", -180.0, 0.0, -60.0, 60.0, 6, 9), ("east", 20.0, 160.0, -30.0, 30.0, 11, 2), ("date line", 150.0, -150.0, -40.0, 40.0, 1, 12), ("small", 60.0, 80.0, -20.0, 40.0, 3, 5)]
RGN = BASE + ", rg(region, lon0, lon1, lat0, lat1, m0, m1) AS (VALUES " + ", ".join(str(b) for b in BOXES) + """),
rm AS (SELECT region, node FROM pts, rg WHERE lat BETWEEN lat0 AND lat1 AND CASE WHEN lon0 > lon1 THEN lon >= lon0 OR lon <= lon1 ELSE lon BETWEEN lon0 AND lon1 END),
rr AS (SELECT run, node, (node * run) % 4 grp FROM pts, range(1, 6) r(run)),
vt AS (SELECT region, run, grp, count(*) c FROM rr JOIN rm USING (node) GROUP BY ALL), mg AS (SELECT region, run, arg_min(grp, row(-c, grp)) grp FROM vt GROUP BY ALL),
pb AS (SELECT mg.region, rr.node, count(*) / 5 mean FROM rr JOIN mg ON mg.run = rr.run AND mg.grp = rr.grp GROUP BY ALL), sm AS (SELECT region, node FROM pb WHERE mean > 0.5),
ts AS (SELECT region, t, avg(v) v, count(*) nodes FROM m JOIN sm USING (node) GROUP BY ALL),
tw AS (SELECT ts.*, CASE WHEN m0 <= m1 THEN CASE WHEN month(t) BETWEEN m0 AND m1 THEN year(t) END WHEN month(t) >= m0 THEN year(t) WHEN month(t) <= m1 THEN year(t) - 1 END season FROM ts JOIN rg USING (region)),
ta AS (SELECT *, v - avg(v) OVER (PARTITION BY region, month(t)) an FROM tw WHERE season IS NOT NULL) """


def _regions_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOXES, R.COLUMNS)


def _runs(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.sparkSession.range(1, 6).withColumnRenamed("id", "run")).select("run", "node", (F.col("node") * F.col("run") % 4).alias("grp"))


@query(RGN + "SELECT region, node::INT node FROM rm")
def region_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of several boxes, one over the date line."""
    return R.members(points(spark, sf_dir), _regions_of(spark))


@query(RGN + "SELECT region, node::INT node, round(mean, 9)::DOUBLE mean, round(sqrt(mean * (1 - mean)), 9) std FROM pb")
def region_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability maps of several regions over runs."""
    nodes = points(spark, sf_dir)
    return R.probability(_runs(nodes), R.members(nodes, _regions_of(spark)))


def _series_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = points(spark, sf_dir)
    return R.table(nodes, _runs(nodes), S.field_monthly(spark, sf_dir), _regions_of(spark), 0.5)[1]


@query(RGN + "SELECT region, season::INT season, t, round(v, 6) v, round(an, 6) + 0.0 an, nodes FROM ta")
def region_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series and anomalies of several regions in their windows of months."""
    return rounded(_series_of_regions(spark, sf_dir), "v", "an")


@query(RGN + ", yr AS (SELECT region, season, sum(v) total, avg(v) mean, stddev_pop(v) spread, avg(an) an, count(*) times FROM ta GROUP BY ALL) SELECT x.region, y::INT season, round(total, 6) total, round(mean, 6) mean, round(spread, 6) spread, round(an, 6) + 0.0 an, coalesce(times, 0) times FROM (SELECT DISTINCT region FROM ta) x CROSS JOIN range(1994, 2003) r(y) LEFT JOIN yr ON yr.region = x.region AND yr.season = y")
def regions_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several regions by year, windows over the year's end counted where they began."""
    return rounded(R.by_year(_series_of_regions(spark, sf_dir), 1994, 2002), "total", "mean", "spread", "an")
