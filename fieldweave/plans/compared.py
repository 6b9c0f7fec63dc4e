"""Queries of runs compared, of places and of what regions send and share. Importing this module registers them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import community, levels, surrogate
from ..operators import field as T
from ..operators import graph as G
from ..operators import runs as R
from ..operators.lineage import folder
from ..sources import tables as S
from .registry import BASE, EV, LEN, R2, hav, network, points, query, rounded, streamed

#: Groups of four runs by rule; runs 3 and 4 have a level more.
RUNS = BASE + ", lv AS (SELECT run, level, node, (node // run) % (9 // (level + 1)) grp FROM pts, range(1, 5) r(run), range(4) l(level) WHERE level < 3 OR run > 2), up AS (SELECT run, node, grp, (max(level) OVER (PARTITION BY run) - level)::INT up FROM lv) "


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = points(spark, sf_dir).join(spark.range(1, 5).withColumnRenamed("id", "run")).join(spark.range(4).withColumnRenamed("id", "level")).filter("level < 3 OR run > 2")
    grp = F.pmod(F.floor(F.col("node") / F.col("run")), F.floor(F.lit(9) / (F.col("level") + 1)))
    return levels.select("run", "level", "node", grp.alias("grp"))


@query(RUNS + f""", pl AS (SELECT n_nationkey place, -180 + n_nationkey * 14.0 lon, -60 + n_nationkey * 5.0 lat FROM nation WHERE n_nationkey % 5 = 0),
pn AS (SELECT place, arg_min(p.node, row(round({hav('pl', 'p')}, 12), p.node)) node FROM pl, pts p GROUP BY place),
mem AS (SELECT pn.place, x.run, x.up, x.node FROM pn JOIN up o ON o.node = pn.node JOIN up x ON x.run = o.run AND x.up = o.up AND x.grp = o.grp WHERE o.up < 2),
w AS (SELECT pow((SELECT count(*) FROM e) / (SELECT n FROM size)::DOUBLE, -1.0 / 6) * 0.25 w),
kk AS (SELECT a.node q, b.node, {hav('a', 'b')} d, w FROM pts a, pts b, w),
su AS (SELECT place, run, up, kk.node, sum(exp(-pow(d / w, 2) / 2)) x FROM mem JOIN kk ON kk.q = mem.node AND d <= least(6 * w, pi()) GROUP BY ALL),
de AS (SELECT *, x / max(x) OVER (PARTITION BY place, run, up) density FROM su),
nr AS (SELECT place, up, count(DISTINCT run) runs FROM mem GROUP BY ALL)
SELECT place, up, node::INT node, round(sum(density) / runs, 7) + 0.0 mean, round(sqrt(greatest(sum(density * density) / runs - pow(sum(density) / runs, 2), 0)), 5) + 0.0 std, runs FROM de JOIN nr USING (place, up) GROUP BY place, up, node, runs""")
def runs_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the groups of five places lie in four runs, at the two highest levels: mean and spread of their densities."""
    nodes, edges = streamed(spark, sf_dir)
    places = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("place"), (F.col("n_nationkey") * 14.0 - 180).alias("lon"), (F.col("n_nationkey") * 5.0 - 60).alias("lat"))
    width = R.scott_width(nodes.count(), edges.count(), 0.25)
    return rounded(rounded(R.compared(nodes, _runs(spark, sf_dir), places, 2, width), "mean", places=7), "std", places=5)


@query(RUNS + ", k AS (SELECT a.up, a.run a, b.run b, (a.grp = b.grp)::INT ab, (a.grp = a2.grp)::INT ta, (b.grp = b2.grp)::INT tb FROM up a JOIN up b ON a.up = b.up AND a.node = b.node AND a.run < b.run JOIN up a2 ON a2.up = a.up AND a2.run = a.run AND a2.node > a.node JOIN up b2 ON b2.up = b.up AND b2.run = b.run AND b2.node = a2.node WHERE a.up < 3) SELECT up, a, b, (SELECT n FROM size) nodes, round(avg((ta = tb)::INT), 9) rand FROM k GROUP BY up, a, b")
def runs_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rand's index of every two runs at the three highest levels."""
    return rounded(R.agreement(R.last_levels(_runs(spark, sf_dir), 3)), "rand", places=9)


@query(BASE + f""", rn AS (SELECT run, node, (node * run) % 4 grp FROM pts, range(1, 6) r(run)), pl AS (SELECT n_nationkey place, -180 + n_nationkey * 14.0 lon, -60 + n_nationkey * 5.0 lat FROM nation),
pn AS (SELECT DISTINCT arg_min(p.node, row(round({hav('pl', 'p')}, 12), p.node)) node FROM pl, pts p GROUP BY place),
kc AS (SELECT run, grp, count(*) c FROM rn JOIN pn USING (node) GROUP BY run, grp), k AS (SELECT run, arg_min(grp, row(-c, grp)) grp FROM kc GROUP BY run),
pm AS (SELECT rn.node, round(avg((rn.grp = k.grp)::INT), 9) mean FROM rn JOIN k USING (run) GROUP BY rn.node)
SELECT lim::DOUBLE AS "limit", node::INT node, mean FROM pm, (VALUES (0.3), (0.5), (0.95)) l(lim) WHERE mean > lim""")
def prob_map_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are with the nodes nearest to 25 places in more than a share of the runs, for three shares."""
    nodes = points(spark, sf_dir)
    places = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("place"), (F.col("n_nationkey") * 14.0 - 180).alias("lon"), (F.col("n_nationkey") * 5.0 - 60).alias("lat"))
    runs = nodes.join(spark.range(1, 6).withColumnRenamed("id", "run")).select("run", "node", (F.col("node") * F.col("run") % 4).alias("grp"))
    return levels.sure_at(community.probability_map(runs, R.nodes_at(nodes, places).select("node").distinct()), (0.3, 0.5, 0.95))


def _counted(ahead: str, behind: str, way: str) -> str:
    return f"SELECT '{way}' way, a.t, count(*) n FROM x a JOIN x b ON a.node % 2 = {ahead} AND b.node % 2 = {behind} AND a.t > b.t AND a.t - b.t <= 3 GROUP BY a.t"


SYNCED = EV + f""", x AS (SELECT node, date_diff('day', DATE '1970-01-01', t) t FROM ev WHERE event = 1), dd AS (SELECT DISTINCT date_diff('day', DATE '1970-01-01', t) t FROM f),
sy AS ({_counted('0', '1', 'a_after_b')} UNION ALL {_counted('1', '0', 'b_after_a')}),
de AS (SELECT way, dd.t, coalesce(n, 0)::DOUBLE v FROM (VALUES ('a_after_b'), ('b_after_a')) wy(way) CROSS JOIN dd LEFT JOIN sy USING (way, t)),
ro AS (SELECT way, t, round(CASE WHEN count(v) OVER w < 3 THEN 0 ELSE avg(v) OVER w END, 9) v FROM de WINDOW w AS (PARTITION BY way ORDER BY t ROWS 2 PRECEDING)),
lm AS (SELECT way, round(quantile_cont(v, 0.9), 9) lim FROM ro GROUP BY way),
nb AS (SELECT *, lag(v) OVER w p, lead(v) OVER w nx FROM ro WINDOW w AS (PARTITION BY way ORDER BY t))
"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ev = T.events(S.field_daily(spark, sf_dir), 0.9).withColumn("t", F.datediff("t", F.lit("1970-01-01")))
    on = ev.filter("event = 1")
    return on.filter("node % 2 = 0").select("node", "t"), on.filter("node % 2 = 1").select("node", "t"), ev.select("t")


@query(SYNCED + "SELECT way, t::INT t, round(v, 6) + 0.0 v, coalesce(v > p AND v > nx AND v > lim, false) peak FROM nb JOIN lm USING (way)")
def es_sync_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extreme days of two regions that follow each other within three days, both ways, as means over three days with their peaks."""
    return rounded(surrogate.sync_times(*_halves(spark, sf_dir), 3, 0.9, mean_of=3), "v")


@query(BASE + ", w AS (SELECT node, t, CASE WHEN month(t) >= 11 OR month(t) <= 2 THEN v ELSE 0 END v FROM m), qs AS (SELECT node, quantile_cont(v, 0.8) q FROM w WHERE v >= 1 GROUP BY node) SELECT w.node::INT node, t, CASE WHEN v > q AND v >= 15 THEN 1 ELSE 0 END event FROM w LEFT JOIN qs ON w.node = qs.node")
def events_month_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a season over the year's end: all months stay, those outside count as zero."""
    return T.events(T.month_window(S.field_monthly(spark, sf_dir), 11, 2), 0.8)


@query(BASE + f", x AS (SELECT * FROM g WHERE src IN ({R2}) AND weight >= (SELECT quantile_cont(weight, 0.6) FROM g)), c AS (SELECT node, count(*) n FROM (SELECT unnest([src, dst]) node FROM x) GROUP BY node) SELECT p.node::INT node, p.node IN ({R2}) source, p.node IN (SELECT dst FROM x) target, coalesce(n, 0) n FROM pts p LEFT JOIN c ON c.node = p.node")
def region_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the strong links of a region lead: its nodes, their targets and counts of ends."""
    nodes, edges = network(spark, sf_dir, True)
    found = G.region_links(nodes, edges, (20, 160), (-60, 60), "weight", 0.6)
    s, t = found.sources.withColumn("source", F.lit(True)), found.targets.withColumn("target", F.lit(True))
    every = nodes.select("node").join(s, "node", "left").join(t, "node", "left").join(found.counts, "node", "left")
    return every.select("node", F.coalesce("source", F.lit(False)).alias("source"), F.coalesce("target", F.lit(False)).alias("target"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(LEN + "SELECT src::INT src, dst::INT dst, round(len, 4) length FROM l WHERE weight >= (SELECT quantile_cont(weight, 0.7) FROM e)")
def link_length_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the links in the upper quantile of another attribute."""
    nodes, edges = streamed(spark, sf_dir)
    return rounded(G.lengths(nodes, G.edges_quantile(edges, "weight", 0.7)), "length", places=4).select("src", "dst", "length")


@query(BASE + "SELECT node::INT node, t, round(v, 6) + 0.0 v FROM f")
def field_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prepared field: made and written by the first reader, found by the second."""
    path, made = f"{folder(spark)}/{uuid.uuid4().hex}.parquet", []

    def make() -> DataFrame:
        made.append(path)
        return rounded(S.field_daily(spark, sf_dir), "v").select("node", "t", "v")

    S.read_through(spark, path, make)
    out = S.read_through(spark, path, make)
    if len(made) != 1:
        raise RuntimeError("the field was made again")
    return out
