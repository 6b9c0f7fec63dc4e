"""Transforms of a field (node, t, v): anomalies, trends, windows, means. All but the shuffle by node stay in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def anomalies(field: DataFrame, group: Column) -> DataFrame:
    """v minus its climatology: the mean over equal calendar positions."""
    return field.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("node", group)))


def detrend(field: DataFrame, x: Column) -> DataFrame:
    """Residuals of the least-squares line per node."""
    w = Window.partitionBy("node")
    f = field.withColumn("x", x.cast("double"))
    mx, my = F.avg("x").over(w), F.avg("v").over(w)
    f = f.withColumn("dx", F.col("x") - mx).withColumn("dy", F.col("v") - my)
    slope = F.try_divide(F.sum(F.col("dx") * F.col("dy")).over(w), F.sum(F.col("dx") * F.col("dx")).over(w))
    return f.withColumn("v", F.col("dy") - F.coalesce(slope, F.lit(0.0)) * F.col("dx")).drop("x", "dx", "dy")


def month_window(field: DataFrame, first: int, last: int) -> DataFrame:
    """Zero outside the months, which may wrap over the year's end."""
    m = F.month("t")
    inside = m.between(first, last) if first <= last else (m >= first) | (m <= last)
    return field.withColumn("v", F.when(inside, F.col("v")).otherwise(0.0))


def rolling_mean(field: DataFrame, n: int) -> DataFrame:
    """Trailing mean; 0 until n values are there."""
    w = Window.partitionBy("node").orderBy("t").rowsBetween(-(n - 1), 0)
    return field.withColumn("v", F.when(F.count("v").over(w) < n, 0.0).otherwise(F.avg("v").over(w)))


def time_mean(field: DataFrame, unit: str) -> DataFrame:
    return field.groupBy("node", F.trunc("t", unit).alias("t")).agg(F.avg("v").alias("v"))


def standardise(field: DataFrame) -> DataFrame:
    """z-scores; nodes without variance are left out."""
    w = Window.partitionBy("node")
    f = field.withColumn("m", F.avg("v").over(w)).withColumn("s", F.stddev_pop("v").over(w)).filter("s > 0")
    return f.select("node", "t", ((F.col("v") - F.col("m")) / F.col("s")).alias("z"))


def average_ranks(field: DataFrame) -> DataFrame:
    """v replaced by its rank in the node's series, ties sharing the mean rank."""
    rank = F.rank().over(Window.partitionBy("node").orderBy("v")) + (F.count("v").over(Window.partitionBy("node", "v")) - 1) / 2
    return field.select("node", "t", rank.alias("v"))


def quantiles(field: DataFrame, q: float, at_least: float = 0.0) -> DataFrame:
    return field.filter(F.col("v") >= at_least).groupBy("node").agg(F.expr(f"percentile(v, {q})").alias("q"))


def events(field: DataFrame, q: float, at_least: float = 1.0, extreme: float = 15.0) -> DataFrame:
    """(node, t, event): 1 above the node's quantile of values >= at_least, and >= extreme."""
    e = field.join(quantiles(field, q, at_least), "node", "left")
    return e.select("node", "t", F.when((F.col("v") > F.col("q")) & (F.col("v") >= extreme), 1).otherwise(0).alias("event"))


def event_mask(ev: DataFrame, more_than: int) -> DataFrame:
    return ev.groupBy("node").agg((F.sum("event") > more_than).cast("int").alias("mask"))


def shuffled(field: DataFrame, windows: tuple[tuple[int, int], ...] = ((1, 12),), years: tuple[int, int] | None = None, rest_zero: bool = False, full: bool = False, seed: int = 0) -> DataFrame:
    """Each node's values permuted within each year's window of months, so that a year keeps its events; a window that wraps takes its last months from the next year. Times outside of all windows (and
    of the years, first and last included) keep their values or become 0. full: permuted over all times.

    The order is that of md5(seed:node:t), so any engine can repeat it; the values in time order and in hash order are matched rank by rank, which is a permutation. A window's values of a node are a group."""
    if len(windows) > 1 and rest_zero:
        raise ValueError("with several windows the rest cannot be 0")
    months = [m for a, b in windows for m in (range(a, b + 1) if a <= b else [*range(a, 13), *range(1, b + 1)])]
    if len(set(months)) < len(months):
        raise ValueError("windows overlap")
    m, y = F.month("t"), F.year("t")
    part = F.lit(None).cast("string")
    for k, (a, b) in enumerate(windows):
        year = F.when(m.between(a, b), y) if a <= b else F.when(m >= a, y).when(m <= b, y - 1)
        inside = year.isNotNull() if years is None else year.between(*years)
        part = F.when(inside, F.concat_ws(":", F.lit(k), year)).otherwise(part)
    f = field.select("node", "t", "v", (F.lit("all") if full else part).alias("part"))
    order = F.struct(F.md5(F.concat_ws(":", F.lit(seed), "node", F.col("t").cast("string"))).alias("h"), "v")
    groups = f.filter("part IS NOT NULL").groupBy("node", "part").agg(F.array_sort(F.collect_list("t")).alias("t"), F.array_sort(F.collect_list(order)).alias("x"))
    mixed = groups.select("node", F.explode(F.arrays_zip("t", "x")).alias("z")).select("node", "z.t", "z.x.v")
    rest = f.filter("part IS NULL").select("node", "t", F.lit(0).cast(field.schema["v"].dataType).alias("v") if rest_zero else F.col("v"))
    return mixed.unionByName(rest)


def shuffle_years(field: DataFrame, seed: int = 0) -> DataFrame:
    """Each node's values permuted within each year."""
    return shuffled(field, seed=seed)


def defined(field: DataFrame, always: bool = True) -> DataFrame:
    """The field without the points that lack a value at some time (or, unless `always`, at all times); a NaN is a lack."""
    lacks = F.col("v").isNull() | F.isnan("v")
    per = field.groupBy("node").agg(F.max(lacks.cast("int")).alias("some"), F.min(lacks.cast("int")).alias("all"))
    return field.join(per.filter(F.col("some" if always else "all") == 1).select("node"), "node", "left_anti")


def joined(fields: dict[str, DataFrame]) -> DataFrame:
    """(node, t, name, v): several variables of one grid. Those that lack points of the first are refused."""
    out, first = None, None
    for name, f in fields.items():
        nodes = f.select("node").distinct()
        if first is not None and not first.join(nodes, "node", "left_anti").isEmpty():
            raise ValueError(f"{name} lacks points of the grid")
        first = nodes if first is None else first
        part = f.select("node", "t", F.lit(name).alias("name"), F.col("v").cast("double").alias("v"))
        out = part if out is None else out.unionByName(part)
    return out


def run_stats(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation and upper quantiles of a value over runs."""
    q = F.percentile(value, F.array(*map(F.lit, (0.9, 0.95, 0.99, 0.995, 0.999))))
    return runs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), q.alias("q")).select(*keys, "mean", "std", *(F.col("q")[i].alias(n) for i, n in enumerate(("p90", "p95", "p99", "p995", "p999"))))


def year_counts(times: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """(key, y, n): how many times of each key fall in each year, zero where none does."""
    grid = times.select(key).distinct().withColumn("y", F.explode(F.sequence(F.lit(first), F.lit(last))))
    n = times.groupBy(key, F.year("t").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, [key, "y"], "left").select(key, "y", F.coalesce("n", F.lit(0)).alias("n"))
