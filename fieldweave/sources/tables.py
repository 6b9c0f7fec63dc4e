"""Canonical tables (field, points, events) from parquet, and from the driver's tables as stand-ins for gridded data."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import to_lon_lat, wrap_lon


def read_field(spark: SparkSession, path: str, lon: tuple[float, float] | None = None, lat: tuple[float, float] | None = None, time: tuple[str, str] | None = None) -> DataFrame:
    """(time, lat, lon, value) with longitudes in [-180, 180); ranges are filters that reach the scan. NaN becomes null."""
    df = spark.read.parquet(path)
    if time:
        df = df.filter(F.col("time").between(*time))
    if lat:
        df = df.filter(F.col("lat").between(*lat))
    df = df.withColumn("lon", wrap_lon(F.col("lon"))).withColumn("value", F.nanvl("value", F.lit(None)))
    return df.filter(F.col("lon").between(*lon)) if lon else df


def write_table(df: DataFrame, path: str, meta: dict | None = None, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet sink; run parameters go to a one-row table beside it."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    if meta is not None:
        df.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.json(path.rstrip("/") + ".meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.schema("meta string").json(path.rstrip("/") + ".meta").first()[0])


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The parquet table at path if it has been written whole, else what `make` gives, written there first: the preparation of a large field is done once."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)  # what a lost run left behind is replaced
    return spark.read.parquet(path)


def dense_ids(df: DataFrame, key: str, name: str = "node") -> DataFrame:
    """Dense numbers 0..n-1 of distinct keys in order. The keys are grid points, a bounded table."""
    return df.select(key).distinct().withColumn(name, (F.row_number().over(Window.orderBy(key)) - 1).cast("int"))


def ordered_sums(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, v): sums of doubles added one by one in the order of a column. Sums by partitions differ in their last bits from run to run, which decides ties and limits; a running sum does not, and spills."""
    w = Window.partitionBy(*keys).orderBy(order, value).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select(*keys, F.struct(F.count(F.lit(1)).over(w).alias("k"), F.sum(value).over(w).alias("v")).alias("x"))
    return run.groupBy(*keys).agg(F.max("x").alias("x")).select(*keys, "x.v")


def field_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, t, v): daily sums per user on a dense grid."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.to_date("ts").alias("t"), "value", "event_id")
    ids = dense_ids(ev, "user_id")
    grid = ids.join(ev.select("t").distinct())
    sums = ordered_sums(ev, ["user_id", "t"], "event_id", "value")
    return grid.join(sums, ["user_id", "t"], "left").select("node", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def field_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, t, v): monthly sums of quantity per supplier."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_quantity")
    return li.groupBy(F.col("l_suppkey").cast("int").alias("node"), F.trunc("l_shipdate", "month").alias("t")).agg(F.sum("l_quantity").alias("v"))


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """(node, lon, lat): golden spiral of n points."""
    i = F.col("id")
    y = 1 - 2 * i / F.lit(float(n - 1))
    r, turn = F.sqrt(1 - y * y), i * F.lit(math.pi * (3 - math.sqrt(5)))
    lon, lat = to_lon_lat(F.cos(turn) * r, y, F.sin(turn) * r)
    return spark.range(n).select(i.cast("int").alias("node"), lon.alias("lon"), lat.alias("lat"))


def event_points(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(node, t): seconds of a kind of event per user."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_type") == kind)
    return ev.select(F.col("user_id").alias("node"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t")).distinct()
