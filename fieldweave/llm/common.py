"""What the training-data operators share: lineage cuts, checked broadcasts, whole-text batches and a distributed union-find."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few longs that may be broadcast: a hashed relation of them stays under about 100 MB.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster names its shared folder in spark.checkpoint.dir; only where that is unset and the master local (tests) is one made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise once, as a table in the shared folder: lost executors lose nothing, later reads prune columns, and plans start from true sizes
    (statistics of a checkpoint() multiply along joins)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def uncut(*tables: DataFrame | None) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for df in tables:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are done with: it does so when their objects are collected."""
    gc.collect()
    spark._jvm.System.gc()


def maybe_broadcast(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow, already materialised table for broadcast if its row count is small; else Spark shuffles it."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def dealt_join(left: DataFrame, right: DataFrame, key: str, by: list[str], how: str = "inner", parts: int = 1000) -> DataFrame:
    """left joined with right, a materialised table (key, n, ...) of distinct keys where n counts the key's rows on the left.

    A small right side is broadcast. Else a key of over 1/parts of the rows counted is hot: its left rows are dealt by a hash of `by` to as many parts as it has such
    shares, and its right row is copied to each. Fewer than `parts` keys can be hot, so their table may be broadcast. n does not come out."""
    rows, total = right.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop("n")), key, how)
    share = total // parts + 1
    hot = F.broadcast(right.filter(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("__parts")))
    zero = F.lit(0).cast("long")
    some = left.join(hot, key, "left").withColumn("__part", F.when(F.col("__parts").isNull(), zero).otherwise(F.pmod(F.xxhash64(*by), F.col("__parts").cast("long")))).drop("__parts")
    copies = right.drop("n").join(hot, key, "left").withColumn("__part", F.explode(F.sequence(zero, F.coalesce(F.col("__parts").cast("long") - 1, zero)))).drop("__parts")
    return some.join(copies, [key, "__part"], how).drop("__part")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut Arrow batches by text bytes, so that what Python builds from a slice stays small; one long text is one slice."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        start = size = 0
        for i in range(batch.num_rows):
            own = len(texts[i].as_buffer()) if texts[i].is_valid else 0
            if i > start and size + own > most_bytes:
                yield batch.slice(start, i - start), texts.slice(start, i - start).to_pylist()
                start, size = i, 0
            size += own
        if batch.num_rows > start:
            yield batch.slice(start), texts.slice(start).to_pylist()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for the undirected links (a, b) of longs; root is the smallest node of the component. Nodes without links are absent.

    Alternating large-star and small-star (Kiveris et al. 2014): every step is a min-aggregate, which combines before the shuffle, and a join,
    so neither links nor components gather in one task or on the driver. Nulls and loops are dropped."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    stamp = None
    for _ in range(rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        last, now = now, cut(small.distinct())
        uncut(last)
        del both, least, large, low, small
        tidy(edges.sparkSession)
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(seen) == stamp:
            break
        stamp = tuple(seen)
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
