"""Lineage cuts of iterative operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_AT_EXIT: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or, with a local master alone, one made for the purpose. What an application has put there goes when its Python ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    path = f"{sc.getCheckpointDir()}/settled"
    if path not in _AT_EXIT:
        _AT_EXIT.add(path)

        def clear() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone before
                _delete(spark, path)

        atexit.register(clear)
    return path


def settle(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the plan starts anew, and lost executors lose nothing. A task holds a row group when it writes and at most one when it reads, so rows that are long
    lists are given smaller ones (group_bytes)."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}.parquet"
    (df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables of settle() that nothing reads any more."""
    for df in tables:
        if df is not None:
            _delete(df.sparkSession, df.settled_at)
