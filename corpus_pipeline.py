"""From raw documents to shards: language ID, near-duplicate removal, benchmark decontamination, source mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of documents.

Cases, in all stages: rows count, not ids, so rows with null or repeated ids are judged by their own text; equal rows are treated alike, but that one of them stays in near_duplicates;
null texts go in language; an empty table gives an empty one; further columns pass through under their names (those that start with two underscores are the stages' own)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import decontaminate, language_id, mixing, ngram_join, sharding
from fieldweave.llm.common import cut
from fieldweave.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text or no letter) go."""
    ship(spark)
    return language_id.predict(docs, language_id.train(docs)).filter(F.col("__lang") != language_id.UNDETERMINED).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle near duplicates (similarity 0.8 or more) stays, that with the smallest id."""
    ship(spark)
    return ngram_join.keep_one(docs, n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    ship(spark)
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)
    return found.filter("__n_hit = 0").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the part that a quota cuts off counts as a whole from one half on."""
    ship(spark)
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    seed = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))  # id and content, so that the mix does not depend on the partitions
    taken = mixing.mix(rows.withColumn("__seed", seed), id_col="__row", seed_col="__seed").select(F.col("__row").alias("__at"), "size", "taken")
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return rows.join(taken.select("__at", copies.alias("__n")).filter("__n > 0"), F.col("__row") == F.col("__at")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, shard and place in it."""
    ship(spark)
    return sharding.shard(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("shards", shards)]

#: Cross-parsing against automata has no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is materialised in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
