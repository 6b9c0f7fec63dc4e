"""Exact dedup: group by a 128-bit content hash, keep one row by a stable rule, compare bytes inside groups.

Cases: null text counts as empty, and empty texts are equal; repeated rows are rows of their own (the same id may stay and go once each way,
so a repeated id is kept or dropped as a whole); a null id sorts after all others; an empty table gives an empty result. Only doc_id and text are read,
so other columns cannot clash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt_join, maybe_broadcast, uncut

#: The characters [\x20\x09-\x0D] that normalising deletes.
BLANKS = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    1. A narrow aggregate by hash (16 bytes, combined before the shuffle, so a hot text is one row per task) finds sizes and the row that stays.
    2. Only rows of groups of two or more then carry their text: least and greatest text of a hash are equal exactly if all bytes are.
    3. Hashes whose bytes differ (collisions) are grouped once more by hash and text.
    Rows of a hash with many copies are dealt to parts in the joins of 1 and 2."""
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("cp"))
    rows = base.select("id", "cp", digest(F.col("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"), "norm")
    first = F.struct(-F.col("cp"), F.col("id").isNull(), F.col("id"))

    def grouped(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("best")).select(*keys, "group_size", F.col("best.id").alias("keep_id"))

    groups = cut(grouped(rows, "h"))
    sized = groups.withColumn("n", F.col("group_size"))
    many = sized.filter("group_size > 1").select("h", "n")
    suspects = dealt_join(rows.select("id", "cp", "h", "norm"), many, "h", ["id", "cp"], "left_semi").groupBy("h").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).filter("lo <> hi").select("h")
    collided = cut(suspects)
    n_collided = collided.count()
    plain = rows.drop("norm")
    if not n_collided:
        uncut(collided)
        out = dealt_join(plain, sized, "h", ["id", "cp"])
    else:
        clash = rows.join(maybe_broadcast(collided, n_collided), "h", "left_semi")
        apart = clash.join(grouped(clash, "h", "norm"), ["h", "norm"]).drop("norm")
        out = dealt_join(plain.join(maybe_broadcast(collided, n_collided), "h", "left_anti"), sized, "h", ["id", "cp"]).unionByName(apart)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, all columns."""
    stay = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("__stay")).distinct()
    return docs.join(stay, F.col(id_col).eqNullSafe(F.col("__stay")), "left_semi")
