"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import chat_format, chunk_dedup, decontaminate, exact_dedup, filter_audit, language_id, lexical_search, line_dedup, mixing, ngram_join, paragraph_sketch, quality, sharding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.digests(chat_format.chat_format(rows))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_dedup.chunk_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "repeat_words", "removed_words", F.array_join(F.col("spans").cast("array<string>"), ",").alias("removed_spans"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.fingerprints(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ngram_join, op2_exact_dedup, op3_chat_format, op4_decontaminate, op5_mix_sources, op6_language_id, op7_quality_classifier, op8_shard, op9_line_dedup, op10_substring_dedup)
    own += (op11_filter_audit, op12_fingerprints, op13_lexical_search)
    return {f.__name__: f for f in own}


SQL2 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) h FROM documents),
w AS (SELECT doc_id, h, count(*) OVER (PARTITION BY h) n, first_value(doc_id) OVER (PARTITION BY h ORDER BY cp DESC, doc_id) k FROM d)
SELECT doc_id, k keep_id, n group_size, doc_id = k kept, h text_sha256 FROM w
"""

#: Targets by the same closed form (capped sources are a prefix by cap over weight); documents by the same seeded order.
SQL5 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size, md5('mix-1:' || doc_id::VARCHAR) h FROM documents),
s AS (SELECT source, sum(size)::BIGINT z, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] w, row_number() OVER (ORDER BY source NULLS LAST) i FROM d GROUP BY source),
o AS (SELECT *, (2 * z)::DOUBLE / w r, row_number() OVER (ORDER BY (2 * z)::DOUBLE / w, i) p FROM s WHERE z > 0),
c AS (SELECT *, (1.5::DOUBLE * sum(z) OVER () - coalesce(sum(2 * z) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) rate FROM o),
f AS (SELECT rate FROM c WHERE r > rate ORDER BY p LIMIT 1),
t AS (SELECT s.source, s.z, CASE WHEN s.z = 0 THEN 0.0::DOUBLE WHEN (SELECT count(*) FROM f) = 0 OR (2 * s.z)::DOUBLE / s.w <= (SELECT rate FROM f) THEN (2 * s.z)::DOUBLE ELSE (SELECT rate FROM f) * s.w END goal FROM s),
q AS (SELECT d.doc_id, d.size, t.z, t.goal, CASE WHEN t.z = 0 THEN 0 ELSE floor(t.goal)::BIGINT // t.z END times, CASE WHEN t.z = 0 THEN 0 ELSE floor(t.goal)::BIGINT % t.z END rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, z source_size, goal target, (times * size + greatest(0, least(size, rest - before)))::BIGINT taken FROM q
"""


def oracle_sql() -> dict[str, str]:
    first = {"op1_ngram_join": ngram_join.SQL, "op2_exact_dedup": SQL2, "op3_chat_format": chat_format.SQL, "op4_decontaminate": decontaminate.SQL, "op5_mix_sources": SQL5}
    return first | {"op11_filter_audit": filter_audit.SQL, "op13_lexical_search": lexical_search.SQL}
