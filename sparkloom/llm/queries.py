"""Queries of the training-data operators, by problem number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from . import conversations, languages, mixing, near_duplicates, nearest, packing, split_chunks, subjects


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(_table(spark, d, "documents"), _table(spark, d, "subject_areas"), _table(spark, d, "subject_labels"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_shares(_subjects(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split_chunks.oversized_ids(_table(spark, d, "chunks"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_chunks.split_oversized(_table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_table(spark, d, "chunks")).select("chunk_id_a", "chunk_id_b")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    _, verdicts = conversations.thread_conversations(_table(spark, d, "messages"), _table(spark, d, "conversations"))
    return verdicts.where("reason IS NOT NULL").select("conversation_id")


def p4_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.ordered_conversations(_table(spark, d, "messages"), _table(spark, d, "conversations"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    collections = {
        "chunk_vectors": (_table(spark, d, "chunk_vectors"), "chunk_id", "vector"),
        "semantic_cache": (_table(spark, d, "semantic_cache"), "cache_id", "query_embedding"),
    }
    return nearest.similar_pairs(collections).select("collection", "id_a", "id_b")


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    table = _table(spark, d, "chunk_vectors")
    asked = table.where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("id"))
    return nearest.nearest(table, "chunk_id", "vector", recall=0.95, queries=asked)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(_table(spark, d, "documents")))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(_packed(spark, d))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    counts = packing.token_counts(_table(spark, d, "documents"), carry=("source",))
    return mixing.mix_sources(counts, _table(spark, d, "source_targets"))


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(materialize(_mixed(spark, d), "mixed"), _table(spark, d, "source_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    segments = languages.language_segments(_table(spark, d, "documents"), _table(spark, d, "lang_codes"))
    return languages.language_findings(materialize(segments, "segments"))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    segments = languages.language_segments(_table(spark, d, "documents"), _table(spark, d, "lang_codes"))
    return languages.document_languages(segments)


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_shares, p2_found, p2_pieces, p3_found, p4_found, p4_conversations, p5_found, p5_nearest,
        p6_packed, p6_report, p7_mixed, p7_report, p8_found, p8_languages,
    )
}
