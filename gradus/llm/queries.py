"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import bpe, canonical, grouping, neighbours, overlap, packing, pii
from gradus.sources.tables import table, wide_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_aliases(table(spark, d, "concept_aliases"), table(spark, d, "concepts")).select("alias_id", "concept_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Mapped and unmatched aliases by origin."""
    aliases = table(spark, d, "concept_aliases")
    mapped = canonical.map_aliases(aliases, table(spark, d, "concepts"))
    origin = aliases.where("concept_id is null").groupBy("alias_id").agg(F.min("origin").alias("origin"))
    return mapped.join(origin, "alias_id").groupBy("origin").agg(F.count("*").alias("n_aliases"), F.count_if(F.col("concept_id") == 0).alias("n_unmatched"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return grouping.connected_groups(table(spark, d, "merge_pairs"), "left_id", "right_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(*overlap.split_overlaps(table(spark, d, "gold_pairs")))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(*overlap.split_overlaps(table(spark, d, "gold_pairs")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.nearest(table(spark, d, "concepts"), "concept_id", "embedding"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(wide_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(wide_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "context_windows"), "window_id", "capacity_tokens")


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    return packing.invariants(p7_packed(spark, d), table(spark, d, "context_windows"), "window_id", "capacity_tokens", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_items(wide_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(wide_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_report, p2_found, p3_found, p3_report, p5_found, p6_ids, p7_packed, p7_invariants, p8_found, p8_redacted)}
SQL: dict[str, str] = {
    "p2_found": """WITH RECURSIVE l AS (
        SELECT left_id AS a, right_id AS b FROM merge_pairs WHERE left_id <> right_id UNION SELECT right_id, left_id FROM merge_pairs WHERE left_id <> right_id
    ), p AS (SELECT a, b FROM l UNION SELECT p.a, l.b FROM p JOIN l ON l.a = p.b)
    SELECT a AS record_id, min(b) AS group_id FROM p GROUP BY a""",
}
