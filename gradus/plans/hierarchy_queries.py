"""Queries of the hierarchy operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators.hierarchy import hierarchy
from gradus.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    forest = hierarchy(table(spark, d, "concept_nodes"))
    return forest.nodes.select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    forest = hierarchy(table(spark, d, "concept_nodes"))
    return forest.paths().select(F.col("node").alias("node_id"), F.array_join("path", "/").alias("path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    forest = hierarchy(table(spark, d, "concept_nodes"))
    return forest.descendants().select(F.col("ancestor").alias("ancestor_id"), F.col("node").alias("node_id"), "steps")


_LINKS = r"""
valid AS (
    SELECT node_id, nullif(regexp_replace(parent_id, '^\s+|\s+$', '', 'g'), '') AS named, children_ids FROM concept_nodes
    WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC NULLS LAST) = 1
), listed AS (
    SELECT child, min(node_id) AS lister FROM (SELECT node_id, unnest(children_ids) AS child FROM valid) WHERE child IS NOT NULL GROUP BY child
), linked AS (
    SELECT v.node_id, coalesce(v.named, l.lister) AS parent FROM valid v LEFT JOIN listed l ON l.child = v.node_id
), links AS (
    SELECT k.node_id, p.node_id AS parent FROM linked k LEFT JOIN valid p ON p.node_id = k.parent
), down AS (
    SELECT node_id, node_id AS root_id, 0 AS depth, node_id AS path FROM links WHERE parent IS NULL
    UNION ALL
    SELECT l.node_id, d.root_id, d.depth + 1, d.path || '/' || l.node_id FROM down d JOIN links l ON l.parent = d.node_id
)
"""

QUERIES = {f.__name__: f for f in (p4_found, p4_paths, p4_descendants)}
SQL = {
    "p4_found": f"WITH RECURSIVE {_LINKS} SELECT l.node_id, coalesce(d.root_id, '') AS root_id, coalesce(d.depth, -1) AS depth FROM links l LEFT JOIN down d USING (node_id)",
    "p4_paths": f"WITH RECURSIVE {_LINKS} SELECT node_id, path FROM down",
    "p4_descendants": f"""WITH RECURSIVE {_LINKS}, up AS (
        SELECT d.node_id, l.parent AS ancestor_id, 1 AS steps FROM down d JOIN links l USING (node_id) WHERE l.parent IS NOT NULL
        UNION ALL
        SELECT u.node_id, l.parent, u.steps + 1 FROM up u JOIN links l ON l.node_id = u.ancestor_id WHERE l.parent IS NOT NULL
    ) SELECT ancestor_id, node_id, steps FROM up""",
}
