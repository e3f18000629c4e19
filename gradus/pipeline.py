"""Whole runs: from a corpus and its concepts to a graph, and from scored pairs to a built graph with provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.operators import graph, scoring, signals
from gradus.session import Scratch


def candidate_pairs(concepts: DataFrame, aliases: DataFrame, docs: DataFrame, plausibility: float = 0.5) -> DataFrame:
    """Fused candidate pairs (src, dst, s_corr, forward) of concepts of one domain, from all signals."""
    names = signals.concept_names(concepts, aliases)
    units = docs.where("text is not null").select("domain_id", F.col("doc_id").alias("unit"), "text", F.when(F.col("source_type") == "syllabus", 3).otherwise(1).alias("w"))
    parts = signals.section_units(docs)
    own = concepts.select("domain_id", "concept_id", F.lower("canonical_name").alias("name"))
    merged = signals.merge_signals(
        signals.order_signal(signals.mentions(names, units), units),
        signals.cooccurrence_signal(signals.mentions(own, parts), parts.agg(F.count("*").alias("n"))),
        signals.definition_signal(names, concepts),
        signals.similarity_signal(concepts.where("embedding is not null").select("domain_id", "concept_id", "embedding")),
    )
    return signals.fuse(signals.prune(merged), F.lit(plausibility))


def build_graph(candidates: DataFrame, vectors: DataFrame, weights, bias: float, tau: float) -> DataFrame:
    """Edges with provenance (src, dst, conf, dropped_reason) from candidates and vectors (concept_id, embedding)."""
    scratch = Scratch(candidates.sparkSession, "build")
    u = vectors.select(F.col("concept_id").alias("src"), F.col("embedding").alias("vu"))
    v = vectors.select(F.col("concept_id").alias("dst"), F.col("embedding").alias("vv"))
    scored = scoring.bidirectional(candidates.join(u, "src").join(v, "dst"), weights, bias, tau)
    return graph.build_dag(scratch.keep(scoring.oriented(scored)), tau)


def layers(built: DataFrame) -> DataFrame:
    """(node, depth, cluster) of the edges that a built graph keeps."""
    edges = Scratch(built.sparkSession, "layers").keep(built.where("dropped_reason is null").select("src", "dst", "conf"))
    return graph.depths(edges).join(graph.communities(edges), "node")
