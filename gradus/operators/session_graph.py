"""Learner graphs: from clusters, concepts and edges to a tree of nodes with edges, its payload and back, and its rebuilding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.text import slug

NODE = "struct<node:string,label:string,status:string,node_type:string,parent:string,depth:int>"
EDGE = "struct<src:string,dst:string,kind:string,conf:double>"


def hierarchy_nodes(goals: DataFrame, clusters: DataFrame, concepts: DataFrame) -> DataFrame:
    """(session, node, label, status, node_type, parent, depth): the root of each session, a branch for each cluster, a leaf for each concept.

    ``goals``: (session, goal); ``clusters``: (session, cluster, name); ``concepts``: (session, node, label, cluster, depth). A
    concept without cluster counts to cluster 0, and one whose cluster has no branch hangs at the root; depth null is 2. The first
    leaf (by node) of at most depth 1 is available, or the first leaf of all if there is none; other leaves are locked.
    """
    root = goals.select("session", slug(F.col("goal")).alias("node"), F.col("goal").alias("label"), F.lit("in_progress").alias("status"), F.lit("root").alias("node_type"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    tops = goals.select("session", slug(F.col("goal")).alias("root"))
    names = clusters.groupBy("session", "cluster").agg(F.min("name").alias("name"))
    branch = names.join(tops, "session").select("session", F.concat(F.lit("cluster_"), F.col("cluster").cast("string")).alias("node"), F.col("name").alias("label"), F.lit("available").alias("status"), F.lit("branch").alias("node_type"), F.col("root").alias("parent"), F.lit(1).alias("depth"))
    own = concepts.groupBy("session", "node").agg(F.min(F.struct("label", F.coalesce("cluster", F.lit(0)).alias("cluster"), F.coalesce("depth", F.lit(2)).alias("depth"))).alias("m")).select("session", F.col("node").cast("string").alias("node"), "m.*")
    first = own.groupBy("session").agg(F.min(F.struct(F.col("depth") > 1, "node")).alias("f")).select("session", F.col("f.node").alias("first"))
    placed = own.join(names.select("session", "cluster", F.lit(True).alias("has")), ["session", "cluster"], "left").join(tops, "session").join(first, "session")
    parent = F.when(F.col("has"), F.concat(F.lit("cluster_"), F.col("cluster").cast("string"))).otherwise(F.col("root"))
    leaf = placed.select("session", "node", "label", F.when(F.col("node") == F.col("first"), "available").otherwise("locked").alias("status"), F.lit("leaf").alias("node_type"), parent.alias("parent"), F.col("depth").cast("int").alias("depth"))
    return root.unionByName(branch).unionByName(leaf)


def hierarchy_edges(nodes: DataFrame, prerequisites: DataFrame) -> DataFrame:
    """(session, src, dst, kind, conf): an edge from each parent, and the prerequisites (session, src, dst, conf) between nodes of the session."""
    tree = nodes.where("parent is not null").select("session", F.col("parent").alias("src"), F.col("node").alias("dst"), F.lit("hierarchy").alias("kind"), F.lit(1.0).alias("conf"))
    ids = nodes.select("session", "node")
    p = prerequisites.select("session", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("prerequisite").alias("kind"), F.coalesce("conf", F.lit(1.0)).alias("conf"))
    p = p.join(ids.withColumnRenamed("node", "src"), ["session", "src"], "left_semi").join(ids.withColumnRenamed("node", "dst"), ["session", "dst"], "left_semi")
    return tree.unionByName(p.select(tree.columns))


def to_payload(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session, payload): each session's graph as one JSON document, nodes and edges in the order of their ids; one learner's graph, not a table."""
    n = nodes.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("node", "label", "status", "node_type", "parent", "depth"))).alias("nodes"))
    e = edges.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "kind", "conf"))).alias("edges"))
    return n.join(e, "session", "left").select("session", F.to_json(F.struct("nodes", F.coalesce("edges", F.array().cast(f"array<{EDGE}>")).alias("edges"))).alias("payload"))


def from_payload(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the documents of ``to_payload``."""
    p = payloads.select("session", F.from_json("payload", f"nodes array<{NODE}>, edges array<{EDGE}>").alias("p"))
    return p.select("session", F.inline("p.nodes")), p.select("session", F.inline("p.edges"))


def rebuilt(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node, label, status, remediation, last_review, stability) of a graph built anew over an existing one.

    ``new``: (node, label, status); ``old``: all six columns. Remediation nodes of the old graph stay; nodes in both keep their
    last review and stability, but take the new label and status; other old nodes go.
    """
    state = old.select("node", "last_review", "stability")
    fresh = new.join(state, "node", "left").select("node", "label", "status", F.lit(False).alias("remediation"), "last_review", "stability")
    kept = old.where("remediation").join(new.select("node"), "node", "left_anti").select(fresh.columns)
    return fresh.unionByName(kept)


def remediation_progress(successes: DataFrame, required: int = 1) -> DataFrame:
    """(rm, n, resolved): successful reviews of each remediation node (one row each), and whether they are enough."""
    return successes.groupBy("rm").agg(F.count("*").alias("n")).withColumn("resolved", F.col("n") >= required)


def first_attempts(reviews: DataFrame, *keys: str) -> DataFrame:
    """(keys, accuracy): share of learners whose first answer (user_id, ts, event_id, correct) was right."""
    w = Window.partitionBy(*keys, "user_id").orderBy("ts", "event_id")
    first = reviews.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return first.groupBy(*keys).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
