"""Queries of the graph operators over gold pairs and concepts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.functions.columns import r6
from gradus.operators import graph, scoring
from gradus.operators.blocks import cosine_pairs
from gradus.plans import scoring_queries as sq
from gradus.session import Scratch

TAU = 0.3


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Positive gold pairs as edges, with the model's score as confidence; may have cycles."""
    pairs = sq._pairs(spark, d).where("label = 1").select("src", "dst", "vu", "vv").distinct()
    return pairs.select("src", "dst", r6(scoring.linear_score(sq.cx.direction_feature(F.col("vu"), F.col("vv")), sq._weights(), sq.BIAS)).alias("conf"))


def _acyclic(spark: SparkSession, d: str) -> DataFrame:
    """The same edges, all from the smaller to the larger id, with the larger confidence of two directions."""
    e = _edges(spark, d).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("conf").alias("conf"))
    return Scratch(spark, "edges").keep(e)


def _clusters(spark: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    c = sq.table(spark, d, "concepts").groupBy(F.col("concept_id").alias("node")).agg(F.min("cluster_no").alias("cluster"))
    return graph.nodes_of(edges).join(c, "node", "left")


def q_threshold_split(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).withColumn("bucket", F.when(F.col("conf") >= TAU, "kept").otherwise("dropped"))
    return e.groupBy("bucket").agg(F.count("*").alias("n"), r6(F.sum("conf")).alias("sum_conf"))


def q_closure(spark: SparkSession, d: str) -> DataFrame:
    e = _acyclic(spark, d)
    own = graph.nodes_of(e).select(F.col("node").alias("ancestor"), F.col("node").alias("descendant"), F.lit(0).alias("depth"))
    return graph.closure(e).select(F.col("src").alias("ancestor"), F.col("dst").alias("descendant"), F.col("hops").alias("depth")).unionByName(own)


def q_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.depths(_acyclic(spark, d))


def q_roots(spark: SparkSession, d: str) -> DataFrame:
    return graph.roots(_acyclic(spark, d))


def q_transitive_reduction(spark: SparkSession, d: str) -> DataFrame:
    return graph.transitive_reduction(_acyclic(spark, d)).select("src", "dst", F.when(F.col("redundant"), "transitive").alias("dropped_reason"))


def q_scc(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(Scratch(spark, "edges").keep(_edges(spark, d)))


def q_cycle_prune(spark: SparkSession, d: str) -> DataFrame:
    return graph.prune_cycles(Scratch(spark, "edges").keep(_edges(spark, d)))[1]


def q_cluster_names(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the list by the name of the concept that unlocks most."""
    e = _acyclic(spark, d)
    c = _clusters(spark, d, e)
    names = sq.table(spark, d, "concepts").select(F.col("concept_id").alias("node"), F.col("canonical_name").alias("name")).distinct()
    v = graph.unlock_values(c, graph.closure(e)).select("node", r6(F.col("value")).alias("value"))
    return graph.cluster_names(c, names, v)


def q_tuning_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Positive and negative pairs with both names, as what a fine-tuning of the scorer reads: train rows only, unclear labels out."""
    p = sq._pairs(spark, d).where("split = 'train' and label in (1, 0)")
    return p.select("pair_id", F.concat_ws(" -> ", "a", "b").alias("text"), F.col("label").alias("target"))


def q_dirgcn_two_layers(spark: SparkSession, d: str) -> DataFrame:
    """Two graph layers on all 64 numbers, and the link score of every edge by what they give."""
    e = _acyclic(spark, d)
    x = sq._vectors(spark, d).select(F.col("concept_id").alias("node"), F.transform("embedding", lambda v: v.cast("double")).alias("x")).join(graph.nodes_of(e), "node", "left_semi")
    scratch = Scratch(spark, "layers")
    one = scratch.keep(graph.graph_layer(x, e, *FULL_MATRICES, FULL_BIAS).select("node", F.transform("h", lambda v: v / 100).alias("x")))
    two = scratch.keep(graph.graph_layer(one, e, *FULL_MATRICES, FULL_BIAS).select("node", F.transform("h", lambda v: v / 100).alias("h")))
    return graph.link_score(two, e.select("src", "dst"), [(i * 37 % 101 - 50) / 500 for i in range(128)], 0.1).select("src", "dst", r6(F.col("score")).alias("score"))


def q_attention(spark: SparkSession, d: str) -> DataFrame:
    e = _acyclic(spark, d)
    x = sq._vectors(spark, d).select(F.col("concept_id").alias("node"), F.transform("embedding", lambda v: v.cast("double")).alias("x")).join(graph.nodes_of(e), "node", "left_semi")
    h = graph.attention_layer(x, e, FULL_MATRICES[0], FULL_BIAS, FULL_BIAS[::-1])
    return h.select("node", F.transform("h", r6).alias("h"))


def q_build_stats(spark: SparkSession, d: str) -> DataFrame:
    built = graph.build_dag(Scratch(spark, "edges").keep(_edges(spark, d)), TAU)
    return built.groupBy(F.coalesce("dropped_reason", F.lit("edge")).alias("reason")).agg(F.count("*").alias("n"))


def q_audit(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the positive pairs, put in id order, when edges below the threshold are dropped and the rest reduced."""
    e = _acyclic(spark, d)
    kept, low = graph.threshold_split(e, TAU)
    reach = graph.closure(kept)
    built = graph.transitive_reduction(kept, reach).select("src", "dst", F.when(F.col("redundant"), "transitive").alias("dropped_reason")).unionByName(low.select("src", "dst", F.lit("threshold").alias("dropped_reason")))
    return graph.audit(e, built, reach).groupBy("status").agg(F.count("*").alias("n"))


def q_unlock_value(spark: SparkSession, d: str) -> DataFrame:
    e = _acyclic(spark, d)
    return graph.unlock_values(_clusters(spark, d, e), graph.closure(e)).select("node", r6(F.col("value")).alias("value"))


def q_topo_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of each node in its cluster: by depth, then larger value, then id."""
    e = _acyclic(spark, d)
    reach = graph.closure(e, longest=True)
    c = _clusters(spark, d, e)
    deep = reach.groupBy(F.col("dst").alias("node")).agg(F.max("most").alias("m"))
    v = graph.unlock_values(c, reach.select("src", "dst")).join(c, "node").join(deep, "node", "left").select("node", "cluster", r6(F.col("value")).alias("value"), F.coalesce("m", F.lit(0)).alias("depth"))
    w = Window.partitionBy("cluster").orderBy("depth", F.desc("value"), "node")
    return v.select("node", "cluster", "depth", F.row_number().over(w).alias("pos"))


def q_components(spark: SparkSession, d: str) -> DataFrame:
    """Near-equal vectors of a domain (cosine of 0.92 or more), joined into groups through each other."""
    rows = sq._vectors(spark, d).select(F.col("domain_id").alias("grp"), F.col("concept_id").alias("id"), F.col("embedding").alias("vec"))
    links = cosine_pairs(rows, 0.92).select("src", "dst")
    return graph.components(Scratch(spark, "links").keep(links))


def q_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(_acyclic(spark, d))


def q_dirgcn_layer(spark: SparkSession, d: str) -> DataFrame:
    e = _acyclic(spark, d)
    x = sq._vectors(spark, d).select(F.col("concept_id").alias("node"), F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("x")).join(graph.nodes_of(e), "node", "left_semi")
    h = graph.graph_layer(x, e, *MATRICES, [0.01, -0.01, 0.02, 0.0])
    return h.select("node", *(r6(F.element_at("h", i + 1)).alias(f"h{i}") for i in range(4)))


def q_dirgcn_full(spark: SparkSession, d: str) -> DataFrame:
    """The layer on all 64 numbers of every vector; the query above takes the four that its SQL takes."""
    e = _acyclic(spark, d)
    x = sq._vectors(spark, d).select(F.col("concept_id").alias("node"), F.transform("embedding", lambda v: v.cast("double")).alias("x")).join(graph.nodes_of(e), "node", "left_semi")
    return graph.graph_layer(x, e, *FULL_MATRICES, FULL_BIAS).select("node", F.transform("h", r6).alias("h"))


#: Weights by a formula, as above: 64 rows and columns of -1 to 1.
FULL_MATRICES = tuple([[((i * 64 + j) * m % 101 - 50) / 50 for j in range(64)] for i in range(64)] for m in (37, 29, 43))
FULL_BIAS = [(i % 7 - 3) / 100 for i in range(64)]
MATRICES = tuple([[round(((i * 4 + j) * m % 9 - 4) / 4, 2) for j in range(4)] for i in range(4)] for m in (5, 7, 4))


def _r(x: str) -> str:
    return f"floor(({x})::DOUBLE * 1e6 + 0.5) / 1e6"


_EDGES = f"""{sq._BASE}, edges AS (SELECT src, dst, {_r(sq._lr('vu', 'vv'))} AS conf FROM (SELECT DISTINCT src, dst, vu, vv FROM pairs WHERE label = 1), w),
dag AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(conf) AS conf FROM edges GROUP BY 1, 2),
nodes AS (SELECT src AS node FROM dag UNION SELECT dst FROM dag),
cl AS (SELECT concept_id AS node, min(cluster_no) AS cluster FROM concepts GROUP BY 1)"""
_PATHS = """, paths AS (SELECT src, dst, 1 AS hops FROM dag UNION SELECT p.src, e.dst, p.hops + 1 FROM paths p JOIN dag e ON e.src = p.dst)
, reach AS (SELECT src, dst, min(hops) AS hops, max(hops) AS most FROM paths GROUP BY ALL)
, value AS (SELECT n.node, coalesce(sum(CASE WHEN r.dst IS NULL THEN 0 WHEN a.cluster IS NULL OR a.cluster = b.cluster THEN 1.0 ELSE 0.3 END), 0) AS v FROM nodes n LEFT JOIN reach r ON r.src = n.node LEFT JOIN cl a ON a.node = n.node LEFT JOIN cl b ON b.node = r.dst GROUP BY n.node)
, deep AS (SELECT n.node, coalesce(max(most), 0) AS depth FROM nodes n LEFT JOIN reach r ON r.dst = n.node GROUP BY n.node)"""


def _mat(w: list[list[float]], i: int, x: str) -> str:
    return " + ".join(f"{w[i][j]} * {x}[{j + 1}]" for j in range(4))


QUERIES = {f.__name__: f for f in (q_threshold_split, q_closure, q_depth, q_roots, q_transitive_reduction, q_scc, q_cycle_prune, q_build_stats, q_audit, q_unlock_value, q_topo_order, q_components, q_cluster_names, q_tuning_pairs, q_dirgcn_two_layers, q_attention, q_communities, q_dirgcn_layer, q_dirgcn_full)}
SQL = {
    "q_threshold_split": f"WITH {_EDGES} SELECT CASE WHEN conf >= {TAU} THEN 'kept' ELSE 'dropped' END AS bucket, count(*) AS n, {_r('sum(conf)')} AS sum_conf FROM edges GROUP BY 1",
    "q_closure": f"WITH RECURSIVE {_EDGES} {_PATHS} SELECT src AS ancestor, dst AS descendant, hops AS depth FROM reach UNION ALL SELECT node, node, 0 FROM nodes",
    "q_depth": f"WITH RECURSIVE {_EDGES} {_PATHS} SELECT node, depth FROM deep",
    "q_roots": f"WITH {_EDGES} SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM dag)",
    "q_transitive_reduction": f"WITH RECURSIVE {_EDGES} {_PATHS} SELECT src, dst, CASE WHEN EXISTS (SELECT 1 FROM dag e JOIN reach r ON r.src = e.dst WHERE e.src = d.src AND r.dst = d.dst) THEN 'transitive' END AS dropped_reason FROM dag d",
    "q_scc": f"WITH RECURSIVE {_EDGES}, p AS (SELECT src, dst FROM edges UNION SELECT p.src, e.dst FROM p JOIN edges e ON e.src = p.dst), n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT n.node, least(n.node, coalesce(min(a.dst), n.node)) AS component FROM n LEFT JOIN (SELECT x.src, x.dst FROM p x JOIN p y ON x.src = y.dst AND x.dst = y.src) a ON a.src = n.node GROUP BY n.node",
    "q_cycle_prune": f"""WITH RECURSIVE {_EDGES}, o AS (SELECT src, dst, conf, row_number() OVER (ORDER BY conf, src, dst) AS k FROM edges WHERE src <> dst),
        p AS (SELECT k, src, dst AS at FROM o UNION SELECT p.k, p.src, o.dst FROM p JOIN o ON o.src = p.at AND o.k > p.k)
        SELECT DISTINCT o.src, o.dst, o.conf, false AS loop FROM o JOIN p ON p.k = o.k AND p.at = o.src UNION ALL SELECT src, dst, conf, true FROM edges WHERE src = dst""",
    "q_build_stats": f"""WITH RECURSIVE {_EDGES}, o AS (SELECT src, dst, conf, row_number() OVER (ORDER BY conf, src, dst) AS k FROM edges WHERE conf >= {TAU} AND src <> dst),
        p AS (SELECT k, src, dst AS at FROM o UNION SELECT p.k, p.src, o.dst FROM p JOIN o ON o.src = p.at AND o.k > p.k),
        cut AS (SELECT DISTINCT o.k FROM o JOIN p ON p.k = o.k AND p.at = o.src), good AS (SELECT * FROM o WHERE k NOT IN (SELECT k FROM cut)),
        r AS (SELECT src, dst FROM good UNION SELECT r.src, g.dst FROM r JOIN good g ON g.src = r.dst), red AS (SELECT DISTINCT g.src, r.dst FROM good g JOIN r ON r.src = g.dst)
        SELECT reason, count(*) AS n FROM (SELECT CASE WHEN red.src IS NULL THEN 'edge' ELSE 'transitive' END AS reason FROM good g LEFT JOIN red ON red.src = g.src AND red.dst = g.dst
        UNION ALL SELECT 'cycle_prune' FROM cut UNION ALL SELECT 'cycle_prune' FROM edges WHERE conf >= {TAU} AND src = dst UNION ALL SELECT 'threshold' FROM edges WHERE conf < {TAU}) GROUP BY 1""",
    "q_cluster_names": f"WITH RECURSIVE {_EDGES} {_PATHS} SELECT cluster, name, n_nodes FROM (SELECT cluster, min(canonical_name) AS name, node, {_r('v')} AS v, count(DISTINCT node) OVER (PARTITION BY cluster) AS n_nodes FROM value JOIN cl USING (node) JOIN concepts c ON c.concept_id = node WHERE cluster IS NOT NULL GROUP BY cluster, node, v) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY v DESC, length(name), name) = 1",
    "q_tuning_pairs": f"WITH {sq._BASE} SELECT pair_id, a || ' -> ' || b AS text, label AS target FROM pairs WHERE split = 'train' AND label IN (1, 0)",
    "q_audit": f"""WITH RECURSIVE {_EDGES}, k AS (SELECT * FROM dag WHERE conf >= {TAU}), p AS (SELECT src, dst FROM k UNION SELECT p.src, k.dst FROM p JOIN k ON k.src = p.dst),
        red AS (SELECT DISTINCT k.src, p.dst FROM k JOIN p ON p.src = k.dst)
        SELECT CASE WHEN d.conf >= {TAU} AND red.src IS NULL THEN 'survived' WHEN p.src IS NOT NULL THEN 'subsumed_by_transitive_path' ELSE 'lost_to_threshold' END AS status, count(*) AS n
        FROM dag d LEFT JOIN red ON red.src = d.src AND red.dst = d.dst LEFT JOIN p ON p.src = d.src AND p.dst = d.dst GROUP BY 1""",
    "q_unlock_value": f"WITH RECURSIVE {_EDGES} {_PATHS} SELECT node, {_r('v')} AS value FROM value",
    "q_topo_order": f"WITH RECURSIVE {_EDGES} {_PATHS} SELECT node, cluster, depth, row_number() OVER (PARTITION BY cluster ORDER BY depth, {_r('v')} DESC, node) AS pos FROM value JOIN deep USING (node) LEFT JOIN cl USING (node)",
    "q_components": f"WITH RECURSIVE {sq._BASE}, l AS (SELECT a.concept_id AS src, b.concept_id AS dst FROM vec a JOIN vec b ON a.domain_id = b.domain_id AND a.concept_id <> b.concept_id WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.92), p AS (SELECT src, dst FROM l UNION SELECT p.src, l.dst FROM p JOIN l ON l.src = p.dst) SELECT src AS node, least(src, min(dst)) AS component FROM p GROUP BY src",
    "q_dirgcn_layer": f"WITH {_EDGES}, f AS (SELECT concept_id AS node, v[1:4] AS x FROM vec WHERE concept_id IN (SELECT node FROM nodes)), "
    + f"i AS (SELECT e.dst AS node, {', '.join(f'avg({_mat(MATRICES[0], k, "x")}) AS i{k}' for k in range(4))} FROM dag e JOIN f ON f.node = e.src GROUP BY 1), o AS (SELECT e.src AS node, {', '.join(f'avg({_mat(MATRICES[1], k, "x")}) AS o{k}' for k in range(4))} FROM dag e JOIN f ON f.node = e.dst GROUP BY 1) "
    + f"SELECT node, {', '.join(f'{_r(f"greatest(0.0, coalesce(i{k}, 0) + coalesce(o{k}, 0) + {_mat(MATRICES[2], k, "x")} + {[0.01, -0.01, 0.02, 0.0][k]})")} AS h{k}' for k in range(4))} FROM f LEFT JOIN i USING (node) LEFT JOIN o USING (node)",
}
