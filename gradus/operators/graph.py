"""Directed graphs (src, dst, conf): reachability, depth, cycles, reduction, layers and communities, by joins.

Paths are followed in doubled strides, so a graph of diameter d takes about log2(d) rounds.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.session import Scratch


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def threshold_split(edges: DataFrame, tau: float) -> tuple[DataFrame, DataFrame]:
    return edges.where(F.col("conf") >= tau), edges.where((F.col("conf") < tau) | F.col("conf").isNull())


def closure(edges: DataFrame, longest: bool = False) -> DataFrame:
    """(src, dst, hops[, most]): each pair of nodes joined by a path, with its fewest steps, and if asked its most.

    Works on graphs with cycles, where a node on one reaches itself; the most steps need an acyclic graph. Self loops
    and repeated edges are one step.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    cols = [F.min("hops").alias("hops")] + ([F.max("most").alias("most")] if longest else [])
    reach = scratch.keep(edges.select("src", "dst").distinct().select("src", "dst", F.lit(1).alias("hops"), F.lit(1).alias("most")))
    state = None
    while True:
        a = reach.select("src", F.col("dst").alias("mid"), F.col("hops").alias("h1"), F.col("most").alias("m1"))
        b = reach.select(F.col("src").alias("mid"), "dst", F.col("hops").alias("h2"), F.col("most").alias("m2"))
        longer = a.join(b, "mid").select("src", "dst", (F.col("h1") + F.col("h2")).alias("hops"), (F.col("m1") + F.col("m2")).alias("most"))
        new = reach.unionByName(longer).groupBy("src", "dst").agg(*cols)
        if not longest:
            new = new.withColumn("most", F.col("hops"))
        old, reach = reach, scratch.keep(new)
        now = reach.agg(F.count("*"), F.sum("hops"), F.sum("most")).collect()[0]
        scratch.drop(old)
        if now == state or now[0] == 0:
            return reach if longest else reach.drop("most")
        state = now


def depths(edges: DataFrame) -> DataFrame:
    """(node, depth): most steps of a path that ends at the node, 0 for sources, in an acyclic graph."""
    most = closure(edges, longest=True).groupBy(F.col("dst").alias("node")).agg(F.max("most").alias("most"))
    return nodes_of(edges).join(most, "node", "left").select("node", F.coalesce("most", F.lit(0)).alias("depth"))


def roots(edges: DataFrame) -> DataFrame:
    return nodes_of(edges).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def cyclic_core(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """The edges left after taking away, some times, those into sinks and out of sources; all cycles stay."""
    scratch = Scratch(edges.sparkSession, "core")
    left, n = scratch.keep(edges), -1
    for _ in range(rounds):
        now = left.count()
        if now == n or now == 0:
            break
        n = now
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        old, left = left, scratch.keep(kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select(edges.columns))
        scratch.drop(old)
    return left


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): least node of the strong component of every node."""
    reach = closure(cyclic_core(edges).select("src", "dst"))
    back = reach.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    mutual = reach.join(back, ["src", "dst"]).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least"))
    return nodes_of(edges).join(mutual, "node", "left").select("node", F.least("node", F.coalesce("least", "node")).alias("component"))


def prune_cycles(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without cycles, and those removed with the column ``loop``: self loops, and the least edge of every cycle.

    Least is by (conf, src, dst). To take the least edge out of each strong component again and again until none is left takes
    out the edges that are the least of some cycle, and no other: while its cycle stands, all of it is in one component,
    where nothing above it can be the least. So an edge goes if a path of greater edges leads from its end back to its
    start; the paths with the greatest least edge are found in doubled strides, and no edge waits for another one's removal.
    """
    scratch = Scratch(edges.sparkSession, "prune")
    loops = edges.where("src = dst").withColumn("loop", F.lit(True))
    rest = scratch.keep(edges.where("src <> dst"))
    core = cyclic_core(rest)
    own = F.struct("conf", "src", "dst")
    ways = scratch.keep(core.groupBy("src", "dst").agg(F.max(own).alias("low")))
    before = None
    while True:
        a = ways.select("src", F.col("dst").alias("mid"), F.col("low").alias("l1"))
        b = ways.select(F.col("src").alias("mid"), "dst", F.col("low").alias("l2"))
        longer = a.join(b, "mid").select("src", "dst", F.least("l1", "l2").alias("low"))
        old, ways = ways, scratch.keep(ways.unionByName(longer).groupBy("src", "dst").agg(F.max("low").alias("low")))
        same = ways.join(old.select("src", "dst", F.col("low").alias("was")), ["src", "dst"], "left").where(~F.col("low").eqNullSafe(F.col("was"))).isEmpty()
        if same:
            break
    back = ways.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "low")
    cut = scratch.keep(core.withColumn("own", own).join(back, ["src", "dst"]).where("low > own").select(*edges.columns))
    removed = loops.unionByName(cut.withColumn("loop", F.lit(False)))
    return rest.join(cut.select("src", "dst", "conf").distinct(), ["src", "dst", "conf"], "left_anti").select(edges.columns), removed


def components(links: DataFrame) -> DataFrame:
    """(node, component): least node of the connected component of every node of the undirected links (src, dst).

    Every node moves to the least of itself and its neighbours, follows that move once more, and the links are contracted: a chain of
    length n takes about log n rounds, and no pair of nodes is built that is not linked.
    """
    scratch = Scratch(links.sparkSession, "components")
    every = scratch.keep(nodes_of(links))
    rest = scratch.keep(links.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    steps = []
    while not rest.isEmpty():
        both = rest.select("src", "dst").unionByName(rest.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = scratch.keep(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("to")).select("node", F.least("node", "to").alias("to")))
        step = scratch.keep(near.join(near.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")))
        steps.append(step)
        ends = rest.join(step.select(F.col("node").alias("src"), F.col("to").alias("a")), "src").join(step.select(F.col("node").alias("dst"), F.col("to").alias("b")), "dst")
        rest = scratch.keep(ends.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    labels = every.select("node", F.col("node").alias("component"))
    for step in steps:
        labels = labels.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return labels


def transitive_reduction(edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """The edges of an acyclic graph with ``redundant``: whether another path joins their ends."""
    reach = closure(edges) if reach is None else reach
    via = edges.select("src", F.col("dst").alias("mid")).join(reach.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
    return edges.join(via.withColumn("redundant", F.lit(True)), ["src", "dst"], "left").withColumn("redundant", F.coalesce("redundant", F.lit(False)))


def build_dag(edges: DataFrame, tau: float) -> DataFrame:
    """(src, dst, conf, dropped_reason): threshold, cycle_prune, transitive, or null for the edges of the graph."""
    kept, low = threshold_split(edges, tau)
    acyclic, cut = prune_cycles(kept)
    acyclic = Scratch(edges.sparkSession, "dag").keep(acyclic)
    reduced = transitive_reduction(acyclic)
    parts = [low.select("src", "dst", "conf", F.lit("threshold").alias("dropped_reason")), cut.select("src", "dst", "conf", F.lit("cycle_prune").alias("dropped_reason")), reduced.select("src", "dst", "conf", F.when(F.col("redundant"), "transitive").alias("dropped_reason"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def audit(gold: DataFrame, built: DataFrame, reach: DataFrame) -> DataFrame:
    """(src, dst, status): what became of gold pairs in a built graph; the reasons in this order, threshold for all else."""
    state = built.groupBy("src", "dst").agg(F.max(F.when(F.col("dropped_reason").isNull(), 1)).alias("kept"), F.max(F.when(F.col("dropped_reason") == "cycle_prune", 1)).alias("cut"))
    j = gold.select("src", "dst").distinct().join(state, ["src", "dst"], "left").join(reach.select("src", "dst", F.lit(1).alias("path")), ["src", "dst"], "left")
    status = F.when(F.col("kept") == 1, "survived").when(F.col("path") == 1, "subsumed_by_transitive_path").when(F.col("cut") == 1, "lost_to_cycle_pruning").otherwise("lost_to_threshold")
    return j.select("src", "dst", status.alias("status"))


def unlock_values(nodes: DataFrame, reach: DataFrame, cross: float = 0.3) -> DataFrame:
    """(node, value): nodes reached from a node; those of another cluster than its own count ``cross``. ``nodes``: (node, cluster).

    A node without a cluster counts all it reaches in full.
    """
    a = nodes.select(F.col("node").alias("src"), F.col("cluster").alias("ca"))
    b = nodes.select(F.col("node").alias("dst"), F.col("cluster").alias("cb"))
    w = F.when(F.col("ca").isNull() | F.col("ca").eqNullSafe(F.col("cb")), 1.0).otherwise(cross)
    v = reach.where("src <> dst").join(a, "src").join(b, "dst").groupBy(F.col("src").alias("node")).agg(F.sum(w).alias("value"))
    return nodes.select("node").join(v, "node", "left").select("node", F.coalesce("value", F.lit(0.0)).alias("value"))


def communities(edges: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """(node, cluster): communities of the undirected, conf-weighted graph by weighted label propagation, deterministic.

    In each round half of the nodes, by a hash of node and round, take the label with the largest weight among their
    neighbours and themselves, ties to the least label, until no node, of either half, would take another one. Nodes without an
    edge share the cluster null.
    """
    scratch = Scratch(edges.sparkSession, "communities")
    both = edges.where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), "conf"), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), "conf"))).alias("e")).select("e.*")
    both = scratch.keep(both.groupBy("node", "other").agg(F.sum("conf").alias("w")))
    labels = scratch.keep(both.select("node").distinct().withColumn("cluster", F.col("node")))
    for i in count():
        seen = labels.select(F.col("node").alias("other"), "cluster")
        votes = both.join(seen, "other").select("node", "cluster", "w").unionByName(labels.select("node", "cluster", F.lit(0.5).alias("w")))
        best = votes.groupBy("node", "cluster").agg(F.sum("w").alias("w")).groupBy("node").agg(F.min(F.struct(-F.round("w", 9), "cluster")).alias("b"))
        turn: Column = F.pmod(F.xxhash64("node", F.lit(i)), F.lit(2)) == 0
        moves = scratch.keep(labels.join(best, "node").select("node", "cluster", F.col("b.cluster").alias("wish"), turn.alias("turn")))
        if moves.where("wish <> cluster").isEmpty():
            break
        labels = moves.select("node", F.when(F.col("turn"), F.col("wish")).otherwise(F.col("cluster")).alias("cluster"))
    every = nodes_of(edges) if all_nodes is None else all_nodes.select("node").distinct()
    return every.join(labels, "node", "left")


def cluster_names(clusters: DataFrame, names: DataFrame, values: DataFrame) -> DataFrame:
    """(cluster, name, n_nodes): each cluster by the name of its node with the largest value, ties to the shorter and then the lesser name.

    ``names``: (node, name), ``values``: (node, value). Nodes without a value count 0; a cluster without names has a null one.
    """
    j = clusters.where("cluster is not null").join(names.groupBy("node").agg(F.min("name").alias("name")), "node", "left").join(values.groupBy("node").agg(F.max("value").alias("value")), "node", "left")
    order = F.struct(F.col("name").isNull(), -F.coalesce("value", F.lit(0.0)), F.length("name"), F.col("name").alias("name"))
    return j.groupBy("cluster").agg(F.min(order).alias("m"), F.count_distinct("node").alias("n_nodes")).select("cluster", F.col("m.name").alias("name"), "n_nodes")


def link_score(h: DataFrame, pairs: DataFrame, weights: list[float], bias: float) -> DataFrame:
    """(src, dst, score): logistic score of the joined layer outputs (node, h) of both ends of each pair."""
    a, b = h.select(F.col("node").alias("src"), F.col("h").alias("hu")), h.select(F.col("node").alias("dst"), F.col("h").alias("hv"))
    w = F.lit([float(x) for x in weights])
    z = F.aggregate(F.zip_with(F.concat("hu", "hv"), w, lambda x, y: x * y), F.lit(float(bias)), lambda t, x: t + x)
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", (1 / (1 + F.exp(-z))).alias("score"))


def attention_layer(features: DataFrame, edges: DataFrame, w: list[list[float]], a_src: list[float], a_dst: list[float], slope: float = 0.2) -> DataFrame:
    """(node, h): ReLU of the attention-weighted mean of the transformed sources of a node's in-edges and of itself.

    The weight of an edge is the exponential of the leaky ReLU of a_src . Wx(source) + a_dst . Wx(target), as a share of those into
    the target; the largest exponent of a target is taken off first.
    """
    rows = F.lit([[float(v) for v in row] for row in w])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, z: t + z)
    y = features.select("node", F.transform(rows, lambda row: dot(row, F.col("x"))).alias("y"))
    y = y.select("node", "y", dot(F.col("y"), F.lit([float(v) for v in a_src])).alias("p"), dot(F.col("y"), F.lit([float(v) for v in a_dst])).alias("q"))
    own = edges.select("src", "dst").distinct().where("src <> dst").unionByName(features.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    e = own.join(y.select(F.col("node").alias("src"), "y", "p"), "src").join(y.select(F.col("node").alias("dst"), "q"), "dst")
    z = F.col("p") + F.col("q")
    e = e.select("dst", "y", F.when(z >= 0, z).otherwise(slope * z).alias("z"))
    e = e.join(e.groupBy("dst").agg(F.max("z").alias("top")), "dst").withColumn("e", F.exp(F.col("z") - F.col("top")))
    sums = e.groupBy("dst").agg(F.sum("e").alias("total"), *(F.sum(F.col("e") * F.element_at("y", i + 1)).alias(f"s{i}") for i in range(len(w))))
    return sums.select(F.col("dst").alias("node"), F.array(*(F.greatest(F.lit(0.0), F.col(f"s{i}") / F.col("total")) for i in range(len(w)))).alias("h"))


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(modularity): of a clustering of the undirected, conf-weighted graph."""
    e = edges.where("src <> dst").select("src", "dst", "conf")
    c = e.join(clusters.select(F.col("node").alias("src"), F.col("cluster").alias("ca")), "src").join(clusters.select(F.col("node").alias("dst"), F.col("cluster").alias("cb")), "dst")
    inside = c.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("conf")).otherwise(0.0)).alias("inner"))
    degree = c.select(F.explode(F.array(F.struct(F.col("ca").alias("k"), "conf"), F.struct(F.col("cb").alias("k"), "conf"))).alias("x")).groupBy(F.col("x.k").alias("ca")).agg(F.sum("x.conf").alias("deg"))
    m = e.agg(F.sum("conf").alias("m"))
    return degree.join(inside, "ca", "left").crossJoin(F.broadcast(m)).agg(F.sum(F.coalesce("inner", F.lit(0.0)) / F.col("m") - (F.col("deg") / (2 * F.col("m"))) * (F.col("deg") / (2 * F.col("m")))).alias("modularity"))


def graph_layer(features: DataFrame, edges: DataFrame, w_in: list[list[float]], w_out: list[list[float]], w_self: list[list[float]], bias: list[float]) -> DataFrame:
    """(node, h): one directed graph-convolution layer: ReLU of the means over in- and out-edges, the node itself and a bias.

    ``features``: (node, x ARRAY<DOUBLE>). The weight matrices are one constant each of the expression.
    """

    def times(w: list[list[float]], x: Column) -> Column:
        rows = F.lit([[float(v) for v in row] for row in w])
        return F.transform(rows, lambda row: F.aggregate(F.zip_with(row, x, lambda v, y: v * y), F.lit(0.0), lambda total, y: total + y))

    dims = len(bias)

    def mean(key: str, other: str, w: list[list[float]], name: str) -> DataFrame:
        m = edges.select(F.col(key).alias("node"), F.col(other).alias("o")).join(features.select(F.col("node").alias("o"), "x"), "o").select("node", times(w, F.col("x")).alias("y"))
        return m.groupBy("node").agg(*(F.avg(F.element_at("y", i + 1)).alias(f"{name}{i}") for i in range(dims)))

    j = features.join(mean("dst", "src", w_in, "in"), "node", "left").join(mean("src", "dst", w_out, "out"), "node", "left").withColumn("own", times(w_self, F.col("x")))
    h = [F.greatest(F.lit(0.0), F.coalesce(F.col(f"in{i}"), F.lit(0.0)) + F.coalesce(F.col(f"out{i}"), F.lit(0.0)) + F.element_at("own", i + 1) + F.lit(bias[i])) for i in range(dims)]
    return j.select("node", F.array(*h).alias("h"))
