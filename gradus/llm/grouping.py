"""Consolidating pairwise matches into groups (connected components over many links).

The component of the vertex with most links is peeled off by breadth-first joins, taken out by an anti-join, and the
small components that remain are labelled by minimum propagation, contracted after each step so that a chain of length
d takes about log d rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.session import Scratch


def distinct_links(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Each link once as (a, b) with a < b. Rows with a missing side or with both sides equal link nothing."""
    l, r = F.col(left).cast("bigint"), F.col(right).cast("bigint")
    return pairs.where(l.isNotNull() & r.isNotNull() & (l != r)).select(F.least(l, r).alias("a"), F.greatest(l, r).alias("b")).distinct()


def _both_ways(links: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w"))))
    return links.select(ends.alias("e")).select("e.v", "e.w")


def connected_groups(pairs: DataFrame, left: str, right: str, least_gain: float = 0.01) -> DataFrame:
    """(record_id, group_id): every record with a link to another record, and the smallest record_id of its group.

    The breadth-first search goes on until its frontier is empty or holds less than ``least_gain`` of what has been reached: then
    the giant is peeled but for thin tails, each step of which would cost a pass over all links. What is reached is
    contracted to one vertex, so that the tails are labelled with it by the propagation, which is exact for every shape.
    Rows with a null side and self links are no links; repeated links, both directions and extra columns (also ones
    named a, b, v, w) change nothing; no link at all gives an empty result.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups")
    links = scratch.keep(distinct_links(pairs, left, right))
    top = _both_ways(links).groupBy("v").count().orderBy(F.desc("count"), "v").limit(1).collect()
    if not top:
        return links.select(F.col("a").alias("record_id"), F.col("b").alias("group_id"))
    giant, stand_in, rest = _peel(spark, scratch, links, top[0]["v"], least_gain)
    labels = scratch.keep(_propagate(scratch, rest))
    # The vertex that stands for the peeled part may have been joined to a smaller one, or be the group's least itself.
    joined = labels.where(F.col("v") == stand_in).select("label").head()
    peeled = giant.select("v", F.lit(joined["label"] if joined else stand_in).alias("label"))
    small = labels.join(giant, "v", "left_anti")
    return peeled.unionByName(small).select(F.col("v").alias("record_id"), F.col("label").alias("group_id"))


def _peel(spark: SparkSession, scratch: Scratch, links: DataFrame, start: int, least_gain: float) -> tuple[DataFrame, int, DataFrame]:
    """What breadth-first search reaches from ``start``, its least vertex, and the links of the rest with that vertex for all of it."""
    seen = frontier = scratch.keep(spark.createDataFrame([(start,)], "v bigint"))
    reached = gained = 1
    while gained >= least_gain * reached and gained:
        # Each frontier is written once; what has been seen is all of them together.
        frontier = scratch.keep(_both_ways(links).join(frontier, "v", "left_semi").select(F.col("w").alias("v")).distinct().join(seen, "v", "left_anti"))
        gained = frontier.count()
        reached += gained
        seen = seen.unionByName(frontier)
    stand_in = seen.agg(F.min("v").alias("m")).collect()[0]["m"]  # one number

    def moved(side: str) -> Column:
        return F.when(F.col(f"in_{side}"), F.lit(stand_in)).otherwise(F.col(side))

    marked = links
    for side in ("a", "b"):
        marked = marked.join(seen.select(F.col("v").alias(side), F.lit(True).alias(f"in_{side}")), side, "left")
    left_over = marked.where(~(F.coalesce("in_a", F.lit(False)) & F.coalesce("in_b", F.lit(False))))
    rest = left_over.select(F.least(moved("a"), moved("b")).alias("a"), F.greatest(moved("a"), moved("b")).alias("b")).distinct()
    return seen, stand_in, scratch.keep(rest)


def _propagate(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(v, label): least vertex of the component of every vertex of ``links``.

    Each round moves every vertex to the least of itself and its neighbours, follows that move once more, and contracts
    the links. The least vertex of a component never moves, and a contracted component ends as that vertex alone.
    """
    steps = []
    while not links.isEmpty():
        near = scratch.keep(_both_ways(links).groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("to")))
        jump = near.select(F.col("v").alias("to"), F.col("to").alias("far"))
        step = scratch.keep(near.join(jump, "to").select("v", F.col("far").alias("to")))
        steps.append(step)
        ends = links
        for side in ("a", "b"):
            ends = ends.join(step.select(F.col("v").alias(side), F.col("to").alias(f"to_{side}")), side)
        ends = ends.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        links = scratch.keep(ends)
    if not steps:
        return links.select(F.col("a").alias("v"), F.col("b").alias("label"))
    labels = steps[-1].select("v", F.col("to").alias("label"))
    for step in reversed(steps[:-1]):
        up = labels.select(F.col("v").alias("to"), "label")
        labels = step.join(up, "to", "left").select("v", F.coalesce("label", "to").alias("label"))
    return labels
