"""Study content: item sources, ranking by similarity, quizzes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.text import bow_buckets
from gradus.operators.blocks import blocked_pairs, unit

KINDS = ("video", "paper", "repository", "documentation")
ROLES = ("A", "B", "C")


def content_items(topics: DataFrame, per_kind: int = 5) -> DataFrame:
    """(topic, kind, rank, url): a fixed number of items of each kind for each topic, by rule."""
    kinds = F.explode(F.array(*map(F.lit, KINDS)))
    t = topics.select("topic", kinds.alias("kind")).select("topic", "kind", F.explode(F.sequence(F.lit(0), F.lit(per_kind - 1))).alias("rank"))
    return t.select("topic", "kind", "rank", F.concat("kind", F.lit("://"), F.replace(F.col("topic"), F.lit(" "), F.lit("-")), F.lit("/"), F.col("rank").cast("string")).alias("url"))


def bow_rank(queries: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """(grp, query_id, item_id, sim, rank): of each query's group the k items with the most similar bag of hashed words.

    Both sides: (grp, id, text). Only items that share a bucket are compared; ties go to the smaller id.
    """

    def vectors(df: DataFrame, name: str) -> DataFrame:
        b = df.select("grp", F.col("id").alias(name), F.explode(bow_buckets(F.col("text"))).alias("bucket")).groupBy("grp", name, "bucket").agg(F.count("*").alias("n"))
        return b.join(b.groupBy("grp", name).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm")), ["grp", name])

    q = vectors(queries, "query_id").withColumnsRenamed({"n": "nq", "norm": "mq"})
    i = vectors(items, "item_id").withColumnsRenamed({"n": "ni", "norm": "mi"})
    sims = q.join(i, ["grp", "bucket"]).groupBy("grp", "query_id", "item_id", "mq", "mi").agg(F.sum(F.col("nq") * F.col("ni")).alias("dot"))
    sims = sims.select("grp", "query_id", "item_id", (F.col("dot") / (F.col("mq") * F.col("mi"))).alias("sim"))
    w = Window.partitionBy("grp", "query_id").orderBy(F.desc(F.round("sim", 9)), "item_id")
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_top(queries: DataFrame, base: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """(query_id, id, sim, rank): exact k most similar vectors of ``base`` (id, vec) for each of ``queries``, itself left out.

    Queries and base meet in blocks, each pair of blocks one matrix product; ties go to the smaller id. Vectors without
    length have similarity 0. All vectors have one number of dimensions.
    """

    def score(i, x, j, y):
        s = unit(x) @ unit(y).T
        s[i[:, None] == j[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(j, s.shape), -np.round(s, 9)), axis=1)[:, :k]
        row = np.repeat(np.arange(len(i)), order.shape[1])
        good = np.isfinite(s[row, order.ravel()])
        return row[good], order.ravel()[good], s[row, order.ravel()][good]

    one = [df.select(F.lit(0).alias("grp"), F.col("id").cast("bigint").alias("id"), "vec") for df in (queries, base)]
    found = blocked_pairs(*one, score, block).select(F.col("src").alias("query_id"), F.col("dst").alias("id"), F.col("score").alias("sim"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def misconception_id(node: Column) -> Column:
    return F.concat(F.lit("M_"), F.substring(F.md5(node.cast("string").cast("binary")), 1, 8))


def quiz_questions(nodes: DataFrame, per_node: int = 3) -> DataFrame:
    """(node, question, role, misconception): questions with one option of each role; the second role carries the misconception."""
    q = nodes.select("node", F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("question")).select("node", "question", F.explode(F.array(*map(F.lit, ROLES))).alias("role"))
    return q.select("node", "question", "role", F.when(F.col("role") == "B", misconception_id(F.col("node"))).alias("misconception"))


def broken_questions(options: DataFrame) -> DataFrame:
    """(node, question): questions that do not have exactly one option of each role."""
    n = options.groupBy("node", "question").agg(F.count("*").alias("n"), F.count_distinct("role").alias("k"))
    return n.where((F.col("n") != len(ROLES)) | (F.col("k") != len(ROLES))).select("node", "question")
