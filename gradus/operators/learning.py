"""State of learners and their graphs: forgetting, reviews, remediation, unlocking, progress, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.columns import cosine, retention
from gradus.operators.hierarchy import Forest

DAY = 86400.0


def sm2_step(quality: Column, ease: Column, interval: Column, repetition: Column) -> tuple[Column, Column, Column, Column]:
    """One review by the SM-2 rule: (ease, interval in days, repetition, stability in seconds) afterwards."""
    q = F.greatest(F.lit(0), F.least(F.lit(5), quality)).cast("double")
    miss = F.lit(5.0) - q
    e = F.greatest(F.lit(1.3), ease + (F.lit(0.1) - miss * (F.lit(0.08) + miss * F.lit(0.02))))
    failed = q < 3
    rep = F.when(failed, 0).otherwise(repetition + 1)
    days = F.when(failed, 1.0).when(repetition == 0, 1.0).when(repetition == 1, 6.0).otherwise(interval * e)
    return e, days, rep, days * DAY * F.greatest(e / 2.5, F.lit(0.5))


def _history(reviews: DataFrame, *keys: str) -> DataFrame:
    """Reviews of each key in the order of time and event; a learner's reviews of one concept, not a table."""
    return reviews.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "quality"))).alias("h"))


def fold_sm2(reviews: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_reviews, ease, interval, repetition, stability) after all reviews (keys, ts, event_id, quality) in order."""
    start = F.struct(F.lit(2.5).alias("e"), F.lit(1.0).alias("d"), F.lit(0).alias("r"), F.lit(DAY).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        e, d, r, s = sm2_step(x["quality"], acc["e"], acc["d"], acc["r"])
        return F.struct(e.alias("e"), d.alias("d"), r.cast("int").alias("r"), s.alias("s"))

    end = _history(reviews, *keys).select(*keys, F.size("h").alias("n_reviews"), F.aggregate("h", start, step).alias("z"))
    return end.select(*keys, "n_reviews", F.col("z.e").alias("ease"), F.col("z.d").alias("interval"), F.col("z.r").alias("repetition"), F.col("z.s").alias("stability"))


def fsrs_step(quality: Column, stability: Column) -> Column:
    """One review by the FSRS-like rule: growth from quality 3 on, else a fall to a minute at least."""
    up = stability * (F.lit(1.6) + F.lit(0.12) * F.greatest(F.lit(0), quality - 3).cast("double"))
    return F.when(quality >= 3, up).otherwise(F.greatest(stability / 1.8, F.lit(60.0)))


def fold_fsrs(reviews: DataFrame, *keys: str, first: float = 2 * DAY) -> DataFrame:
    """(keys, n_reviews, stability, last_ts) after all reviews in order, from a first stability."""
    h = _history(reviews, *keys)
    return h.select(*keys, F.size("h").alias("n_reviews"), F.aggregate("h", F.lit(first), lambda s, x: fsrs_step(x["quality"], s)).alias("stability"), F.element_at("h", -1)["ts"].alias("last_ts"))


def decayed(state: DataFrame, now: Column, threshold: float = 0.5) -> DataFrame:
    """Adds retention at ``now`` and whether it is below the threshold; never reviewed (null last_ts) keeps everything."""
    gone = F.greatest(F.lit(0.0), (now.cast("double") - F.col("last_ts").cast("timestamp").cast("double")))
    r = F.coalesce(retention(gone, F.col("stability")), F.lit(1.0))
    return state.withColumn("retention", r).withColumn("decayed", r < threshold)


def route(answers: DataFrame) -> DataFrame:
    """Adds ``action`` and ``quality`` to graded answers (role, misconception): remediation, completion or a weak review."""
    action = F.when(F.col("misconception").isNotNull(), "remediate").when(F.col("role") == "A", "complete").otherwise("review")
    return answers.withColumn("action", action).withColumn("quality", F.when(action == "complete", 3).when(action == "review", 1))


def inject_remediation(edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New edges, the stash of rerouted ones, and the nodes to lock, for targets (node, misconception); M_7 on C makes RM_7_C.

    Each prerequisite edge (src, dst, kind, conf) into a target leads to its remediation node instead, which links to
    the target. Doing it again for the same target changes nothing.
    """
    own = targets.select(F.col("node").alias("dst"), F.concat(F.lit("RM_"), F.regexp_replace("misconception", "^M_", ""), F.lit("_"), "node").alias("rm")).distinct()
    there = edges.where("kind = 'remediation_link'").select(F.col("src").alias("rm")).distinct()
    own = own.join(there, "rm", "left_anti")
    hit = edges.where("kind = 'prerequisite'").join(own, "dst")
    stash = hit.select("rm", "src", "dst", "kind", "conf")
    kept = edges.join(own.select("dst").distinct().withColumn("hit", F.lit(True)), "dst", "left").where(F.col("hit").isNull() | (F.col("kind") != "prerequisite")).select("src", "dst", "kind", "conf")
    rerouted = hit.select("src", F.col("rm").alias("dst"), "kind", "conf")
    links = own.select(F.col("rm").alias("src"), "dst", F.lit("remediation_link").alias("kind"), F.lit(1.0).alias("conf"))
    return kept.unionByName(rerouted).unionByName(links), stash, own.select(F.col("dst").alias("node")).distinct()


def resolve_remediation(edges: DataFrame, stash: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges after the remediation nodes (rm) are taken out and their stashed edges put back."""
    rm = resolved.select("rm").distinct()
    rest = edges.join(rm.select(F.col("rm").alias("src")), "src", "left_anti").join(rm.select(F.col("rm").alias("dst")), "dst", "left_anti")
    return rest.select("src", "dst", "kind", "conf").unionByName(stash.join(rm, "rm", "left_semi").select("src", "dst", "kind", "conf")).distinct()


def unlocked(status: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (node, status) with locked ones made available whose prerequisites are all completed."""
    ready = edges.join(status.select(F.col("node").alias("src"), (F.col("status") == "completed").alias("ok")), "src").groupBy(F.col("dst").alias("node")).agg(F.bool_and("ok").alias("ready"))
    return status.join(ready, "node", "left").select("node", F.when((F.col("status") == "locked") & F.coalesce("ready", F.lit(False)), "available").otherwise(F.col("status")).alias("status"))


def cascade(forest: Forest, status: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(node, status) after completions have taken their course in the trees of a forest; ``status`` has (node, status).

    A parent is completed when all leaves below it are. After a completed node the next locked sibling becomes available,
    with its first child if that is locked. Siblings stand in the order of ``places`` (parent, node, place), then those without a place, by
    node. Every step is read off the state before, which needs no loop: completion below a parent depends on leaves alone, and
    unlocking completes nothing. Roots have no siblings and take no part in the windows.
    """
    tree = forest.nodes.where("depth >= 0").select("node", "parent", "size").join(status.select("node", "status"), "node")
    open_leaf = tree.where("size = 1 and status <> 'completed'").select("node", F.lit(1).alias("x"))
    unfinished = forest.gathered(open_leaf).where("total > 0").select("node", F.lit(True).alias("unfinished"))
    state = tree.join(unfinished, "node", "left").withColumn("done", (F.col("status") == "completed") | ((F.col("size") > 1) & F.col("unfinished").isNull()))
    kids = state.where("parent is not null")
    kids = kids.join(places, ["parent", "node"], "left") if places is not None else kids.withColumn("place", F.lit(None).cast("int"))
    w = Window.partitionBy("parent").orderBy(F.col("place").asc_nulls_last(), "node")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = kids.withColumn("p", F.row_number().over(w))
    placed = placed.withColumn("last_done", F.max(F.when(F.col("done"), F.col("p"))).over(before)).withColumn("last_locked", F.max(F.when(F.col("status") == "locked", F.col("p"))).over(before))
    opened = placed.where("not done and status = 'locked' and last_done > coalesce(last_locked, 0)").select("node")
    child = placed.where("p = 1 and not done and status = 'locked'").join(opened.select(F.col("node").alias("parent")), "parent", "left_semi").select("node")
    available = opened.union(child).distinct().withColumn("opened", F.lit(True))
    out = state.join(available, "node", "left").select("node", F.when(F.col("done"), "completed").when(F.col("opened"), "available").otherwise(F.col("status")).alias("status"))
    return out.unionByName(status.join(tree.select("node"), "node", "left_anti").select("node", "status"))


def unmet(status: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, n_unmet, first_unmet): locked nodes with prerequisites that are not completed."""
    pre = edges.join(status.where("status <> 'completed'").select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"), F.col("src").alias("missing")).distinct()
    return pre.join(status.where("status = 'locked'").select("node"), "node", "left_semi").groupBy("node").agg(F.count("*").alias("n_unmet"), F.min("missing").alias("first_unmet"))


def progress(forest: Forest, leaf_done: DataFrame) -> DataFrame:
    """(node, progress): 1 or 0 of a leaf (node, done), of a parent the mean of its children's."""
    leaves = forest.nodes.where("depth >= 0 and size = 1").select("node").join(leaf_done.select("node", F.col("done").alias("x")), "node")
    return forest.gathered(leaves, shared=True).withColumnRenamed("total", "progress")


def hidden(forest: Forest, collapsed: DataFrame) -> DataFrame:
    """(node): every node below a collapsed one (node)."""
    return forest.below(collapsed)


def attributed(answers: DataFrame, bank: DataFrame, most: float = 0.1) -> DataFrame:
    """Adds ``match`` and ``attributed`` to wrong answers (misconception, vec): whether they are laid to the misconception.

    ``bank``: (misconception, vec). Where the bank has a vector, the answer is attributed if the cosine of both is below ``most``;
    an answer without a vector is not, and one whose misconception the bank does not have is, with match null.
    """
    known = bank.select("misconception", F.col("vec").alias("bank_vec"))
    j = answers.join(known, "misconception", "left").withColumn("match", cosine(F.col("vec"), F.col("bank_vec")))
    verdict = F.when(F.col("misconception").isNull(), False).when(F.col("bank_vec").isNull(), True).when(F.col("vec").isNull(), False).otherwise(F.col("match") < most)
    return j.withColumn("attributed", verdict).drop("bank_vec")


def next_available(status: DataFrame, *order: str) -> DataFrame:
    """Of each session the first leaf that is available or in progress, in the given order."""
    w = Window.partitionBy("session_id").orderBy(*order)
    return status.where("status in ('available', 'in_progress')").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
