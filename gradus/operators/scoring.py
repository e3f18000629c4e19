"""Scoring of directed pairs, calibration of thresholds and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.columns import direction_feature, dot, sigmoid
from gradus.session import Scratch


def linear_score(feature: Column, weights: Column, bias: Column | float) -> Column:
    """Probability of a logistic model for a feature array."""
    return sigmoid(dot(feature, weights) + bias)


def bidirectional(pairs: DataFrame, weights: Column, bias: float, threshold: float) -> DataFrame:
    """(src, dst, fwd, rev, margin, s_fused, admitted) of pairs (src, dst, vu, vv): both directions scored."""
    f = linear_score(direction_feature(F.col("vu"), F.col("vv")), weights, bias)
    r = linear_score(direction_feature(F.col("vv"), F.col("vu")), weights, bias)
    scored = pairs.select("src", "dst", f.alias("fwd"), r.alias("rev"))
    return scored.select("*", F.abs(F.col("fwd") - F.col("rev")).alias("margin"), F.greatest("fwd", "rev").alias("s_fused"), (F.greatest("fwd", "rev") >= threshold).alias("admitted"))


def low_margin_queue(scored: DataFrame, fraction: float = 0.25) -> DataFrame:
    """The share of rows with the smallest margins, at least one; ties by source and target.

    Rows are ranked over all partitions by counts of the sorted parts, not in one task.
    """
    scratch = Scratch(scored.sparkSession, "queue")
    rows = ranked(scratch, scored, "margin", "src", "dst")
    n = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") * fraction)).alias("n")).collect()[0]["n"]
    return rows.where(F.col("rank") <= int(n)).drop("rank")


def top_targets(scored: DataFrame, k: int = 10, score: str = "score") -> DataFrame:
    """Of each source the k best targets, ties to the greater target; with their rank."""
    w = Window.partitionBy("src").orderBy(F.desc(score), F.desc("dst"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def oriented(scored: DataFrame) -> DataFrame:
    """(src, dst, conf): the direction with the larger score (forward if equal); null scores count as 0."""
    f, r = F.coalesce("fwd", F.lit(0.0)), F.coalesce("rev", F.lit(0.0))
    return scored.select(F.when(f >= r, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(f >= r, F.col("dst")).otherwise(F.col("src")).alias("dst"), F.greatest(f, r).alias("conf"))


def confusion(rows: DataFrame, threshold: Column, *keys: str, y: str = "y", s: str = "s") -> DataFrame:
    """(keys, tp, fp, fn, tn) of labels y (1 or 0) and scores s, predicted 1 where s >= threshold."""
    p, t = F.col(s) >= threshold, F.col(y) == 1
    return rows.groupBy(*keys).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))


def quality(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, accuracy and Youden's j to confusion counts; 0 where undefined."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), (ratio(tp, tp + fn) - ratio(fp, fp + tn)).alias("j"))


def threshold_curve(rows: DataFrame, *keys: str, y: str = "y", s: str = "s") -> DataFrame:
    """(keys, threshold, tp, fp, p, n): one row for each cut between distinct scores (their midpoint; a sole score itself).

    One pass over the distinct scores: everything at or above the cut is predicted 1. What is above is what is not up to here: a running
    sum costs a step a row, where a frame that ends with the partition is summed anew for every row.
    """
    counts = rows.groupBy(*keys, F.col(s).alias("s")).agg(F.count_if(F.col(y) == 1).alias("a"), F.count_if(F.col(y) != 1).alias("b"))
    up = Window.partitionBy(*keys).orderBy("s")
    all_ = Window.partitionBy(*keys)
    here = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = counts.select(*keys, "s", F.lead("s").over(up).alias("next"), F.count("*").over(all_).alias("k"), F.sum("a").over(all_).alias("p"), F.sum("b").over(all_).alias("n"), (F.sum("a").over(all_) - F.sum("a").over(here)).alias("tp"), (F.sum("b").over(all_) - F.sum("b").over(here)).alias("fp"))
    sole = F.col("k") == 1
    return cut.where(F.col("next").isNotNull() | sole).select(*keys, F.when(sole, F.col("s")).otherwise((F.col("s") + F.col("next")) / 2).alias("threshold"), F.when(sole, F.col("p")).otherwise(F.col("tp")).alias("tp"), F.when(sole, F.col("n")).otherwise(F.col("fp")).alias("fp"), "p", "n")


def best_threshold(rows: DataFrame, *keys: str, y: str = "y", s: str = "s") -> DataFrame:
    """(keys, threshold, j): the cut with the largest Youden's J, the smallest of equal ones."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    curve = threshold_curve(rows, *keys, y=y, s=s).withColumn("j", ratio("tp", "p") - ratio("fp", "n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("j"), "threshold")
    return curve.withColumn("r", F.row_number().over(w)).where("r = 1").select(*keys, "threshold", "j")


def precision_recall_curve(rows: DataFrame, points: int = 50, y: str = "y", s: str = "s") -> DataFrame:
    """(i, threshold, precision, recall, f1) at ``points`` even steps from the least to the largest score."""
    span = rows.agg(F.min(s).alias("lo"), F.max(s).alias("hi")).select("lo", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1).alias("hi"))
    grid = span.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "lo", "hi").select("i", (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("threshold"))
    counts = rows.groupBy(F.col(s).alias("s")).agg(F.count_if(F.col(y) == 1).alias("a"), F.count("*").alias("c"))
    total = counts.agg(F.sum("a").alias("p"))
    # The grid has a fixed number of rows, so each distinct score meets each of them once.
    at = counts.join(F.broadcast(grid), F.col("s") >= F.col("threshold"), "right").groupBy("i", "threshold").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("tp"), F.coalesce(F.sum("c"), F.lit(0)).alias("pp")).crossJoin(F.broadcast(total))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return at.select("i", "threshold", ratio(F.col("tp"), F.col("pp")).alias("precision"), ratio(F.col("tp"), F.col("p")).alias("recall"), ratio(2 * F.col("tp"), F.col("pp") + F.col("p")).alias("f1"))


def roc_auc(rows: DataFrame, *keys: str, y: str = "y", s: str = "s") -> DataFrame:
    """(keys, auc): share of pairs of a 1 and a 0 in which the 1 has the larger score, ties half; null without both.

    From running counts over distinct scores, so that equal scores are one row.
    """
    counts = rows.groupBy(*keys, F.col(s).alias("s")).agg(F.count_if(F.col(y) == 1).alias("a"), F.count_if(F.col(y) != 1).alias("b"))
    below = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    won = counts.select(*keys, "a", "b", (F.col("a") * (F.coalesce(F.sum("b").over(below), F.lit(0)) + F.col("b") / 2)).alias("w"))
    return won.groupBy(*keys).agg(F.try_divide(F.sum("w"), (F.sum("a") * F.sum("b")).cast("double")).alias("auc"))


def negatives(positives: DataFrame, universe: DataFrame, ratio: int = 1, seed: int = 42) -> DataFrame:
    """(src, dst): ``ratio`` times as many pairs as there are distinct positives, none of them positive or of a node with itself.

    Each positive proposes targets by a hash of itself and the seed among the numbered nodes: no pair of all nodes is built. It
    proposes more as long as too few are left (up to 64 times the ratio: in a universe with hardly any free pair there are fewer);
    of those left the first by hash are taken, which is a choice of exactly as many.
    """
    scratch = Scratch(positives.sparkSession, "negatives")
    own = scratch.keep(positives.select("src", "dst").distinct())
    numbered = scratch.keep(ranked(scratch, universe.select("node").distinct().withColumn("h", F.xxhash64("node", F.lit(seed))), "h", "node").select("node", "rank"))
    n, wanted, times = numbered.count(), own.count() * ratio, 2
    while True:
        drawn = own.select("src", F.explode(F.transform(F.sequence(F.lit(1), F.lit(times * ratio)), lambda i: 1 + F.pmod(F.xxhash64("src", "dst", i, F.lit(seed)), F.lit(max(n, 1))))).alias("rank"))
        made = drawn.join(numbered, "rank").select("src", F.col("node").alias("dst")).where("src <> dst").distinct()
        made = scratch.keep(made.join(own, ["src", "dst"], "left_anti").withColumn("h", F.xxhash64("src", "dst", F.lit(seed))))
        if times >= 64 or made.count() >= wanted:
            return ranked(scratch, made, "h", "src", "dst").where(F.col("rank") <= wanted).select("src", "dst")
        times *= 2


def ranked(scratch: Scratch, rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``rank`` 1, 2, ... by the given order over all rows: places within sorted ranges and counts of the ranges before, not one task."""
    parts = scratch.keep(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_place", place).join(bases, "_part").withColumn("rank", F.col("_base") + F.col("_place")).drop("_part", "_place", "_base")


def fit_logistic(rows: DataFrame, feature: str, label: str, c: float = 1.0, iterations: int = 2000):
    """A logistic model with the L2 penalty of a total-loss objective with constant ``c``; rows (feature array, label)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.col(feature)).alias("features"), F.col(label).cast("double").alias("label"))
    n = max(rows.count(), 1)
    return LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=iterations).fit(data)


def stub_perplexity(prompt: Column) -> Column:
    """A stand-in for a language model: ten, and a hundredth of it for each word; commas part words."""
    return 10.0 * (1 + 0.01 * F.size(F.filter(F.split(F.replace(F.lower(prompt), F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != "")))


#: Prompts about a concept v, and the same without a concept u.
STANDARD = (
    "Explain the concept of {v}.",
    "Define {v} clearly for a learner.",
    "Give a self-contained explanation of {v}.",
    "Describe {v} from first principles.",
)
WITHOUT = (
    "Explain {v} without mentioning {u}.",
    "Define {v} but do not reference {u} at all.",
    "Give an explanation of {v} that never uses {u}.",
    "Describe {v} from scratch, avoiding any mention of {u}.",
)


def probe_prompts(pairs: DataFrame) -> DataFrame:
    """(src, dst, kind, prompt): the prompts of each pair, kind std or without; what an outside model is to be asked."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("t")) for k, ts in (("std", STANDARD), ("without", WITHOUT)) for t in ts))
    rows = pairs.select("src", "dst", F.explode(kinds).alias("x")).select("src", "dst", "x.kind", "x.t")
    return rows.select("src", "dst", "kind", F.replace(F.replace("t", F.lit("{v}"), F.col("dst").cast("string")), F.lit("{u}"), F.col("src").cast("string")).alias("prompt"))


def dependency(answers: DataFrame) -> DataFrame:
    """(src, dst, d): relative rise of the mean perplexity when the explanation of dst must do without src; answers (src, dst, kind, ppl)."""
    means = answers.groupBy("src", "dst").agg(F.avg(F.when(F.col("kind") == "std", F.col("ppl"))).alias("std"), F.avg(F.when(F.col("kind") == "without", F.col("ppl"))).alias("wo"))
    base = F.when(F.col("std") <= 0, 1e-9).otherwise(F.col("std"))
    return means.select("src", "dst", ((F.col("wo") - base) / base).alias("d"))


def dependency_probe(pairs: DataFrame) -> DataFrame:
    """``dependency`` of the stand-in model's answers."""
    return dependency(probe_prompts(pairs).withColumn("ppl", stub_perplexity(F.col("prompt"))))


def perplexity(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, nll, ppl) from the log-probabilities (keys, logprob) of the tokens of an answer: mean negative one, and its exponential."""
    return tokens.groupBy(*keys).agg((-F.avg("logprob")).alias("nll")).withColumn("ppl", F.exp("nll"))


def dependency_nll(answers: DataFrame) -> DataFrame:
    """(src, dst, d): difference of the mean negative log-likelihoods with and without src; answers (src, dst, kind, nll)."""
    m = answers.groupBy("src", "dst").agg(F.avg(F.when(F.col("kind") == "std", F.col("nll"))).alias("std"), F.avg(F.when(F.col("kind") == "without", F.col("nll"))).alias("wo"))
    return m.select("src", "dst", (F.col("wo") - F.col("std")).alias("d"))


def ingest_probe(queue: DataFrame, answers: DataFrame, fallback: DataFrame) -> DataFrame:
    """(src, dst, d, origin) for each pair queued: its answer d, or where there is none (or null) that of the fallback."""
    a = answers.groupBy("src", "dst").agg(F.max("d").alias("answer"))
    f = fallback.groupBy("src", "dst").agg(F.max("d").alias("other"))
    j = queue.select("src", "dst").distinct().join(a, ["src", "dst"], "left").join(f, ["src", "dst"], "left")
    return j.select("src", "dst", F.coalesce("answer", "other").alias("d"), F.when(F.col("answer").isNotNull(), "probe").otherwise("fallback").alias("origin"))


def cross_validated(folds: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_folds, mean_threshold, std_threshold, mean_f1, std_f1) over folds (keys, fold, part, y, s).

    Each fold's threshold is the one with the best Youden's J on its train rows, and its F1 that on its test rows.
    """
    best = best_threshold(folds.where("part = 'train'"), *keys, "fold").select(*keys, "fold", "threshold")
    held = folds.where("part = 'test'").join(best, [*keys, "fold"])
    q = quality(confusion(held, F.col("threshold"), *keys, "fold")).select(*keys, "fold", "f1")
    j = best.join(q, [*keys, "fold"])
    return j.groupBy(*keys).agg(F.count("*").alias("n_folds"), F.avg("threshold").alias("mean_threshold"), F.stddev_pop("threshold").alias("std_threshold"), F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"))


def compare_variants(quality_: DataFrame, baseline: str, name: str = "variant", score: str = "f1") -> DataFrame:
    """(<name>, <score>, gain): each variant's score and how far it is above the baseline's; null where there is no baseline."""
    base = quality_.where(F.col(name) == baseline).agg(F.max(score).alias("_base"))
    return quality_.select(name, score).crossJoin(F.broadcast(base)).select(name, score, (F.col(score) - F.col("_base")).alias("gain"))


def refit_rows(rows: DataFrame, chosen: DataFrame, *keys: str) -> DataFrame:
    """Rows of train and validation together of the chosen keys, on which the final model is fitted; those held out stay out."""
    return rows.where("split in ('train', 'val')").join(chosen.select(*keys).distinct(), list(keys), "left_semi")
