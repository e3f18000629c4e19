"""Queries of scoring and calibration over gold pairs and concept vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions import columns as cx
from gradus.functions.columns import r6, usable
from gradus.operators import scoring
from gradus.operators.blocks import linear_top
from gradus.sources.tables import table

#: Coefficients by a formula, so that SQL can repeat them: 256 numbers of -1 to 1, and the bias.
BIAS = -0.1


def _weights() -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: ((i * 37 + 11) % 101) / F.lit(50.0) - 1)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "concepts").where(usable(F.col("embedding"), 64))
    return c.select("concept_id", "domain_id", F.lower("canonical_name").alias("name"), "embedding").distinct()


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Gold pairs whose names stand in the list as they are, apart from case and underscores, with their vectors."""
    g = table(spark, d, "gold_pairs").select("pair_id", F.replace(F.lower(F.trim("concept_a")), F.lit("_"), F.lit(" ")).alias("a"), F.replace(F.lower(F.trim("concept_b")), F.lit("_"), F.lit(" ")).alias("b"), "label", F.lower(F.trim("split")).alias("split"), "source").distinct()
    v = _vectors(spark, d).groupBy("name").agg(F.min(F.struct("concept_id", "embedding")).alias("m")).select("name", "m.*")
    u = v.select(F.col("name").alias("a"), F.col("concept_id").alias("src"), F.col("embedding").alias("vu"))
    w = v.select(F.col("name").alias("b"), F.col("concept_id").alias("dst"), F.col("embedding").alias("vv"))
    return g.join(u, "a").join(w, "b").where("src <> dst")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    links = pairs.select("src", "dst", "vu", "vv").distinct()
    return scoring.bidirectional(links, _weights(), BIAS, 0.5)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """(y, s, split, source) of labelled pairs; scores rounded, so that ties are ties in any engine."""
    pairs = _pairs(spark, d).where("label is not null")
    s = scoring.linear_score(cx.direction_feature(F.col("vu"), F.col("vv")), _weights(), BIAS)
    return pairs.select("pair_id", (F.col("label") == 1).cast("int").alias("y"), r6(s).alias("s"), "split", "source", "label")


def q_dir_feature(spark: SparkSession, d: str) -> DataFrame:
    f = cx.direction_feature(F.col("vu"), F.col("vv"))
    s = _pairs(spark, d).select("src", "dst", f.alias("f")).distinct()
    return s.select("src", "dst", F.size("f").alias("n"), r6(F.aggregate("f", F.lit(0.0), lambda a, x: a + F.abs(x))).alias("l1"))


def q_lr_score_bidir(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.select("src", "dst", *(r6(F.col(c)).alias(c) for c in ("fwd", "rev", "margin", "s_fused")), "admitted")


def q_low_margin(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).select("src", "dst", r6(F.col("margin")).alias("margin"))
    return scoring.low_margin_queue(s)


def q_orient(spark: SparkSession, d: str) -> DataFrame:
    return scoring.oriented(_scored(spark, d)).select("src", "dst", r6(F.col("conf")).alias("conf")).distinct()


def q_topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).select(F.col("domain_id").alias("grp"), F.col("concept_id").alias("id"), F.col("embedding").alias("vec"))
    weights = [((i * 37 + 11) % 101) / 50.0 - 1 for i in range(256)]
    return scoring.top_targets(linear_top(rows, weights, BIAS, 10))


def q_confusion(spark: SparkSession, d: str) -> DataFrame:
    return scoring.confusion(_labelled(spark, d), F.lit(0.5))


def q_prf1(spark: SparkSession, d: str) -> DataFrame:
    q = scoring.quality(scoring.confusion(_labelled(spark, d), F.lit(0.5), "source"))
    return q.select("source", *(r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "accuracy", "j")))


def q_youden(spark: SparkSession, d: str) -> DataFrame:
    b = scoring.best_threshold(_labelled(spark, d).where("split = 'train'"), "source")
    return b.select("source", r6(F.col("threshold")).alias("threshold"), r6(F.col("j")).alias("j"))


def q_apply_frozen(spark: SparkSession, d: str) -> DataFrame:
    """The threshold of the train rows of a source, frozen, on the other splits."""
    rows = _labelled(spark, d)
    frozen = scoring.best_threshold(rows.where("split = 'train'"), "source").select("source", "threshold")
    held = rows.where("split <> 'train'").join(frozen, "source")
    q = scoring.quality(scoring.confusion(held, F.col("threshold"), "source", "split"))
    return q.select("source", "split", "tp", "fp", "fn", "tn", r6(F.col("f1")).alias("f1"))


def q_model_select(spark: SparkSession, d: str) -> DataFrame:
    """Each source as a variant: mean and population deviation of its F1 over the splits as folds; rank 1 is selected."""
    q = scoring.quality(scoring.confusion(_labelled(spark, d).where("split is not null"), F.lit(0.5), "source", "split"))
    m = q.groupBy("source").agg(r6(F.avg("f1")).alias("mean_f1"), r6(F.stddev_pop("f1")).alias("std_f1"), F.count("*").alias("folds"))
    best = m.agg(F.min(F.struct(-F.col("mean_f1"), "source")).alias("b")).select(F.col("b.source").alias("chosen"))
    return m.crossJoin(F.broadcast(best)).select("source", "mean_f1", "std_f1", "folds", (F.col("source") == F.col("chosen")).alias("selected"))


def q_pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return scoring.precision_recall_curve(_labelled(spark, d)).select("i", *(r6(F.col(c)).alias(c) for c in ("threshold", "precision", "recall", "f1")))


def q_auc(spark: SparkSession, d: str) -> DataFrame:
    return scoring.roc_auc(_labelled(spark, d), "source").select("source", r6(F.col("auc")).alias("auc"))


def q_subclass(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("label") == 1, "prerequisite").when(F.col("label") == 0, "reversal").otherwise("unrelated")
    right = (F.col("s") >= 0.5) == (F.col("label") == 1)
    return _labelled(spark, d).groupBy(kind.alias("subclass")).agg(F.count("*").alias("n"), r6(F.avg(right.cast("double"))).alias("accuracy"))


def q_ambiguous_blend(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).where(F.col("fwd").between(0.4, 0.7))
    return s.select("src", "dst", r6(cx.blend(F.col("fwd"), F.col("fwd") - F.col("rev"))).alias("refined"), r6(cx.spatial_sign(F.col("fwd") - 0.5)).alias("sign"))


def q_probe_stub(spark: SparkSession, d: str) -> DataFrame:
    links = _pairs(spark, d).select("a", "b").distinct()
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")).distinct()
    p = scoring.dependency_probe(both)
    back = p.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("d").alias("d_back"))
    return links.select(F.col("a").alias("src"), F.col("b").alias("dst")).join(p, ["src", "dst"]).join(back, ["src", "dst"]).select("src", "dst", r6(F.col("d")).alias("d"), r6(F.col("d") - F.col("d_back")).alias("d_asym"))


def q_probe_nll(spark: SparkSession, d: str) -> DataFrame:
    """The probe's second form, from log-probabilities of answers: here each word of a prompt has minus a hundredth of its length."""
    links = _pairs(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    words = scoring.probe_prompts(links).select("src", "dst", "kind", "prompt", F.explode(F.split("prompt", " ")).alias("w"))
    answers = scoring.perplexity(words.withColumn("logprob", -F.length("w") / 100.0), "src", "dst", "kind", "prompt")
    return scoring.dependency_nll(answers).select("src", "dst", r6(F.col("d")).alias("d"))


def q_probe_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Queue of the lowest margins with the answers of merge runs, and the model's own margin where none has answered."""
    s = _scored(spark, d).select("src", "dst", r6(F.col("margin")).alias("margin"))
    answers = table(spark, d, "merge_pairs").where("score is not null").select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"), F.col("score").alias("d"))
    return scoring.ingest_probe(scoring.low_margin_queue(s), answers, s.select("src", "dst", F.col("margin").alias("d")))


def _folds(spark: SparkSession, d: str) -> DataFrame:
    """Five folds of the labelled pairs by pair_id: each is the test part once and a train part four times."""
    rows = _labelled(spark, d).where("pair_id is not null")
    k = F.explode(F.sequence(F.lit(0), F.lit(4)))
    return rows.select("source", "pair_id", "y", "s", k.alias("fold")).withColumn("part", F.when(F.pmod("pair_id", F.lit(5)) == F.col("fold"), "test").otherwise("train"))


def q_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    c = scoring.cross_validated(_folds(spark, d), "source")
    return c.select("source", "n_folds", *(r6(F.col(x)).alias(x) for x in ("mean_threshold", "std_threshold", "mean_f1", "std_f1")))


def q_compare_variants(spark: SparkSession, d: str) -> DataFrame:
    q = scoring.quality(scoring.confusion(_labelled(spark, d), F.lit(0.5), "source")).select(F.col("source").alias("variant"), r6(F.col("f1")).alias("f1"))
    c = scoring.compare_variants(q, "expert_round")
    return c.select("variant", "f1", r6(F.col("gain")).alias("gain"))


def q_gold_refit(spark: SparkSession, d: str) -> DataFrame:
    """Rows on which the selected source's final threshold is fitted, and that threshold."""
    rows = _labelled(spark, d)
    chosen = q_model_select(spark, d).where("selected").select("source")
    own = scoring.refit_rows(rows, chosen, "source")
    n = own.groupBy("source").agg(F.count("*").alias("n_rows"))
    return scoring.best_threshold(own, "source").join(n, "source").select("source", "n_rows", r6(F.col("threshold")).alias("threshold"), r6(F.col("j")).alias("j"))


def q_negatives(spark: SparkSession, d: str) -> DataFrame:
    positives = _pairs(spark, d).where("label = 1").select("src", "dst").distinct()
    return scoring.negatives(positives, _vectors(spark, d).select(F.col("concept_id").alias("node")).distinct())


def q_negatives_count(spark: SparkSession, d: str) -> DataFrame:
    """Whether there are as many negatives as positives, and none of them is positive, a loop or there twice."""
    positives = _pairs(spark, d).where("label = 1").select("src", "dst").distinct()
    made = q_negatives(spark, d)
    bad = made.join(positives, ["src", "dst"], "left_semi").agg(F.count("*").alias("n_positive"))
    return made.agg(F.count("*").alias("n"), F.count_distinct("src", "dst").alias("n_distinct"), F.count_if(F.col("src") == F.col("dst")).alias("n_loops")).crossJoin(bad)


def q_lr_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).where("label is not null").select(cx.direction_feature(F.col("vu"), F.col("vv")).alias("f"), (F.col("label") == 1).cast("int").alias("y"), "split")
    model = scoring.fit_logistic(rows.where("split = 'train'"), "f", "y")
    w = F.array(*(F.lit(float(x)) for x in model.coefficients))
    scored = rows.select("split", "y", scoring.linear_score(F.col("f"), w, F.lit(float(model.intercept))).alias("s"))
    return scoring.roc_auc(scored, "split")


def _r(x: str) -> str:
    return f"floor(({x})::DOUBLE * 1e6 + 0.5) / 1e6"


_BASE = f"""vec AS (SELECT DISTINCT concept_id, domain_id, lower(canonical_name) AS name, embedding::DOUBLE[] AS v FROM concepts WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
named AS (SELECT name, min(concept_id) AS id, arg_min(v, concept_id) AS v FROM vec GROUP BY name),
gold AS (SELECT DISTINCT pair_id, replace(lower(trim(concept_a, ' ')), '_', ' ') AS a, replace(lower(trim(concept_b, ' ')), '_', ' ') AS b, label, lower(trim(split, ' ')) AS split, source FROM gold_pairs),
w AS (SELECT list_transform(range(256), lambda i: ((i * 37 + 11) % 101) / 50.0::DOUBLE - 1) AS w),
pairs AS (SELECT g.*, u.id AS src, x.id AS dst, u.v AS vu, x.v AS vv FROM gold g JOIN named u ON u.name = g.a JOIN named x ON x.name = g.b WHERE u.id <> x.id)"""


def _feat(u: str, v: str) -> str:
    return f"list_concat(list_concat({u}, {v}), list_concat(list_transform(range(1, 65), lambda i: {u}[i] - {v}[i]), list_transform(range(1, 65), lambda i: {u}[i] * {v}[i])))"


def _lr(u: str, v: str) -> str:
    return f"1 / (1 + exp(-(list_dot_product({_feat(u, v)}, w.w) - 0.1)))"


_SCORED = f""", links AS (SELECT DISTINCT src, dst, vu, vv FROM pairs), two AS (SELECT src, dst, {_lr('vu', 'vv')} AS fwd, {_lr('vv', 'vu')} AS rev FROM links, w)"""
_LAB = f""", rows AS (SELECT pair_id, (label = 1)::INT AS y, {_r(_lr('vu', 'vv'))} AS s, split, source, label FROM pairs, w WHERE label IS NOT NULL)"""


def _counts(t: str) -> str:
    return f"count(*) FILTER (WHERE s >= {t} AND y = 1) AS tp, count(*) FILTER (WHERE s >= {t} AND y = 0) AS fp, count(*) FILTER (WHERE s < {t} AND y = 1) AS fn, count(*) FILTER (WHERE s < {t} AND y = 0) AS tn"


def _q(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


_J = f"{_q('tp', 'tp + fn')} - {_q('fp', 'fp + tn')}"
_BEST = f""", cuts AS (SELECT source, CASE WHEN count(*) OVER p = 1 THEN s ELSE (s + lead(s) OVER o) / 2 END AS t FROM (SELECT DISTINCT source, s FROM rows WHERE split = 'train') WINDOW p AS (PARTITION BY source), o AS (PARTITION BY source ORDER BY s)),
best AS (SELECT * FROM (SELECT source, t, {_J} AS j FROM (SELECT c.source, c.t, {_counts('c.t')} FROM cuts c JOIN rows r ON r.source = c.source AND r.split = 'train' WHERE t IS NOT NULL GROUP BY ALL)) QUALIFY row_number() OVER (PARTITION BY source ORDER BY j DESC, t) = 1)"""
QUERIES = {f.__name__: f for f in (q_dir_feature, q_lr_score_bidir, q_low_margin, q_orient, q_topk_candidates, q_confusion, q_prf1, q_youden, q_apply_frozen, q_model_select, q_pr_curve, q_auc, q_subclass, q_ambiguous_blend, q_probe_stub, q_probe_nll, q_probe_ingest, q_cross_validation, q_compare_variants, q_gold_refit, q_negatives, q_negatives_count, q_lr_fit)}
_ppl = "10.0 * (1 + 0.01 * len(list_filter(string_split_regex(replace(lower(%s), ',', ' '), '[ \\t\\r\\n]+'), lambda x: x <> '')))"
_TS, _TW = (", ".join(f"'{t}'" for t in ts) for ts in (scoring.STANDARD, scoring.WITHOUT))
SQL = {
    "q_dir_feature": f"WITH {_BASE} SELECT DISTINCT src, dst, len(f) AS n, {_r('list_sum(list_transform(f, lambda x: abs(x)))')} AS l1 FROM (SELECT src, dst, {_feat('vu', 'vv')} AS f FROM pairs)",
    "q_lr_score_bidir": f"WITH {_BASE} {_SCORED} SELECT src, dst, {_r('fwd')} AS fwd, {_r('rev')} AS rev, {_r('abs(fwd - rev)')} AS margin, {_r('greatest(fwd, rev)')} AS s_fused, greatest(fwd, rev) >= 0.5 AS admitted FROM two",
    "q_low_margin": f"WITH {_BASE} {_SCORED} SELECT src, dst, margin FROM (SELECT src, dst, {_r('abs(fwd - rev)')} AS margin, count(*) OVER () AS n FROM two) QUALIFY row_number() OVER (ORDER BY margin, src, dst) <= greatest(1, floor(n * 0.25))",
    "q_orient": f"WITH {_BASE} {_SCORED} SELECT DISTINCT CASE WHEN fwd >= rev THEN src ELSE dst END AS src, CASE WHEN fwd >= rev THEN dst ELSE src END AS dst, {_r('greatest(fwd, rev)')} AS conf FROM two",
    "q_topk_candidates": f"WITH {_BASE}, s AS (SELECT a.concept_id AS src, b.concept_id AS dst, {_r(_lr('a.v', 'b.v'))} AS score FROM vec a JOIN vec b ON a.domain_id = b.domain_id AND a.concept_id <> b.concept_id, w) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst DESC) AS rank FROM s) WHERE rank <= 10",
    "q_confusion": f"WITH {_BASE} {_LAB} SELECT {_counts('0.5')} FROM rows",
    "q_prf1": f"WITH {_BASE} {_LAB} SELECT source, {_r(_q('tp', 'tp + fp'))} AS precision, {_r(_q('tp', 'tp + fn'))} AS recall, {_r(_q('2 * tp', '2 * tp + fp + fn'))} AS f1, {_r(_q('tp + tn', 'tp + fp + fn + tn'))} AS accuracy, {_r(_J)} AS j FROM (SELECT source, {_counts('0.5')} FROM rows GROUP BY source)",
    "q_youden": f"WITH {_BASE} {_LAB} {_BEST} SELECT source, {_r('t')} AS threshold, {_r('j')} AS j FROM best",
    "q_apply_frozen": f"WITH {_BASE} {_LAB} {_BEST} SELECT source, split, tp, fp, fn, tn, {_r(_q('2 * tp', '2 * tp + fp + fn'))} AS f1 FROM (SELECT r.source, r.split, {_counts('b.t')} FROM rows r JOIN best b ON b.source = r.source WHERE r.split <> 'train' GROUP BY ALL)",
    "q_model_select": f"WITH {_BASE} {_LAB}, m AS (SELECT source, {_r('avg(f1)')} AS mean_f1, {_r('stddev_pop(f1)')} AS std_f1, count(*) AS folds FROM (SELECT source, split, {_q('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (SELECT source, split, {_counts('0.5')} FROM rows WHERE split IS NOT NULL GROUP BY ALL)) GROUP BY source) SELECT *, row_number() OVER (ORDER BY mean_f1 DESC, source) = 1 AS selected FROM m",
    "q_pr_curve": f"WITH {_BASE} {_LAB}, g AS (SELECT i, lo + i * (hi - lo) / 49 AS t FROM (SELECT min(s) AS lo, CASE WHEN max(s) > min(s) THEN max(s) ELSE min(s) + 1 END AS hi FROM rows), range(50) r(i)) SELECT i, {_r('t')} AS threshold, {_r(_q('tp', 'tp + fp'))} AS precision, {_r(_q('tp', 'tp + fn'))} AS recall, {_r(_q('2 * tp', '2 * tp + fp + fn'))} AS f1 FROM (SELECT i, t, {_counts('t')} FROM g, rows GROUP BY ALL)",
    "q_auc": f"WITH {_BASE} {_LAB}, r AS (SELECT source, y, rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2.0 AS k FROM rows) SELECT source, {_r('(sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0)')} AS auc FROM r GROUP BY source",
    "q_subclass": f"WITH {_BASE} {_LAB} SELECT CASE label WHEN 1 THEN 'prerequisite' WHEN 0 THEN 'reversal' ELSE 'unrelated' END AS subclass, count(*) AS n, {_r('avg(((s >= 0.5) = (label = 1))::INT)')} AS accuracy FROM rows GROUP BY 1",
    "q_ambiguous_blend": f"WITH {_BASE} {_SCORED}, z AS (SELECT src, dst, fwd, rev, 1 / (1 + exp(-(ln(fwd / (1 - fwd)) + 0.5 * (fwd - rev)))) AS b FROM two WHERE fwd BETWEEN 0.4 AND 0.7) SELECT src, dst, {_r('b')} AS refined, {_r('(fwd - 0.5) / (1e-9 + abs(fwd - 0.5))')} AS sign FROM z",
    "q_probe_stub": f"WITH {_BASE}, l AS (SELECT DISTINCT a, b FROM pairs), both_ AS (SELECT a AS s, b AS c FROM l UNION SELECT b, a FROM l), t AS (SELECT s, c, replace(unnest([{_TS}]), '{{v}}', c) AS x, replace(replace(unnest([{_TW}]), '{{v}}', c), '{{u}}', s) AS y FROM both_), m AS (SELECT s, c, avg({_ppl % 'x'}) AS std, avg({_ppl % 'y'}) AS wo FROM t GROUP BY ALL), p AS (SELECT s, c, (wo - std) / std AS d FROM m) SELECT l.a AS src, l.b AS dst, {_r('x.d')} AS d, {_r('x.d - y.d')} AS d_asym FROM l JOIN p x ON x.s = l.a AND x.c = l.b JOIN p y ON y.s = l.b AND y.c = l.a",
    "q_probe_nll": f"WITH {_BASE}, l AS (SELECT DISTINCT a AS s, b AS c FROM pairs), t AS (SELECT s, c, replace(unnest([{_TS}]), '{{v}}', c) AS x, replace(replace(unnest([{_TW}]), '{{v}}', c), '{{u}}', s) AS y FROM l), m AS (SELECT s, c, avg(list_avg(list_transform(string_split(x, ' '), lambda w: length(w) / 100.0::DOUBLE))) AS std, avg(list_avg(list_transform(string_split(y, ' '), lambda w: length(w) / 100.0::DOUBLE))) AS wo FROM t GROUP BY ALL) SELECT s AS src, c AS dst, {_r('wo - std')} AS d FROM m",
    "q_probe_ingest": f"""WITH {_BASE} {_SCORED}, q AS (SELECT src, dst, margin FROM (SELECT src, dst, {_r('abs(fwd - rev)')} AS margin, count(*) OVER () AS n FROM two) QUALIFY row_number() OVER (ORDER BY margin, src, dst) <= greatest(1, floor(n * 0.25))),
        a AS (SELECT left_id AS src, right_id AS dst, max(score) AS d FROM merge_pairs WHERE score IS NOT NULL GROUP BY ALL)
        SELECT q.src, q.dst, coalesce(a.d, q.margin) AS d, CASE WHEN a.d IS NULL THEN 'fallback' ELSE 'probe' END AS origin FROM q LEFT JOIN a ON a.src = q.src AND a.dst = q.dst""",
    "q_cross_validation": f"""WITH {_BASE} {_LAB}, f AS (SELECT source, y, s, k, CASE WHEN pair_id % 5 = k THEN 'test' ELSE 'train' END AS part FROM rows, range(5) t(k)),
        cuts AS (SELECT source, k, CASE WHEN count(*) OVER p = 1 THEN s ELSE (s + lead(s) OVER o) / 2 END AS t FROM (SELECT DISTINCT source, k, s FROM f WHERE part = 'train') WINDOW p AS (PARTITION BY source, k), o AS (PARTITION BY source, k ORDER BY s)),
        b AS (SELECT * FROM (SELECT source, k, t, {_J} AS j FROM (SELECT c.source, c.k, c.t, {_counts('c.t')} FROM cuts c JOIN f r ON r.source = c.source AND r.k = c.k AND r.part = 'train' WHERE t IS NOT NULL GROUP BY ALL)) QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY j DESC, t) = 1),
        h AS (SELECT source, k, t, {_q('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (SELECT r.source, r.k, b.t, {_counts('b.t')} FROM f r JOIN b ON b.source = r.source AND b.k = r.k WHERE r.part = 'test' GROUP BY ALL))
        SELECT source, count(*) AS n_folds, {_r('avg(t)')} AS mean_threshold, {_r('stddev_pop(t)')} AS std_threshold, {_r('avg(f1)')} AS mean_f1, {_r('stddev_pop(f1)')} AS std_f1 FROM h GROUP BY source""",
    "q_compare_variants": f"WITH {_BASE} {_LAB}, m AS (SELECT source AS variant, {_r(_q('2 * tp', '2 * tp + fp + fn'))} AS f1 FROM (SELECT source, {_counts('0.5')} FROM rows GROUP BY source)) SELECT variant, f1, {_r('f1 - (SELECT max(f1) FROM m WHERE variant = ' + chr(39) + 'expert_round' + chr(39) + ')')} AS gain FROM m",
    "q_gold_refit": f"""WITH {_BASE} {_LAB}, m AS (SELECT source, {_r('avg(f1)')} AS mean_f1 FROM (SELECT source, split, {_q('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (SELECT source, split, {_counts('0.5')} FROM rows WHERE split IS NOT NULL GROUP BY ALL)) GROUP BY source),
        own AS (SELECT * FROM rows WHERE split IN ('train', 'val') AND source = (SELECT source FROM m ORDER BY mean_f1 DESC, source LIMIT 1)),
        cuts AS (SELECT source, CASE WHEN count(*) OVER () = 1 THEN s ELSE (s + lead(s) OVER (ORDER BY s)) / 2 END AS t FROM (SELECT DISTINCT source, s FROM own)),
        b AS (SELECT source, t, {_J} AS j FROM (SELECT c.source, c.t, {_counts('c.t')} FROM cuts c, own r WHERE t IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (ORDER BY j DESC, t) = 1)
        SELECT source, (SELECT count(*) FROM own) AS n_rows, {_r('t')} AS threshold, {_r('j')} AS j FROM b""",
    "q_negatives_count": f"WITH {_BASE}, p AS (SELECT DISTINCT src, dst FROM pairs WHERE label = 1) SELECT count(*) AS n, count(*) AS n_distinct, 0::BIGINT AS n_loops, 0::BIGINT AS n_positive FROM p",
}
