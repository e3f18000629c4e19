"""Queries of the pair signals over concepts, aliases and documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.columns import r6, usable
from gradus.operators import signals
from gradus.sources.tables import table, wide_table


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concepts").select("concept_id", "domain_id", "canonical_name", "definition").distinct()


def _names(spark: SparkSession, d: str) -> DataFrame:
    return signals.concept_names(_concepts(spark, d), table(spark, d, "concept_aliases").select("concept_id", "alias").distinct())


def _docs(spark: SparkSession, d: str) -> DataFrame:
    docs = wide_table(spark, d, "documents", "doc_id", "domain_id", "text", "source_type").where("text is not null")
    return docs.select("domain_id", F.col("doc_id").alias("unit"), "text", F.when(F.col("source_type") == "syllabus", 3).otherwise(1).alias("w"))


def _order(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return signals.order_signal(signals.mentions(_names(spark, d), docs), docs)


def _cooc(spark: SparkSession, d: str) -> DataFrame:
    units = signals.section_units(wide_table(spark, d, "documents", "doc_id", "domain_id", "text"))
    names = _concepts(spark, d).select("domain_id", "concept_id", F.lower("canonical_name").alias("name"))
    return signals.cooccurrence_signal(signals.mentions(names, units), units.agg(F.count("*").alias("n")))


def _definition(spark: SparkSession, d: str) -> DataFrame:
    return signals.definition_signal(_names(spark, d), _concepts(spark, d))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Partitioned by domain, so that a vector is shuffled once, to be made distinct."""
    rows = table(spark, d, "concepts").where(usable(F.col("embedding"), 64)).select("domain_id", "concept_id", "embedding")
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "domain_id").distinct()


def _evidence(spark: SparkSession, d: str) -> signals.Evidence:
    concepts, units = _concepts(spark, d), signals.section_units(wide_table(spark, d, "documents", "doc_id", "domain_id", "text"))
    own = concepts.select("domain_id", "concept_id", F.lower("canonical_name").alias("name"))
    return signals.Evidence.found(_names(spark, d), own, _docs(spark, d), units, concepts)


def q_mentions(spark: SparkSession, d: str) -> DataFrame:
    return signals.mentions(_names(spark, d), _docs(spark, d)).select(F.col("unit").alias("doc_id"), "concept_id", "pos")


def q_s_order(spark: SparkSession, d: str) -> DataFrame:
    return _order(spark, d).select("src", "dst", r6(F.col("s_order")).alias("s_order"))


def q_s_cooc(spark: SparkSession, d: str) -> DataFrame:
    return _cooc(spark, d).select("src", "dst", r6(F.col("s_cooc")).alias("s_cooc"))


def q_s_defmention(spark: SparkSession, d: str) -> DataFrame:
    return _definition(spark, d).select("src", "dst", r6(F.col("s_def")).alias("s_def"))


def q_s_sim_floor(spark: SparkSession, d: str) -> DataFrame:
    return signals.similarity_signal(_vectors(spark, d)).select("src", "dst", r6(F.col("s_sim")).alias("s_sim"))


def q_signal_merge(spark: SparkSession, d: str) -> DataFrame:
    m = signals.pruned(_vectors(spark, d), _evidence(spark, d))
    return m.select("src", "dst", *(r6(F.col(c)).alias(c) for c in m.columns[2:]))


def q_s_corr(spark: SparkSession, d: str) -> DataFrame:
    return signals.fuse(signals.pruned(_vectors(spark, d), _evidence(spark, d)), F.lit(0.5)).select("src", "dst", r6(F.col("s_corr")).alias("s_corr"), "forward")


def q_signal_profile(spark: SparkSession, d: str) -> DataFrame:
    p = signals.signal_profile(_vectors(spark, d), _evidence(spark, d))
    return p.select("signal", *(r6(F.col(c)).alias(c) for c in ("least", "median", "most")), "n")


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Judgements of an outside run: the scores of the rows of merge_pairs, as if a model had given them."""
    return table(spark, d, "merge_pairs").where("left_id is not null and right_id is not null and score is not null").select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"), F.col("score").alias("s"))


def q_plausible(spark: SparkSession, d: str) -> DataFrame:
    """Fused scores with verdicts on the three hundred best pairs of each source."""
    m = signals.pruned_plausible(_vectors(spark, d), _evidence(spark, d), _verdicts(spark, d))
    return signals.fuse(m, F.col("s_plaus"), keep=("s_plaus",)).select("src", "dst", r6(F.col("s_corr")).alias("s_corr"), r6(F.col("s_plaus")).alias("s_plaus"))


def q_heuristic_order(spark: SparkSession, d: str) -> DataFrame:
    return signals.pruned_order(_vectors(spark, d), _evidence(spark, d)).select("src", "dst", "heuristic", "place")


_BASE = """con AS (SELECT DISTINCT concept_id, domain_id, canonical_name, definition FROM concepts),
names AS (SELECT * FROM (SELECT domain_id, concept_id, lower(canonical_name) AS name FROM con UNION SELECT c.domain_id, a.concept_id, lower(a.alias) FROM concept_aliases a JOIN con c USING (concept_id)) WHERE length(trim(name, ' ')) >= 1),
docs AS (SELECT domain_id, doc_id, lower(text) AS t, CASE WHEN source_type = 'syllabus' THEN 3 ELSE 1 END AS w FROM documents WHERE text IS NOT NULL),
men AS (SELECT doc_id, concept_id, min(instr(t, name)) - 1 AS pos, any_value(w) AS w FROM docs JOIN names USING (domain_id) WHERE contains(t, name) GROUP BY ALL),
s_order AS (SELECT a.concept_id AS src, b.concept_id AS dst, sum(CASE WHEN a.pos < b.pos THEN a.w ELSE 0 END) / sum(a.w)::DOUBLE AS s FROM men a JOIN men b ON a.doc_id = b.doc_id AND a.concept_id <> b.concept_id GROUP BY ALL),
sec AS (SELECT domain_id, doc_id, unnest(s) AS t, unnest(range(len(s))) AS n FROM (SELECT domain_id, doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) >= 20) AS s FROM documents WHERE text IS NOT NULL)),
total AS (SELECT count(*) AS n FROM sec),
smen AS (SELECT DISTINCT s.doc_id, s.n, c.concept_id FROM sec s JOIN con c USING (domain_id) WHERE contains(lower(s.t), lower(c.canonical_name))),
one AS (SELECT concept_id, count(*) AS k FROM smen GROUP BY ALL),
two AS (SELECT a.concept_id AS src, b.concept_id AS dst, count(*) AS k FROM smen a JOIN smen b ON a.doc_id = b.doc_id AND a.n = b.n AND a.concept_id < b.concept_id GROUP BY ALL),
s_cooc AS (SELECT src, dst, greatest(0.0, least(1.0, (CASE WHEN two.k = total.n THEN 1.0 ELSE ln((two.k / total.n::DOUBLE) / ((a.k / total.n::DOUBLE) * (b.k / total.n::DOUBLE))) / -ln(two.k / total.n::DOUBLE) END + 1) / 2)) AS s FROM two JOIN one a ON a.concept_id = src JOIN one b ON b.concept_id = dst, total),
s_def AS (SELECT n.concept_id AS src, c.concept_id AS dst, max(0.5 + 0.5 * (1 - (instr(lower(c.definition), n.name) - 1) / length(c.definition)::DOUBLE)) AS s FROM con c JOIN names n USING (domain_id) WHERE n.concept_id <> c.concept_id AND length(c.definition) > 0 AND contains(lower(c.definition), n.name) GROUP BY ALL),
vec AS (SELECT DISTINCT domain_id, concept_id, embedding::DOUBLE[] AS v FROM concepts WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s_sim AS (SELECT a.concept_id AS src, b.concept_id AS dst, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM vec a JOIN vec b ON a.domain_id = b.domain_id AND a.concept_id < b.concept_id WHERE s >= 0.15)"""
_MERGE = """, merged AS (SELECT src, dst, coalesce(max(a), 0.0) AS order_fwd, coalesce(max(b), 0.0) AS order_rev, coalesce(max(c), 0.0) AS def_fwd, coalesce(max(e), 0.0) AS def_rev, coalesce(max(f), 0.0) AS cooc, coalesce(max(g), 0.0) AS sim FROM (
  SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CASE WHEN src < dst THEN s END AS a, CASE WHEN src > dst THEN s END AS b, NULL::DOUBLE AS c, NULL::DOUBLE AS e, NULL::DOUBLE AS f, NULL::DOUBLE AS g FROM s_order
  UNION ALL SELECT least(src, dst), greatest(src, dst), NULL, NULL, CASE WHEN src < dst THEN s END, CASE WHEN src > dst THEN s END, NULL, NULL FROM s_def
  UNION ALL SELECT src, dst, NULL, NULL, NULL, NULL, s, NULL FROM s_cooc UNION ALL SELECT src, dst, NULL, NULL, NULL, NULL, NULL, s FROM s_sim) GROUP BY ALL HAVING coalesce(max(g), 0.0) >= 0.15)"""


def _r(x: str) -> str:
    return f"floor(({x})::DOUBLE * 1e6 + 0.5) / 1e6"


_HEUR = """, h AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY heuristic DESC, dst) AS place FROM (SELECT *, floor((0.25 * greatest(order_fwd, order_rev) + 0.35 * greatest(def_fwd, def_rev) + 0.1 * cooc)::DOUBLE * 1e6 + 0.5) / 1e6 AS heuristic FROM merged))"""
_MERGED = ("order_fwd", "order_rev", "def_fwd", "def_rev", "cooc", "sim")
QUERIES = {f.__name__: f for f in (q_mentions, q_s_order, q_s_cooc, q_s_defmention, q_s_sim_floor, q_signal_merge, q_s_corr, q_plausible, q_heuristic_order, q_signal_profile)}
SQL = {
    "q_mentions": f"WITH {_BASE} SELECT doc_id, concept_id, pos FROM men",
    "q_s_order": f"WITH {_BASE} SELECT src, dst, {_r('s')} AS s_order FROM s_order",
    "q_s_cooc": f"WITH {_BASE} SELECT src, dst, {_r('s')} AS s_cooc FROM s_cooc",
    "q_s_defmention": f"WITH {_BASE} SELECT src, dst, {_r('s')} AS s_def FROM s_def",
    "q_s_sim_floor": f"WITH {_BASE} SELECT src, dst, {_r('s')} AS s_sim FROM s_sim",
    "q_signal_merge": f"WITH {_BASE} {_MERGE} SELECT src, dst, {', '.join(f'{_r(c)} AS {c}' for c in _MERGED)} FROM merged",
    "q_s_corr": f"WITH {_BASE} {_MERGE} SELECT src, dst, {_r('s')} AS s_corr, 0.35 * def_fwd + 0.25 * order_fwd >= 0.35 * def_rev + 0.25 * order_rev AS forward FROM (SELECT *, (0.25 * greatest(order_fwd, order_rev) + 0.35 * greatest(def_fwd, def_rev) + 0.1 * cooc + 0.3 * 0.5) / 1.0 AS s FROM merged) WHERE s >= 0.1",
    "q_heuristic_order": f"WITH {_BASE} {_MERGE} {_HEUR} SELECT src, dst, heuristic, place FROM h",
    "q_plausible": f"""WITH {_BASE} {_MERGE} {_HEUR}, v AS (SELECT least(left_id, right_id) AS src, greatest(left_id, right_id) AS dst, max(score) AS s FROM merge_pairs WHERE left_id IS NOT NULL AND right_id IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
        p AS (SELECT h.*, CASE WHEN place <= 300 THEN coalesce(v.s, 0.5) ELSE 0.5 END AS s_plaus FROM h LEFT JOIN v USING (src, dst))
        SELECT src, dst, {_r('s')} AS s_corr, {_r('s_plaus')} AS s_plaus FROM (SELECT *, (0.25 * greatest(order_fwd, order_rev) + 0.35 * greatest(def_fwd, def_rev) + 0.1 * cooc + 0.3 * s_plaus) / 1.0 AS s FROM p) WHERE s >= 0.1""",
    "q_signal_profile": f"WITH {_BASE} {_MERGE} " + " UNION ALL ".join(f"SELECT '{c}' AS signal, {_r(f'min({c})')} AS least, {_r(f'quantile_cont({c}, 0.5)')} AS median, {_r(f'max({c})')} AS most, count(*) AS n FROM merged" for c in _MERGED),
}
