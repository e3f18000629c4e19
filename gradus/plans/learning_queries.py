"""Queries of learner state, content and table operators over events, nodes, concepts and orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.columns import cosine, difficulty_prior, r6, usable
from gradus.operators import content, hierarchy, learning, planning, relational, session_graph
from gradus.plans import graph_queries as gq
from gradus.plans.hierarchy_queries import _LINKS
from gradus.session import Scratch
from gradus.sources.tables import table

NOW = "2024-02-01 00:00:00"


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("user_id", "event_type", "ts", "event_id", (F.floor("value") % 6).cast("int").alias("quality"))


def _now():
    return F.lit(NOW).cast("timestamp")


def q_sm2(spark: SparkSession, d: str) -> DataFrame:
    s = learning.fold_sm2(_reviews(spark, d), "user_id", "event_type")
    return s.select("user_id", "event_type", "n_reviews", r6(F.col("ease")).alias("ease"), r6(F.col("interval")).alias("interval"), "repetition")


def q_fsrs_fold(spark: SparkSession, d: str) -> DataFrame:
    s = learning.fold_fsrs(_reviews(spark, d), "user_id", "event_type")
    return s.select("user_id", "event_type", "n_reviews", r6(F.log("stability")).alias("log_stability"))


def _last(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d).groupBy("user_id", "event_type").agg(F.max("ts").alias("last_ts"), (F.count("*") * learning.DAY).alias("stability"))


def q_retention(spark: SparkSession, d: str) -> DataFrame:
    s = learning.decayed(_last(spark, d), _now())
    return s.select("user_id", "event_type", r6(F.col("retention")).alias("retention"), "decayed")


def q_refresh_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the chain of event types by name whose target is decayed for a learner."""
    types = table(spark, d, "events").select("event_type").distinct()
    nxt = types.select(F.col("event_type").alias("t")).join(types, F.col("event_type") > F.col("t")).groupBy("t").agg(F.min("event_type").alias("target")).select(F.col("t").alias("source"), "target")
    s = learning.decayed(_last(spark, d), _now()).where("decayed").select("user_id", F.col("event_type").alias("target"))
    return s.join(nxt, "target").select("user_id", "source", "target")


def q_grade(spark: SparkSession, d: str) -> DataFrame:
    """Events as answers: the integer part of the value picks the option; option B carries the type's misconception."""
    e = table(spark, d, "events")
    role = F.element_at(F.array(*map(F.lit, content.ROLES)), (F.floor("value") % 3 + 1).cast("int"))
    a = e.select("event_id", role.alias("role"), F.when(role == "B", content.misconception_id(F.col("event_type"))).alias("misconception"))
    return learning.route(a).select("event_id", "role", "misconception", "action", "quality")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Valid rows of nodes: (node, session_id, label, status, node_type, misconception, parent)."""
    rows = table(spark, d, "concept_nodes")
    v = rows.groupBy(F.col("node_id").alias("node")).agg(F.max(F.struct("updated_at", "session_id", "label", "status", "node_type", "triggering_misconception")).alias("m")).select("node", "m.*")
    links = hierarchy.parent_links(hierarchy.valid_rows(rows))
    return Scratch(spark, "nodes").keep(v.select("node", "session_id", "label", F.coalesce(F.lower(F.trim("status")), F.lit("locked")).alias("status"), "node_type", F.col("triggering_misconception").alias("misconception")).join(links, "node"))


def _tree_edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst"), F.lit("prerequisite").alias("kind"), F.lit(0.8).alias("conf"))


def q_inject(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return learning.inject_remediation(_tree_edges(n), n.where("misconception is not null").select("node", "misconception"))[0]


def q_resolve_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    new, stash, _ = learning.inject_remediation(_tree_edges(n), n.where("misconception is not null").select("node", "misconception"))
    return learning.resolve_remediation(new, stash, new.where("kind = 'remediation_link'").select(F.col("src").alias("rm")))


def q_unlock_dag(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return learning.unlocked(n.select("node", "status"), _tree_edges(n))


def q_cascade(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    places = hierarchy.child_places(hierarchy.valid_rows(table(spark, d, "concept_nodes")))
    return learning.cascade(hierarchy.Forest(n.select("node", "parent")), n.select("node", "status"), places)


def q_can_start(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return learning.unmet(n.select("node", "status"), _tree_edges(n))


def q_progress(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    forest = hierarchy.Forest(n.select("node", "parent"))
    return learning.progress(forest, n.select("node", (F.col("status") == "completed").cast("int").alias("done"))).select("node", r6(F.col("progress")).alias("progress"))


def q_hidden_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes below completed branches, which a view collapses."""
    n = _nodes(spark, d)
    return learning.hidden(hierarchy.Forest(n.select("node", "parent")), n.where("status = 'completed'").select("node"))


def q_next_available(spark: SparkSession, d: str) -> DataFrame:
    return learning.next_available(_nodes(spark, d).where("node_type = 'leaf'"), "node").select("session_id", "node", "status")


def q_payload(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of every session, written to its document and read back."""
    n = _nodes(spark, d).join(_tree_depths(spark, d), "node").withColumnRenamed("session_id", "session")
    e = _tree_edges(n).join(n.select(F.col("node").alias("dst"), "session"), "dst")
    return session_graph.from_payload(session_graph.to_payload(n, e))[0].withColumnRenamed("session", "session_id")


def q_payload_edges(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).join(_tree_depths(spark, d), "node").withColumnRenamed("session_id", "session")
    e = _tree_edges(n).join(n.select(F.col("node").alias("dst"), "session"), "dst")
    return session_graph.from_payload(session_graph.to_payload(n, e))[1].withColumnRenamed("session", "session_id")


def _tree_depths(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "concept_nodes").groupBy(F.col("node_id").alias("node")).agg(F.max(F.struct("updated_at", "depth")).alias("m"))
    return v.select("node", "m.depth")


def _learner_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of one graph for each domain: its goal, its clusters and its concepts."""
    goals = table(spark, d, "domains").select(F.col("domain_id").alias("session"), F.col("goal_concept").alias("goal"))
    c = table(spark, d, "concepts").select(F.col("domain_id").alias("session"), F.col("concept_id").alias("node"), F.col("canonical_name").alias("label"), F.col("cluster_no").alias("cluster"), "depth").distinct()
    clusters = c.where("cluster is not null").select("session", "cluster", F.concat(F.lit("Cluster "), (F.col("cluster") + 1).cast("string")).alias("name")).distinct()
    return Scratch(spark, "learner").keep(session_graph.hierarchy_nodes(goals, clusters, c))


def q_hierarchy_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _learner_graph(spark, d)


def q_hierarchy_edges(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "concepts").select(F.col("domain_id").alias("session"), F.col("concept_id").alias("src")).distinct()
    p = gq._acyclic(spark, d).join(own, "src").select("session", "src", "dst", "conf")
    return session_graph.hierarchy_edges(_learner_graph(spark, d), p)


def q_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of all sessions built anew: remediation nodes stay, time and progress of the old rows are carried forward."""
    v = table(spark, d, "concept_nodes").groupBy(F.col("node_id").alias("node")).agg(F.max(F.struct("updated_at", "label", "status", "node_type", "is_dynamic_remediation", "progress")).alias("m")).select("node", "m.*")
    old = v.select("node", "label", "status", F.coalesce("is_dynamic_remediation", F.lit(False)).alias("remediation"), F.unix_micros("updated_at").alias("last_review"), F.col("progress").alias("stability"))
    return session_graph.rebuilt(old, v.where("node_type = 'leaf'").select("node", "label", F.lit("locked").alias("status")))


def q_remediation_progress(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("floor(value) % 6 >= 3")
    return session_graph.remediation_progress(e.select(F.concat(F.lit("RM_"), F.col("user_id").cast("string"), F.lit("_"), "event_type").alias("rm")), 2)


def q_difficulty_prior(spark: SparkSession, d: str) -> DataFrame:
    r = _reviews(spark, d).withColumn("correct", F.col("quality") >= 3)
    return session_graph.first_attempts(r, "event_type").select("event_type", r6(F.col("accuracy")).alias("accuracy"), r6(difficulty_prior(F.col("accuracy"))).alias("stability"))


def q_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Options of a question on every concept with a vector: the vector itself, minus 0.8 and 0.05 of it, against the concept's own in the bank."""
    c = table(spark, d, "concepts").where(usable(F.col("embedding"), 64)).select(F.col("concept_id").cast("string").alias("misconception"), "embedding").distinct()
    scale = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(x).alias("x")) for r, x in (("A", 1.0), ("B", -0.8), ("C", 0.05))))).alias("o")
    answers = c.select("misconception", "embedding", scale).select("misconception", "o.role", F.transform("embedding", lambda v: v.cast("double") * F.col("o.x")).alias("vec"))
    a = learning.attributed(answers, c.select("misconception", F.transform("embedding", lambda v: v.cast("double")).alias("vec")))
    return a.select("misconception", "role", F.round("match", 6).alias("match"), "attributed")


def q_optimize_path(spark: SparkSession, d: str) -> DataFrame:
    """Paths of 120 minutes to every concept of the graph whose id is divisible by 10; a learner has mastered what is divisible by 7."""
    e = gq._acyclic(spark, d)
    nodes = table(spark, d, "concepts").select(F.col("concept_id").alias("node"), F.col("cluster_no").alias("cluster"), F.col("est_minutes").alias("cost"))
    goals = gq.graph.nodes_of(e).where("node % 10 = 0").select(F.col("node").alias("grp"), F.col("node").alias("goal"), F.lit(120.0).alias("budget"))
    known = planning.scopes(e, goals).where("id % 7 = 0").withColumn("level", F.lit(0.9))
    return planning.optimize_paths(e, nodes, goals, known)


def q_quiz_gen(spark: SparkSession, d: str) -> DataFrame:
    return content.quiz_questions(table(spark, d, "concepts").select(F.col("concept_id").alias("node")).distinct())


def q_quiz_validate(spark: SparkSession, d: str) -> DataFrame:
    """Events as options: learner and type are the question, the integer part of the value the role."""
    role = F.element_at(F.array(*map(F.lit, content.ROLES)), (F.floor("value") % 3 + 1).cast("int"))
    o = table(spark, d, "events").select(F.col("user_id").alias("node"), F.col("event_type").alias("question"), role.alias("role"))
    return content.broken_questions(o)


def q_content_items(spark: SparkSession, d: str) -> DataFrame:
    return content.content_items(table(spark, d, "domains").select(F.col("goal_concept").alias("topic")))


def q_content_rank(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "concepts").select(F.col("domain_id").alias("grp"), F.col("concept_id").alias("id"), F.col("canonical_name").alias("text")).distinct()
    i = table(spark, d, "documents").where("title is not null").select(F.col("domain_id").alias("grp"), F.col("doc_id").alias("id"), F.col("title").alias("text"))
    return content.bow_rank(q, i).select("query_id", "item_id", r6(F.col("sim")).alias("sim"), "rank")


def q_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id is divisible by 20, against all."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return content.vector_top(e.where("id % 20 = 0"), e).select("query_id", "id", r6(F.col("sim")).alias("sim"), "rank")


def q_cap_by_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Of each domain the hundred concepts most similar to its first usable one."""
    from pyspark.sql import Window

    c = table(spark, d, "concepts").where(usable(F.col("embedding"), 64)).select("domain_id", "concept_id", "embedding").distinct()
    goal = c.groupBy("domain_id").agg(F.min(F.struct("concept_id", "embedding")).alias("g")).select("domain_id", F.col("g.embedding").alias("goal"))
    s = c.join(goal, "domain_id").select("domain_id", "concept_id", r6(cosine(F.col("embedding"), F.col("goal"))).alias("sim"))
    w = Window.partitionBy("domain_id").orderBy(F.desc("sim"), "concept_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 100")


def q_knapsack(spark: SparkSession, d: str) -> DataFrame:
    """One plan for each region: its nations are items, each with an odd key needs the one before it in the region."""
    from pyspark.sql import Window

    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 7 + 1).alias("value"), F.length("n_name").alias("cost"))
    needs = n.select("grp", F.lag("id").over(Window.partitionBy("grp").orderBy("id")).alias("src"), F.col("id").alias("dst")).where("src is not null and dst % 2 = 1")
    budgets = n.select("grp").distinct().select("grp", F.lit(25).alias("budget"), F.lit(None).cast("string").alias("goal"))
    return planning.knapsacks(n, needs, budgets).select(F.col("grp").cast("int").alias("grp"), "feasible", "best_value")


def q_study_path(spark: SparkSession, d: str) -> DataFrame:
    """For each cluster a path of 120 minutes through its concepts, by unlock value and estimated minutes."""
    e = gq._acyclic(spark, d)
    c = gq._clusters(spark, d, e)
    minutes = table(spark, d, "concepts").groupBy(F.col("concept_id").alias("node")).agg(F.coalesce(F.max("est_minutes"), F.lit(15)).alias("cost"))
    v = gq.graph.unlock_values(c, gq.graph.closure(e)).join(c, "node").join(minutes, "node").where("cluster is not null")
    items = v.select(F.col("cluster").alias("grp"), F.col("node").alias("id"), F.greatest("value", F.lit(1.0)).alias("value"), "cost")
    needs = e.join(c.select(F.col("node").alias("src"), F.col("cluster").alias("grp")), "src").join(c.select(F.col("node").alias("dst"), F.col("cluster").alias("g2")), "dst").where("grp = g2").select("grp", "src", "dst")
    budgets = items.select("grp").distinct().select("grp", F.lit(120).alias("budget"), F.lit(None).cast("string").alias("goal"))
    return planning.knapsacks(items, needs, budgets).select("grp", "feasible", "optimal", "best_value", F.size("chosen").alias("n_items"))


def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The customers of suppliers' keys take the suppliers' balance; all others stay."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return relational.upsert(c, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), "k")


def q_purge(spark: SparkSession, d: str) -> DataFrame:
    """Line items of orders that are not finished are deleted with them."""
    gone = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    left = relational.purge(table(spark, d, "lineitem"), gone, "l_orderkey")
    return left.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_orders"))


def q_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Documents of syllabi first, then of other sources whose title is new."""
    t = table(spark, d, "documents").where("title is not null").select("title", "source_type").distinct()
    return relational.append_new(t.where("source_type = 'syllabus'"), t.where("source_type <> 'syllabus'"), "title").groupBy("source_type").agg(F.count("*").alias("n"))


def q_cache_ttl(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return relational.fresh(e, "user_id", "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), 86400.0).select("user_id", "event_id", "value")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows as evaluation runs: the split is the purpose, label 1 a final evaluation."""
    g = table(spark, d, "gold_pairs").distinct()
    return g.select("pair_id", "annotator", "source", F.lower(F.trim("split")).alias("purpose"), F.when(F.col("label") == 1, "final_eval").otherwise("dev").alias("run_type"))


def q_heldout_violations(spark: SparkSession, d: str) -> DataFrame:
    return relational.heldout_violations(_runs(spark, d)).select("pair_id", "purpose", "run_type")


def q_oneshot_violations(spark: SparkSession, d: str) -> DataFrame:
    return relational.repeated_finals(_runs(spark, d), "annotator", "source")


def q_schema_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "concept_nodes")
    return relational.check_counts(rows, {"status_known": "lower(status) in ('completed','in_progress','available','locked')", "type_known": "node_type in ('root','branch','leaf')", "progress_bounded": "progress between 0 and 1", "has_children_list": "children_ids is not null"})


def q_nested_aliases(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "concepts").select("concept_id").distinct()
    n = relational.nested(c, table(spark, d, "concept_aliases").select("concept_id", "alias"), "concept_id", "alias")
    return n.select("concept_id", F.size("alias_list").alias("n_aliases"), F.md5(F.array_join("alias_list", "|").cast("binary")).alias("md5"))


def q_chapter_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Order of concepts within a document's mentions as weak labels: 1 / distance in the order."""
    from pyspark.sql import Window

    from gradus.operators import signals
    from gradus.plans import signal_queries as s

    m = signals.mentions(s._names(spark, d), s._docs(spark, d))
    o = m.withColumn("i", F.row_number().over(Window.partitionBy("unit").orderBy("pos", "concept_id")))
    a, b = o.select("unit", F.col("concept_id").alias("src"), F.col("i").alias("ia")), o.select("unit", F.col("concept_id").alias("dst"), F.col("i").alias("ib"))
    return a.join(b, "unit").where("ia < ib").groupBy("src", "dst").agg(r6(F.sum(1 / (F.col("ib") - F.col("ia")))).alias("weight"))


def q_link_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Links between listed concepts as weak labels: no self links, each once, weight 1."""
    p = table(spark, d, "merge_pairs").where("left_id is not null and right_id is not null and left_id <> right_id").select(F.col("left_id").alias("src"), F.col("right_id").alias("dst")).distinct()
    c = table(spark, d, "concepts").select("concept_id").distinct()
    return p.join(c.select(F.col("concept_id").alias("src")), "src", "left_semi").join(c.select(F.col("concept_id").alias("dst")), "dst", "left_semi").withColumn("weight", F.lit(1.0))


def _r(x: str) -> str:
    return f"floor(({x})::DOUBLE * 1e6 + 0.5) / 1e6"


_REV = "rev AS (SELECT user_id, event_type, ts, event_id, (floor(value)::BIGINT % 6)::INT AS q, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)"
_LAST = f"last AS (SELECT user_id, event_type, max(ts) AS last_ts, count(*) * 86400.0::DOUBLE AS s FROM events GROUP BY ALL), ret AS (SELECT user_id, event_type, exp(-greatest(0, epoch(TIMESTAMP '{NOW}') - epoch(last_ts)) / s) AS r FROM last)"
_ROLE = "['A', 'B', 'C'][floor(value)::BIGINT % 3 + 1]"
_NODES = f"""{_LINKS}, n AS (SELECT v.node_id AS node, c.session_id, c.label, coalesce(lower(trim(c.status, ' ')), 'locked') AS status, c.node_type, c.triggering_misconception AS mis, l.parent
  FROM valid v JOIN (SELECT * FROM concept_nodes QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC NULLS LAST) = 1) c USING (node_id) JOIN links l USING (node_id)),
e AS (SELECT parent AS src, node AS dst, 'prerequisite' AS kind, 0.8::DOUBLE AS conf FROM n WHERE parent IS NOT NULL)"""
_LEARNER = """root AS (SELECT domain_id AS session, regexp_replace(regexp_replace(lower(goal_concept), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS node, goal_concept AS label FROM domains),
cl2 AS (SELECT DISTINCT domain_id AS session, cluster_no AS cluster FROM concepts WHERE cluster_no IS NOT NULL),
leaf AS (SELECT domain_id AS session, concept_id::VARCHAR AS node, canonical_name AS label, coalesce(cluster_no, 0) AS cluster, coalesce(depth, 2) AS depth FROM (SELECT DISTINCT domain_id, concept_id, canonical_name, cluster_no, depth FROM concepts)),
firsts AS (SELECT session, node FROM leaf QUALIFY row_number() OVER (PARTITION BY session ORDER BY depth > 1, node) = 1),
nodes AS (SELECT session, node, label, 'in_progress' AS status, 'root' AS node_type, CAST(NULL AS VARCHAR) AS parent, 0 AS depth FROM root
  UNION ALL SELECT c.session, 'cluster_' || cluster, 'Cluster ' || (cluster + 1), 'available', 'branch', r.node, 1 FROM cl2 c JOIN root r USING (session)
  UNION ALL SELECT l.session, l.node, l.label, CASE WHEN f.node IS NULL THEN 'locked' ELSE 'available' END, 'leaf', CASE WHEN c.cluster IS NULL THEN r.node ELSE 'cluster_' || l.cluster END, l.depth FROM leaf l JOIN root r USING (session) LEFT JOIN cl2 c ON c.session = l.session AND c.cluster = l.cluster LEFT JOIN firsts f ON f.session = l.session AND f.node = l.node)"""
_RUNS = "runs AS (SELECT pair_id, annotator, source, lower(trim(split, ' ')) AS purpose, CASE WHEN label = 1 THEN 'final_eval' ELSE 'dev' END AS run_type FROM (SELECT DISTINCT * FROM gold_pairs))"
_BUCKETS = "SELECT grp, id, bucket, n, sqrt(sum(n * n) OVER (PARTITION BY grp, id)::DOUBLE) AS norm FROM (SELECT grp, id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 384)::INT AS bucket, count(*) AS n FROM (SELECT grp, id, unnest(string_split_regex(lower(text), '[ \\t\\r\\n]+')) AS w FROM {}) WHERE w <> '' GROUP BY ALL)"


def _sql() -> dict[str, str]:
    from gradus.plans.signal_queries import _BASE as signals

    return {
        "q_sm2": f"""WITH RECURSIVE {_REV}, f AS (SELECT user_id, event_type, 0::BIGINT AS i, 2.5::DOUBLE AS e, 1.0::DOUBLE AS d, 0 AS r FROM (SELECT DISTINCT user_id, event_type FROM events)
            UNION ALL SELECT f.user_id, f.event_type, v.i, greatest(1.3, f.e + (0.1 - (5.0 - v.q) * (0.08 + (5.0 - v.q) * 0.02)))::DOUBLE, (CASE WHEN v.q < 3 THEN 1.0 WHEN f.r = 0 THEN 1.0 WHEN f.r = 1 THEN 6.0 ELSE f.d * greatest(1.3, f.e + (0.1 - (5.0 - v.q) * (0.08 + (5.0 - v.q) * 0.02))) END)::DOUBLE, CASE WHEN v.q < 3 THEN 0 ELSE f.r + 1 END
            FROM f JOIN rev v ON v.user_id = f.user_id AND v.event_type = f.event_type AND v.i = f.i + 1)
            SELECT f.user_id, f.event_type, f.i AS n_reviews, {_r('e')} AS ease, {_r('d')} AS interval, r AS repetition FROM f JOIN (SELECT DISTINCT user_id, event_type, n FROM rev) k ON k.user_id = f.user_id AND k.event_type = f.event_type AND k.n = f.i""",
        "q_fsrs_fold": f"""WITH RECURSIVE {_REV}, f AS (SELECT user_id, event_type, 0::BIGINT AS i, 172800.0::DOUBLE AS s FROM (SELECT DISTINCT user_id, event_type FROM events)
            UNION ALL SELECT f.user_id, f.event_type, v.i, (CASE WHEN v.q >= 3 THEN f.s * (1.6 + 0.12 * greatest(0, v.q - 3)) ELSE greatest(f.s / 1.8, 60.0) END)::DOUBLE FROM f JOIN rev v ON v.user_id = f.user_id AND v.event_type = f.event_type AND v.i = f.i + 1)
            SELECT f.user_id, f.event_type, f.i AS n_reviews, {_r('ln(s)')} AS log_stability FROM f JOIN (SELECT DISTINCT user_id, event_type, n FROM rev) k ON k.user_id = f.user_id AND k.event_type = f.event_type AND k.n = f.i""",
        "q_retention": f"WITH {_LAST} SELECT user_id, event_type, {_r('r')} AS retention, r < 0.5 AS decayed FROM ret",
        "q_refresh_edges": f"WITH {_LAST}, t AS (SELECT DISTINCT event_type FROM events), c AS (SELECT a.event_type AS source, min(b.event_type) AS target FROM t a JOIN t b ON b.event_type > a.event_type GROUP BY 1) SELECT user_id, source, target FROM ret JOIN c ON c.target = event_type WHERE r < 0.5",
        "q_grade": f"SELECT event_id, role, mis AS misconception, CASE WHEN mis IS NOT NULL THEN 'remediate' WHEN role = 'A' THEN 'complete' ELSE 'review' END AS action, CASE WHEN mis IS NOT NULL THEN NULL WHEN role = 'A' THEN 3 ELSE 1 END AS quality FROM (SELECT event_id, {_ROLE} AS role, CASE WHEN {_ROLE} = 'B' THEN 'M_' || md5(event_type)[:8] END AS mis FROM events)",
        "q_inject": f"WITH RECURSIVE {_NODES}, t AS (SELECT node, 'RM_' || regexp_replace(mis, '^M_', '') || '_' || node AS rm FROM n WHERE mis IS NOT NULL) SELECT src, dst, kind, conf FROM e WHERE dst NOT IN (SELECT node FROM t) UNION ALL SELECT src, rm, kind, conf FROM e JOIN t ON t.node = e.dst UNION ALL SELECT rm, node, 'remediation_link', 1.0 FROM t",
        "q_resolve_roundtrip": f"WITH RECURSIVE {_NODES} SELECT src, dst, kind, conf FROM e",
        "q_unlock_dag": f"WITH RECURSIVE {_NODES} SELECT n.node, CASE WHEN n.status = 'locked' AND p.status = 'completed' THEN 'available' ELSE n.status END AS status FROM n LEFT JOIN n p ON p.node = n.parent",
        "q_cascade": f"""WITH RECURSIVE {_NODES}, up AS (SELECT d.node_id AS leaf, n.node AS node FROM down d JOIN n ON n.node = d.node_id WHERE d.node_id NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL) AND n.status <> 'completed' UNION SELECT u.leaf, l.parent FROM up u JOIN links l ON l.node_id = u.node WHERE l.parent IS NOT NULL),
            cp AS (SELECT parent, node, min(place) AS place FROM (SELECT node_id AS parent, unnest(children_ids) AS node, unnest(range(len(children_ids))) AS place FROM valid) GROUP BY ALL),
            st AS (SELECT n.node, n.parent, n.status, n.status = 'completed' OR (n.node IN (SELECT parent FROM n WHERE parent IS NOT NULL) AND n.node NOT IN (SELECT node FROM up)) AS done, row_number() OVER (PARTITION BY n.parent ORDER BY cp.place NULLS LAST, n.node) AS p FROM n JOIN down d ON d.node_id = n.node LEFT JOIN cp ON cp.parent = n.parent AND cp.node = n.node),
            pl AS (SELECT *, max(CASE WHEN done THEN p END) OVER w AS ld, max(CASE WHEN status = 'locked' THEN p END) OVER w AS ll FROM st WINDOW w AS (PARTITION BY parent ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            op AS (SELECT node FROM pl WHERE parent IS NOT NULL AND NOT done AND status = 'locked' AND ld > coalesce(ll, 0)), ch AS (SELECT node FROM pl WHERE p = 1 AND NOT done AND status = 'locked' AND parent IN (SELECT node FROM op))
            SELECT n.node, CASE WHEN st.done THEN 'completed' WHEN n.node IN (SELECT node FROM op UNION SELECT node FROM ch) THEN 'available' ELSE n.status END AS status FROM n LEFT JOIN st USING (node)""",
        "q_can_start": f"WITH RECURSIVE {_NODES} SELECT n.node, 1::BIGINT AS n_unmet, p.node AS first_unmet FROM n JOIN n p ON p.node = n.parent WHERE n.status = 'locked' AND p.status <> 'completed'",
        "q_progress": f"""WITH RECURSIVE {_NODES}, k AS (SELECT parent, count(*) AS k FROM n WHERE parent IS NOT NULL GROUP BY 1),
            up AS (SELECT d.node_id AS leaf, d.node_id AS node, 1.0::DOUBLE AS w FROM down d WHERE d.node_id NOT IN (SELECT parent FROM k) UNION ALL SELECT u.leaf, l.parent, u.w / k.k FROM up u JOIN links l ON l.node_id = u.node JOIN k ON k.parent = l.parent WHERE l.parent IS NOT NULL)
            SELECT u.node, {_r("sum(CASE WHEN n.status = 'completed' THEN u.w ELSE 0 END)")} AS progress FROM up u JOIN n ON n.node = u.leaf GROUP BY u.node""",
        "q_hidden_nodes": f"WITH RECURSIVE {_NODES}, h AS (SELECT n.node FROM n JOIN down d ON d.node_id = n.node JOIN n p ON p.node = n.parent WHERE p.status = 'completed' UNION SELECT n.node FROM h JOIN n ON n.parent = h.node) SELECT node FROM h",
        "q_next_available": f"WITH RECURSIVE {_NODES} SELECT session_id, node, status FROM n WHERE node_type = 'leaf' AND status IN ('available', 'in_progress') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY node) = 1",
        "q_payload": f"WITH RECURSIVE {_NODES}, v2 AS (SELECT * FROM concept_nodes QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC NULLS LAST) = 1) SELECT n.session_id, n.node, n.label, n.status, n.node_type, n.parent, v2.depth FROM n JOIN v2 ON v2.node_id = n.node",
        "q_payload_edges": f"WITH RECURSIVE {_NODES} SELECT n.session_id, e.src, e.dst, e.kind, e.conf FROM e JOIN n ON n.node = e.dst",
        "q_hierarchy_nodes": f"WITH {_LEARNER} SELECT * FROM nodes",
        "q_hierarchy_edges": f"WITH {gq._EDGES.replace('nodes AS', 'dag_nodes AS')}, {_LEARNER}, own AS (SELECT DISTINCT domain_id AS session, concept_id FROM concepts) SELECT session, parent AS src, node AS dst, 'hierarchy' AS kind, 1.0::DOUBLE AS conf FROM nodes WHERE parent IS NOT NULL UNION ALL SELECT o.session, src::VARCHAR, dst::VARCHAR, 'prerequisite', conf FROM dag JOIN own o ON o.concept_id = src WHERE EXISTS (SELECT 1 FROM nodes x WHERE x.session = o.session AND x.node = src::VARCHAR) AND EXISTS (SELECT 1 FROM nodes x WHERE x.session = o.session AND x.node = dst::VARCHAR)",
        "q_rebuild": "WITH v AS (SELECT * FROM concept_nodes WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC NULLS LAST) = 1) SELECT node_id AS node, label, CASE WHEN node_type = 'leaf' THEN 'locked' ELSE status END AS status, node_type <> 'leaf' AS remediation, epoch_us(updated_at) AS last_review, progress AS stability FROM v WHERE node_type = 'leaf' OR coalesce(is_dynamic_remediation, false)",
        "q_remediation_progress": "SELECT 'RM_' || user_id || '_' || event_type AS rm, count(*) AS n, count(*) >= 2 AS resolved FROM events WHERE floor(value)::BIGINT % 6 >= 3 GROUP BY 1",
        "q_difficulty_prior": f"SELECT event_type, {_r('a')} AS accuracy, {_r('(0.5 + 2.5 * a) * 86400')} AS stability FROM (SELECT event_type, avg((floor(value)::BIGINT % 6 >= 3)::INT) AS a FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1) GROUP BY 1)",
        "q_attribution": f"WITH {gq.sq._BASE} SELECT misconception, role, m AS match, m < 0.1 AS attributed FROM (SELECT DISTINCT concept_id::VARCHAR AS misconception, v FROM vec), (VALUES ('A', 1.0::DOUBLE), ('B', -1.0), ('C', 1.0)) o(role, m)",
        "q_quiz_gen": "SELECT node, unnest([1, 2, 3]) AS question, role, CASE WHEN role = 'B' THEN 'M_' || md5(node::VARCHAR)[:8] END AS misconception FROM (SELECT DISTINCT concept_id AS node FROM concepts), (SELECT unnest(['A', 'B', 'C']) AS role)",
        "q_quiz_validate": f"SELECT user_id AS node, event_type AS question FROM events GROUP BY ALL HAVING count(*) <> 3 OR count(DISTINCT {_ROLE}) <> 3",
        "q_content_items": f"SELECT goal_concept AS topic, kind, rank::INT AS rank, kind || '://' || replace(goal_concept, ' ', '-') || '/' || rank AS url FROM domains, (SELECT unnest([{', '.join(f"'{k}'" for k in content.KINDS)}]) AS kind), range(5) r(rank)",
        "q_content_rank": f"WITH qs AS (SELECT DISTINCT domain_id AS grp, concept_id AS id, canonical_name AS text FROM concepts), its AS (SELECT domain_id AS grp, doc_id AS id, title AS text FROM documents WHERE title IS NOT NULL), q AS ({_BUCKETS.format('qs')}), i AS ({_BUCKETS.format('its')}), s AS (SELECT q.id AS query_id, i.id AS item_id, q.grp, sum(q.n * i.n) / (any_value(q.norm) * any_value(i.norm)) AS sim FROM q JOIN i ON q.grp = i.grp AND q.bucket = i.bucket GROUP BY ALL) SELECT query_id, item_id, {_r('sim')} AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY grp, query_id ORDER BY round(sim, 9) DESC, item_id) AS rank FROM s) WHERE rank <= 5",
        "q_cosine_topk": f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT query_id, id, {_r('sim')} AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM s) WHERE rank <= 10",
        "q_cap_by_relevance": f"WITH {gq.sq._BASE}, g AS (SELECT domain_id, arg_min(v, concept_id) AS g FROM vec GROUP BY 1), s AS (SELECT domain_id, concept_id, {_r('list_dot_product(v, g) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(g, g)))')} AS sim FROM vec JOIN g USING (domain_id)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY sim DESC, concept_id) AS rank FROM s) WHERE rank <= 100",
        "q_knapsack": """WITH i AS (SELECT n_regionkey AS grp, n_nationkey AS id, n_nationkey % 7 + 1 AS value, length(n_name) AS cost, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS b FROM nation),
            m AS (SELECT grp, m, sum(value) AS v, sum(cost) AS c, bool_and(id % 2 = 0 OR b = 0 OR (m >> (b - 1)) & 1 = 1) AS ok FROM i, range(32) r(m) WHERE (m >> b) & 1 = 1 GROUP BY ALL)
            SELECT grp, true AS feasible, max(v)::DOUBLE AS best_value FROM m WHERE c <= 25 AND ok GROUP BY grp""",
        "q_upsert": "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_acctbal FROM supplier",
        "q_purge": "SELECT l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1",
        "q_incremental": "WITH t AS (SELECT DISTINCT title, source_type FROM documents WHERE title IS NOT NULL), n AS (SELECT max(source_type) AS source_type FROM t WHERE source_type <> 'syllabus' AND title NOT IN (SELECT title FROM t WHERE source_type = 'syllabus') GROUP BY title) SELECT source_type, count(*) AS n FROM (SELECT source_type FROM t WHERE source_type = 'syllabus' UNION ALL SELECT source_type FROM n) GROUP BY 1",
        "q_cache_ttl": "SELECT user_id, event_id, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts) <= 86400",
        "q_heldout_violations": f"WITH {_RUNS} SELECT pair_id, purpose, run_type FROM runs WHERE purpose = 'heldout' AND run_type <> 'final_eval'",
        "q_oneshot_violations": f"WITH {_RUNS} SELECT annotator, source, count(*) AS n FROM runs WHERE run_type = 'final_eval' GROUP BY ALL HAVING count(*) > 1",
        "q_schema_checks": " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) FILTER (WHERE NOT coalesce({c}, false)) AS n_bad FROM concept_nodes" for k, c in {"status_known": "lower(status) IN ('completed','in_progress','available','locked')", "type_known": "node_type IN ('root','branch','leaf')", "progress_bounded": "progress BETWEEN 0 AND 1", "has_children_list": "children_ids IS NOT NULL"}.items()),
        "q_nested_aliases": "SELECT concept_id, coalesce(len(l), 0)::INT AS n_aliases, md5(coalesce(array_to_string(l, '|'), '')) AS md5 FROM (SELECT DISTINCT concept_id FROM concepts) LEFT JOIN (SELECT concept_id, list_sort(list(DISTINCT alias)) AS l FROM concept_aliases WHERE alias IS NOT NULL GROUP BY 1) USING (concept_id)",
        "q_chapter_pairs": f"WITH {signals}, o AS (SELECT doc_id, concept_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, concept_id) AS i FROM men) SELECT a.concept_id AS src, b.concept_id AS dst, {_r('sum(1.0::DOUBLE / (b.i - a.i))')} AS weight FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.i < b.i GROUP BY ALL",
        "q_link_pairs": "SELECT DISTINCT left_id AS src, right_id AS dst, 1.0::DOUBLE AS weight FROM merge_pairs WHERE left_id <> right_id AND left_id IN (SELECT concept_id FROM concepts) AND right_id IN (SELECT concept_id FROM concepts)",
    }


QUERIES = {
    f.__name__: f
    for f in (
        q_sm2, q_fsrs_fold, q_retention, q_refresh_edges, q_grade, q_inject, q_resolve_roundtrip, q_unlock_dag, q_cascade, q_can_start, q_progress, q_hidden_nodes, q_next_available, q_payload, q_payload_edges, q_hierarchy_nodes, q_hierarchy_edges, q_rebuild, q_remediation_progress, q_difficulty_prior, q_attribution, q_optimize_path, q_quiz_gen, q_quiz_validate,
        q_content_items, q_content_rank, q_cosine_topk, q_cap_by_relevance, q_knapsack, q_study_path, q_upsert, q_purge, q_incremental, q_cache_ttl, q_heldout_violations, q_oneshot_violations, q_schema_checks,
        q_nested_aliases, q_chapter_pairs, q_link_pairs,
    )
}
SQL = _sql()
