"""Operators on small cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from gradus.functions import columns as cx
from gradus.functions import text as tx
from gradus.operators import content, corpus, graph, learning, planning, relational, scoring, signals
from gradus.sources import files
from gradus.streaming import reviews

DIAMOND = [("A", "B", 0.8), ("A", "C", 0.8), ("B", "D", 0.8), ("C", "D", 0.8)]


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, conf double")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("raw, kept", [("Body.\n== References ==\nx", "Body."), ("Body.\n=== See also ===\ny\nz", "Body."), ("Clean text.", "Clean text."), ("", ""), (None, None)])
def test_strip_references(spark, raw, kept):
    assert one(spark, tx.strip_references(F.lit(raw).cast("string"))) == kept


def test_html_to_text(spark):
    html = "<nav>menu</nav><style>p{}</style><p>Fish &amp; chips</p><script>x()</script><div>two <b>words</b></div><footer>f</footer>"
    assert one(spark, tx.html_to_text(F.lit(html))) == "Fish & chips\ntwo words"


@pytest.mark.parametrize("p, amount", [("0.1% to 8%", True), ("3–6%", True), ("10-20%", True), ("50%", True), ("1.5 to 3.0", True), ("12345", True), ("C4 photosynthesis", False), ("F1 score", False), ("k-nearest neighbors", False)])
def test_amounts(spark, p, amount):
    assert one(spark, tx.is_amount(F.lit(p))) is amount


@pytest.mark.parametrize("p, page", [("QUESTIONS", True), ("Introduction", True), ("Chapter 1", True), ("Module 3", True), ("Grading", True), ("machine learning", False), ("Statistical Learning Theory", False)])
def test_page_words(spark, p, page):
    assert one(spark, tx.is_page_word(F.lit(p))) is page


@pytest.mark.parametrize("name, norm", [("A Neural Network", "neural network"), ("Bayes' theorem", "bayes theorem"), ("Student's t-distribution", "student t-distribution"), ("Decision trees", "decision tree"), ("boundaries", "boundary"), ("classes", "class"), ("analysis", "analysis"), ("", "")])
def test_normalize(spark, name, norm):
    assert one(spark, tx.normalize_name(F.lit(name))) == norm


def test_canonical_groups(spark):
    rows = [(1, "Decision trees", None, None, 1), (2, "decision tree", "A tree of choices.", 9, 2), (3, "Kernel", None, None, 3), (4, "the kernel", "k", None, 4)]
    got = corpus.canonical_groups(spark.createDataFrame(rows, "id bigint, name string, definition string, source_doc_id bigint, ord bigint"))
    assert pairs(got, "norm", "canonical_id", "definition") == [("decision tree", 2, "A tree of choices."), ("kernel", 4, "k")]


def test_order_signal(spark):
    m = spark.createDataFrame([(1, 1, 0), (1, 2, 5), (2, 1, 0), (2, 2, 9), (3, 2, 0), (3, 1, 4)], "unit bigint, concept_id bigint, pos int")
    even = signals.order_signal(m, spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "unit bigint, w int"))
    assert {(r.src, r.dst): round(r.s_order, 4) for r in even.collect()} == {(1, 2): 0.6667, (2, 1): 0.3333}
    weighted = signals.order_signal(m, spark.createDataFrame([(1, 3), (2, 1), (3, 1)], "unit bigint, w int"))
    assert {(r.src, r.dst): round(r.s_order, 4) for r in weighted.collect()} == {(1, 2): 0.8, (2, 1): 0.2}


def test_cooccurrence_of_always_together(spark):
    m = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 1, 0), (2, 2, 0)], "unit bigint, concept_id bigint, pos int")
    assert signals.cooccurrence_signal(m, spark.createDataFrame([(2,)], "n bigint")).collect()[0]["s_cooc"] == 1.0


def test_youden_auc_and_quality(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "y int, s double")
    best = scoring.best_threshold(rows).collect()[0]
    assert (best["threshold"], best["j"]) == (0.5, 1.0)
    assert scoring.roc_auc(rows).collect()[0]["auc"] == 1.0
    q = scoring.quality(scoring.confusion(spark.createDataFrame([(1, 1.0), (0, 1.0), (1, 0.0)], "y int, s double"), F.lit(0.5))).collect()[0]
    assert (q["precision"], q["recall"], q["f1"]) == (0.5, 0.5, 0.5)
    assert scoring.best_threshold(rows.limit(0)).count() == 0


def test_negatives_avoid_positives(spark):
    pos = spark.createDataFrame([(i, i + 1) for i in range(20)], "src bigint, dst bigint")
    got = scoring.negatives(pos, spark.range(30).select(F.col("id").alias("node"))).collect()
    assert got and not {(r.src, r.dst) for r in got} & {(i, i + 1) for i in range(20)} and all(r.src != r.dst for r in got)


def test_cycles_are_pruned(spark):
    e = edges(spark, [("A", "B", 0.9), ("B", "C", 0.8), ("C", "A", 0.2), ("D", "D", 0.5), ("D", "A", 0.9)])
    rest, cut = graph.prune_cycles(e)
    assert pairs(cut, "src", "dst") == [("C", "A"), ("D", "D")]
    assert pairs(rest, "src", "dst") == [("A", "B"), ("B", "C"), ("D", "A")]


def test_pruning_equals_one_by_one(spark):
    import random

    rng = random.Random(4)
    rows = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(24)})
    rows = [(a, b, round(rng.random(), 3)) for a, b in rows]
    left, cut = list(rows), set()

    def reach(es):
        r = {(a, b) for a, b, _ in es}
        while True:
            new = r | {(a, d) for a, b in r for c, d in r if b == c}
            if new == r:
                return r
            r = new

    while True:
        r = reach(left)
        ring = [x for x in left if x[0] == x[1]] or [x for x in left if (x[1], x[0]) in r]
        if not ring:
            break
        comp = {y for x in ring for y in x[:2] if (y, ring[0][0]) in r and (ring[0][0], y) in r or y == ring[0][0]}
        worst = min((x for x in ring if x[0] in comp and x[1] in comp), key=lambda x: (x[2], x[0], x[1]))
        left.remove(worst)
        cut.add(worst[:2])
    assert set(pairs(graph.prune_cycles(edges(spark, rows))[1], "src", "dst")) == cut


def test_reduction_closure_depth_and_build(spark):
    e = edges(spark, [("A", "B", 0.9), ("B", "C", 0.9), ("A", "C", 0.9), ("C", "D", 0.4)])
    built = graph.build_dag(e, 0.65)
    assert pairs(built, "src", "dst", "dropped_reason") == [("A", "B", None), ("A", "C", "transitive"), ("B", "C", None), ("C", "D", "threshold")]
    assert pairs(graph.closure(e), "src", "dst", "hops") == [("A", "B", 1), ("A", "C", 1), ("A", "D", 2), ("B", "C", 1), ("B", "D", 2), ("C", "D", 1)]
    assert pairs(graph.depths(e), "node", "depth") == [("A", 0), ("B", 1), ("C", 2), ("D", 3)]
    assert graph.closure(e.limit(0)).count() == 0


def test_audit(spark):
    e = edges(spark, [("A", "B", 0.9), ("B", "C", 0.9), ("A", "C", 0.9), ("D", "E", 0.3)])
    built = graph.build_dag(e, 0.65)
    kept = built.where("dropped_reason is null or dropped_reason = 'transitive'").select("src", "dst", "conf")
    gold = edges(spark, [("A", "B", 1.0), ("A", "C", 1.0), ("C", "B", 1.0), ("D", "E", 1.0)])
    got = dict(((a, b), s) for a, b, s in pairs(graph.audit(gold, built, graph.closure(kept)), "src", "dst", "status"))
    assert got == {("A", "B"): "survived", ("A", "C"): "subsumed_by_transitive_path", ("C", "B"): "lost_to_threshold", ("D", "E"): "lost_to_threshold"}


def test_unlock_values(spark):
    e = edges(spark, DIAMOND)
    nodes = spark.createDataFrame([(x, None) for x in "ABCD"], "node string, cluster int")
    assert pairs(graph.unlock_values(nodes, graph.closure(e)), "node", "value") == [("A", 3.0), ("B", 1.0), ("C", 1.0), ("D", 0.0)]
    clusters = spark.createDataFrame([("A", 1), ("B", 1), ("C", 2)], "node string, cluster int")
    assert pairs(graph.unlock_values(clusters, graph.closure(edges(spark, DIAMOND[:2]))), "node", "value")[0] == ("A", 1.3)


def test_communities_beat_singletons(spark):
    e = edges(spark, [(f"a{i}", f"a{j}", 1.0) for i in range(4) for j in range(i)] + [(f"b{i}", f"b{j}", 1.0) for i in range(4) for j in range(i)] + [("a0", "b0", 0.1)])
    c = graph.communities(e, spark.createDataFrame([(f"{x}{i}",) for x in "ab" for i in range(4)] + [("lone",)], "node string"))
    by = dict(pairs(c, "node", "cluster"))
    assert by["lone"] is None and len({by[f"a{i}"] for i in range(4)}) == 1 and by["a1"] != by["b1"]
    alone = c.where("cluster is not null").select("node", F.col("node").alias("cluster"))
    assert graph.modularity(e, c.where("cluster is not null")).collect()[0][0] > graph.modularity(e, alone).collect()[0][0]


def test_knapsack():
    need = {("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")}
    ids, v = list("ABCD"), [1.0, 2.0, 3.0, 4.0]
    assert planning.solve(ids, v, v, need, 6) == (True, True, 6.0, ["A", "B", "C"])
    assert planning.solve(ids, v, v, need, 6, "D")[0] is False
    assert planning.solve(ids, v, v, need, 10, "D")[2] == 10.0
    assert planning.solve(ids, v, v, need, 0)[0] is False


def test_knapsack_equals_enumeration():
    import random

    rng = random.Random(1)
    for _ in range(40):
        n = rng.randrange(1, 9)
        values, costs = [float(rng.randrange(1, 9)) for _ in range(n)], [float(rng.randrange(1, 9)) for _ in range(n)]
        need = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.2}
        budget = rng.randrange(1, 25)
        best = max(sum(values[i] for i in range(n) if m >> i & 1) for m in range(1 << n) if sum(costs[i] for i in range(n) if m >> i & 1) <= budget and all(m >> i & 1 or not m >> j & 1 for i, j in need))
        assert planning.solve(list(range(n)), values, costs, need, budget)[2] == best


def test_knapsack_of_some_hundred_items():
    """Pairs of items, the second needing the first, against a table over the budget; within the default steps."""
    import random

    for seed in range(5):
        rng = random.Random(seed)
        n, budget = 400, 120
        values, costs = [round(rng.randrange(10, 80) / 10, 1) for _ in range(n)], [float(rng.choice((10, 15, 20, 25, 30, 45))) for _ in range(n)]
        best = [0.0] * (budget + 1)
        for i in range(0, n, 2):
            c1, c2 = int(costs[i]), int(costs[i] + costs[i + 1])
            best = [max(best[b], best[b - c1] + values[i] if b >= c1 else 0, best[b - c2] + values[i] + values[i + 1] if b >= c2 else 0) for b in range(budget + 1)]
        got = planning.solve(list(range(n)), values, costs, {(i, i + 1) for i in range(0, n, 2)}, budget)
        assert got[:2] == (True, True) and got[2] == pytest.approx(best[budget])


def test_memory_formulas(spark):
    assert one(spark, cx.retention(F.lit(0), F.lit(10))) == 1.0
    assert one(spark, cx.retention(F.lit(10), F.lit(10))) == pytest.approx(math.exp(-1))
    assert one(spark, cx.retention(F.lit(10) * math.log(2), F.lit(10))) == pytest.approx(0.5)
    r = spark.createDataFrame([(1, "2024-01-01", 1, 5), (1, "2024-01-02", 2, 5), (1, "2024-01-03", 3, 2)], "k int, ts string, event_id bigint, quality int")
    sm2 = learning.fold_sm2(r, "k").collect()[0]
    assert (sm2["repetition"], sm2["interval"]) == (0, 1.0) and sm2["ease"] == pytest.approx(2.5 + 0.1 + 0.1 - 0.32)
    assert learning.fold_fsrs(r, "k").collect()[0]["stability"] == pytest.approx(2 * 86400 * 1.84**2 / 1.8)


def test_remediation_round_trip(spark):
    e = spark.createDataFrame([("A", "B", "prerequisite", 0.8), ("B", "C", "prerequisite", 0.8)], "src string, dst string, kind string, conf double")
    new, stash, lock = learning.inject_remediation(e, spark.createDataFrame([("C", "M_7")], "node string, misconception string"))
    assert pairs(new, "src", "dst", "kind") == [("A", "B", "prerequisite"), ("B", "RM_7_C", "prerequisite"), ("RM_7_C", "C", "remediation_link")]
    assert pairs(lock, "node") == [("C",)]
    again = learning.inject_remediation(new, spark.createDataFrame([("C", "M_7")], "node string, misconception string"))[0]
    assert pairs(again, "src", "dst") == pairs(new, "src", "dst")
    back = learning.resolve_remediation(new, stash, spark.createDataFrame([("RM_7_C",)], "rm string"))
    assert pairs(back, "src", "dst") == [("A", "B"), ("B", "C")]


def test_unlocking(spark):
    s = spark.createDataFrame([("A", "completed"), ("B", "locked"), ("C", "locked"), ("D", "locked")], "node string, status string")
    assert pairs(learning.unlocked(s, edges(spark, DIAMOND)), "node", "status") == [("A", "completed"), ("B", "available"), ("C", "available"), ("D", "locked")]
    assert pairs(learning.unmet(s, edges(spark, DIAMOND)), "node", "n_unmet", "first_unmet") == [("D", 2, "B")]


def test_table_operators(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert pairs(relational.upsert(old, new, "k"), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert pairs(relational.append_new(old, new, "k"), "k", "v") == [(1, "a"), (2, "b"), (3, "d")]
    assert pairs(relational.purge(old, new, "k"), "k") == [(1,)]


def test_vector_top_is_exact(spark):
    import random

    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    got = content.vector_top(df.where("id < 5"), df, k=3, block=9)

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    for q in range(5):
        want = sorted((i for i, _ in rows if i != q), key=lambda i: (-round(cos(rows[q][1], rows[i][1]), 9), i))[:3]
        assert [r.id for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == want


def test_files(spark, tmp_path):
    (tmp_path / "calc_train_split_1.csv").write_text("Prerequisite,Concept,label_prereq\nfunction,limit,1\n")
    (tmp_path / "calc_test_split_1.csv").write_text("Prerequisite,Concept,label_prereq\nlimit,series,0\n")
    assert pairs(files.read_folds(spark, str(tmp_path)), "domain", "part", "fold", "concept", "prerequisite", "label") == [("calc", "test", 1, "series", "limit", 0), ("calc", "train", 1, "limit", "function", 1)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "mining.txt").write_text("long enough text " * 5)
    (tmp_path / "short.txt").write_text("no")
    assert [r.domain for r in files.read_texts(spark, str(tmp_path), domains={"mining": "data mining"}).collect()] == ["data mining"]
    v = spark.createDataFrame([("a", [1.0, 2.0])], "name string, vec array<double>")
    files.write_vectors(v, str(tmp_path / "v"))
    assert files.read_vectors(spark, str(tmp_path / "v")).collect()[0]["vec"] == [1.0, 2.0]


def test_parse_concepts(spark):
    raw = [(1, '```json\n[{"name": "a", "definition": "x"}]\n```'), (2, '[{"name": "b", "definition": "y"}, {"definition": "z", "name": "c"}, {"name": "cut'), (3, "nothing"), (4, None)]
    got = files.parse_concepts(spark.createDataFrame(raw, "k int, t string"), "k", "t")
    assert pairs(got, "k", "name", "definition") == [(1, "a", "x"), (2, "b", "y"), (2, "c", "z")]


def test_search_urls(spark):
    html = '<a href="//r?uddg=https%3A%2F%2Fx.example%2Fa&x=1">a</a><a href="https://y.example/b.pdf">b</a><a href="/local">c</a>'
    assert pairs(files.search_result_urls(spark.createDataFrame([(1, html)], "k int, h string"), "k", "h"), "url") == [("https://x.example/a",)]


def _event_files(spark, folder, rows, order):
    """Each row in a file of its own, with the times of the files in the given order."""
    import os
    from glob import glob

    for i in order:
        df = spark.createDataFrame([rows[i]], "event_id bigint, ts string, user_id bigint, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "'view' event_type", "value", "'' props")
        df.coalesce(1).write.mode("append").parquet(str(folder))
    for k, i in enumerate(order):
        for f in glob(f"{folder}/*.parquet"):
            if spark.read.parquet(f).head()["event_id"] == rows[i][0]:
                os.utime(f, (1_700_000_000 + 100 * k,) * 2)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (2, 1, 0)])
def test_streams_do_not_depend_on_file_order(spark, tmp_path, order):
    rows = [(1, "2024-01-01 00:00:00", 7, 5.0), (2, "2024-01-01 00:10:00", 7, 1.0), (3, "2024-01-01 02:00:00", 7, 4.0)]
    _event_files(spark, tmp_path / "e", rows, order)
    got = reviews.run_to_end(reviews.sessions(reviews.event_stream(spark, str(tmp_path / "e"), "*.parquet")), "complete", str(tmp_path / "s"))
    assert sorted(r.n for r in got.collect()) == [1, 2]
    w = reviews.run_to_end(reviews.windowed_counts(reviews.event_stream(spark, str(tmp_path / "e"), "*.parquet")), "complete", str(tmp_path / "w"))
    assert sorted(r.n for r in w.collect()) == [1, 2]
    # The state is the same although each file is a batch.
    m = reviews.run_to_end(reviews.memory_state(reviews.event_stream(spark, str(tmp_path / "e"), "*.parquet", 1)), "update", str(tmp_path / "m")).collect()
    assert [r.n_reviews for r in sorted(m, key=lambda r: r.n_reviews)] == [1, 2, 3]
    assert max(m, key=lambda r: r.n_reviews).stability == pytest.approx(2 * 86400 * 1.84 / 1.8 * 1.72)


def test_a_component_with_many_surplus_edges(spark):
    """The complete directed graph of 34 nodes needs more than a thousand cuts of one edge; what is left has no cycle."""
    import random

    rng = random.Random(3)
    rows = [(f"n{i:02d}", f"n{j:02d}", rng.random()) for i in range(34) for j in range(34) if i != j]
    rest, cut = graph.prune_cycles(edges(spark, rows))
    left = {(r.src, r.dst) for r in rest.collect()}
    assert len(left) + cut.count() == len(rows)
    while True:  # sources are taken away until nothing is left
        free = {a for a, _ in left} - {b for _, b in left}
        if not free:
            break
        left = {(a, b) for a, b in left if a not in free}
    assert not left


def test_components_equal_union_find(spark):
    import random

    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for p in links for x in p}
    for _ in range(60):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "src bigint, dst bigint")).collect()}
    assert got == root


def test_attention_weights(spark):
    f = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "node int, x array<double>")
    h = {r.node: r.h for r in graph.attention_layer(f, spark.createDataFrame([(1, 2)], "src int, dst int"), [[1.0, 0.0], [0.0, 1.0]], [1.0, 0.0], [0.0, 1.0]).collect()}
    a, b = math.exp(3.0), math.exp(2.0)  # into 2: from 1 with 1 + 2, from itself with 0 + 2
    assert h[1] == pytest.approx([1.0, 0.0]) and h[2] == pytest.approx([a / (a + b), 2 * b / (a + b)])


def test_canonical_order_is_by_one_column_after_the_other(spark):
    rows = [(1, "the classes", None, None, 1), (2, "the classes", None, None, 2), (3, "class", None, None, 3), (4, "Class", None, 9, 4)]
    rows += [(i, "graphs", None, None, i) for i in range(10, 900)] + [(900, "graph", "text", None, 900)]
    g = {r.norm: r.canonical_name for r in corpus.canonical_groups(spark.createDataFrame(rows, "id int, name string, definition string, source_doc_id int, ord int")).collect()}
    assert g["class"] == "Class" and g["graph"] == "graph"
    two = spark.createDataFrame([r for r in rows[:3]], "id int, name string, definition string, source_doc_id int, ord int")
    assert corpus.canonical_groups(two).head()["canonical_name"] == "the classes"
    why = {(r.id, r.reason) for r in corpus.rejected(two).collect()}
    assert why == {(2, "same_form"), (3, "less_frequent")}


def test_phrases_keep_whole_words(spark):
    d = spark.createDataFrame([(1, "McDonald farm house. Naïve bayes rule of the Random Forest Model; chapter one"), (2, None), (3, "")], "k int, t string")
    got = {r.phrase for r in corpus.phrases(d, "k", "t").collect()}
    assert "farm house" in got and "Random Forest Model" in got and not any("onald" in p or p.startswith("ve ") for p in got)


def test_pairs_below_the_floor_are_dropped(spark):
    m = spark.createDataFrame([(1, 2, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1, 3, 0.0, 0.0, 0.5, 0.0, 0.2, 0.15)], "src int, dst int, order_fwd double, order_rev double, def_fwd double, def_rev double, cooc double, sim double")
    assert pairs(signals.prune(m), "src", "dst") == [(1, 3)]
    p = signals.plausible(signals.prune(m), spark.createDataFrame([(3, 1, 0.9), (1, 2, 0.9)], "src int, dst int, s double"))
    assert pairs(p, "src", "dst", "s_plaus") == [(1, 3, 0.9)]
    assert pairs(signals.plausible(m, spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.1)], "src int, dst int, s double"), most=1), "dst", "s_plaus") == [(2, 0.9), (3, 0.5)]


def test_short_names_and_inner_places(spark):
    names = spark.createDataFrame([(1, 1, "ai"), (1, 2, "c"), (1, 3, "ai lab"), (2, 4, "ai")], "domain_id int, concept_id int, name string")
    texts = spark.createDataFrame([(1, 10, "Said: AI lab, c"), (1, 11, "nothing"), (None, 12, "ai"), (1, 13, None)], "domain_id int, unit int, text string")
    assert pairs(signals.mentions(names, texts), "unit", "concept_id", "pos") == [(10, 1, 1), (10, 2, 14), (10, 3, 6)]


def test_as_many_negatives_as_positives(spark):
    pos = spark.createDataFrame([(i, i + 1) for i in range(200)], "src bigint, dst bigint")
    got = scoring.negatives(pos, spark.range(201).select(F.col("id").alias("node"))).collect()
    assert len(got) == 200 == len({(r.src, r.dst) for r in got}) and not {(r.src, r.dst) for r in got} & {(i, i + 1) for i in range(200)}


def test_scratch_tables_can_be_dropped(spark):
    import os

    from gradus.session import Scratch, drop_scratch

    t = Scratch(spark, "dropped").keep(spark.range(3))
    path = t._gradus_scratch.removeprefix("file:").replace("//", "/")
    assert t.count() == 3 and os.path.isdir(path)
    assert drop_scratch(spark) >= 1 and not os.path.isdir(path)


def test_ranks_over_partitions(spark):
    from gradus.session import Scratch

    df = spark.range(500).selectExpr("(id * 7919) % 503 v", "id")
    assert [r["rank"] for r in scoring.ranked(Scratch(spark, "t"), df, "v", "id").orderBy("v", "id").collect()] == list(range(1, 501))


def test_probe_asks_with_and_without(spark):
    p = spark.createDataFrame([("u x", "v")], "src string, dst string")
    std, wo = [5, 5, 5, 5], [6, 8, 8, 10]  # words of each prompt
    std = [len(t.format(v="v").split()) for t in scoring.STANDARD]
    wo = [len(t.format(v="v", u="u x").replace(",", " ").split()) for t in scoring.WITHOUT]
    a, b = (sum(10 * (1 + 0.01 * n) for n in ns) / 4 for ns in (std, wo))
    assert scoring.dependency_probe(p).head()["d"] == pytest.approx((b - a) / a) and b > a
    t = spark.createDataFrame([(1, -1.0), (1, -3.0)], "k int, logprob double")
    assert scoring.perplexity(t, "k").head()["ppl"] == pytest.approx(math.exp(2))


def test_repeated_new_keys(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "c"), (2, "d"), (1, "x"), (1, "y")], "k int, v string")
    assert pairs(relational.upsert(old, new, "k"), "k", "v") == [(1, "y"), (2, "d")]
    assert pairs(relational.append_new(old, new, "k"), "k", "v") == [(1, "a"), (2, "d")]


def test_cascade_follows_the_order_of_children(spark):
    from gradus.operators import hierarchy

    rows = spark.createDataFrame([("r", None, ["z", "a", "m"]), ("z", "r", None), ("a", "r", None), ("m", "r", None)], "node string, parent string, children array<string>")
    s = spark.createDataFrame([("r", "in_progress"), ("z", "completed"), ("a", "locked"), ("m", "locked")], "node string, status string")
    got = dict(pairs(learning.cascade(hierarchy.Forest(rows.select("node", "parent")), s, hierarchy.child_places(rows)), "node", "status"))
    assert got == {"r": "in_progress", "z": "completed", "a": "available", "m": "locked"}


def test_learner_graph_round_trip_and_rebuild(spark):
    from gradus.operators import session_graph as sg

    goals = spark.createDataFrame([(1, "Big Goal")], "session int, goal string")
    clusters = spark.createDataFrame([(1, 0, "first")], "session int, cluster int, name string")
    c = spark.createDataFrame([(1, "b", "B", 0, 1), (1, "a", "A", None, 3), (1, "c", "C", 5, None)], "session int, node string, label string, cluster int, depth int")
    n = sg.hierarchy_nodes(goals, clusters, c)
    assert pairs(n, "node", "status", "parent", "depth") == sorted([("a", "locked", "cluster_0", 3), ("b", "available", "cluster_0", 1), ("big_goal", "in_progress", None, 0), ("c", "locked", "big_goal", 2), ("cluster_0", "available", "big_goal", 1)])
    e = sg.hierarchy_edges(n, spark.createDataFrame([(1, "b", "a", 0.7), (1, "b", "gone", 0.7)], "session int, src string, dst string, conf double"))
    assert e.where("kind = 'prerequisite'").count() == 1 and e.count() == 5
    back = sg.from_payload(sg.to_payload(n, e))
    assert sorted(map(tuple, back[0].collect()), key=str) == sorted(map(tuple, n.select(back[0].columns).collect()), key=str)
    assert sorted(map(tuple, back[1].collect())) == sorted(map(tuple, e.select(back[1].columns).collect()))
    old = spark.createDataFrame([("b", "B", "completed", False, 5, 2.0), ("RM_1_b", "r", "available", True, None, None), ("x", "X", "locked", False, 1, 1.0)], "node string, label string, status string, remediation boolean, last_review int, stability double")
    assert pairs(sg.rebuilt(old, n.where("node_type = 'leaf'").select("node", "label", "status")), "node", "last_review", "stability") == [("RM_1_b", None, None), ("a", None, None), ("b", 5, 2.0), ("c", None, None)]


def test_paths_to_goals(spark):
    e = edges(spark, [("A", "B", 1.0), ("B", "C", 1.0), ("A", "D", 1.0), ("X", "Y", 1.0)])
    nodes = spark.createDataFrame([(x, 1, 10.0) for x in "ABCDXY"], "node string, cluster int, cost double")
    goals = spark.createDataFrame([("g1", "C", 100.0), ("g2", "C", 10.0), ("g3", "A", 100.0), ("g4", "X", 20.0)], "grp string, goal string, budget double")
    from gradus.operators import planning as pl

    got = {}
    for r in pl.optimize_paths(e, nodes, goals).orderBy("grp", "place").collect():
        got.setdefault(r.grp, []).append(r.id)
    assert got["g1"] == ["A", "B", "C"] and got["g2"] == ["A"]  # too dear: the first of the scope
    assert set(got["g3"]) == {"A", "B", "C", "D"} and "X" in got["g4"] and len(got["g4"]) == 2
    known = spark.createDataFrame([("g1", "A", 0.8), ("g1", "B", 0.7)], "grp string, id string, level double")
    assert [r.id for r in pl.optimize_paths(e, nodes, goals.where("grp = 'g1'"), known).orderBy("place").collect()] == ["B", "C"]


def test_folds_and_variants(spark):
    rows = [("a", k, part, y, s) for k in (0, 1) for part, y, s in (("train", 1, 0.8), ("train", 0, 0.2), ("test", 1, 0.9), ("test", 0, 0.6 - 0.2 * k))]
    r = scoring.cross_validated(spark.createDataFrame(rows, "source string, fold int, part string, y int, s double"), "source").head()
    assert r["n_folds"] == 2 and r["mean_threshold"] == pytest.approx(0.5) and r["std_threshold"] == 0 and r["mean_f1"] == pytest.approx((2 / 3 + 1) / 2)


def test_attribution(spark):
    bank = spark.createDataFrame([("m", [1.0, 0.0])], "misconception string, vec array<double>")
    a = spark.createDataFrame([(1, "m", [-0.8, 0.0]), (2, "m", [0.05, 0.0]), (3, "n", [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, "m", None)], "k int, misconception string, vec array<double>")
    assert pairs(learning.attributed(a, bank), "k", "attributed") == [(1, True), (2, False), (3, True), (4, False), (5, False)]


def test_whole_vectors_go_through_the_layer(spark):
    import numpy as np
    from gradus.plans import graph_queries as gq

    d = "/root/testdata/sf0.001"
    got = {r.node: np.array(r.h) for r in gq.q_dirgcn_full(spark, d).collect()}
    e = [(r.src, r.dst) for r in gq._acyclic(spark, d).collect()]
    x = {r.concept_id: np.array(r.embedding, dtype=float) for r in gq.sq._vectors(spark, d).collect()}
    w_in, w_out, w_self = (np.array(m) for m in gq.FULL_MATRICES)
    assert w_in.shape == (64, 64) and set(got) == {n for p in e for n in p}
    for n, h in got.items():
        before, after = [x[u] for u, v in e if v == n], [x[v] for u, v in e if u == n]
        want = w_self @ x[n] + gq.FULL_BIAS + (w_in @ np.mean(before, axis=0) if before else 0) + (w_out @ np.mean(after, axis=0) if after else 0)
        assert np.abs(h - np.maximum(want, 0)).max() < 2e-6


def test_threshold_curve_takes_a_step_a_row(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.9), ("a", 0, 0.5), ("a", 1, 0.2), ("b", 1, 0.3)], "g string, y int, s double")
    curve = scoring.threshold_curve(rows, "g")
    assert pairs(curve, "g", "tp", "fp", "p", "n") == [("a", 1, 1, 2, 2), ("a", 1, 2, 2, 2), ("b", 1, 0, 1, 0)]
    assert "RowFrame, 1, unboundedfollowing" not in curve._jdf.queryExecution().analyzed().toString()


def _strip_case(spark, repeated):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(1 + i % 2, i, (rng.normal(size=4) + 0.4).tolist()) for i in range(60)]
    if repeated:  # a concept with two vectors, and two that meet in two domains
        rows += [(1, 0, [1.0, 0.5, 0.0, 0.2]), (2, 2, rows[1][2]), (2, 4, rows[3][2])]
    ends = [(int(a), int(b)) for a, b in rng.integers(0, 60, (300, 2)) if a != b]
    order = spark.createDataFrame([(a, b, float(a % 7) / 7) for a, b in set(ends[:120])], "src bigint, dst bigint, s_order double")
    definition = spark.createDataFrame([(a, b, 0.5 + float(b % 3) / 7) for a, b in set(ends[100:200])], "src bigint, dst bigint, s_def double")
    cooc = spark.createDataFrame([(a, b, float(b % 5) / 5) for a, b in {(min(e), max(e)) for e in ends[150:]}], "src bigint, dst bigint, s_cooc double")
    vectors = spark.createDataFrame(rows, "domain_id bigint, concept_id bigint, embedding array<double>")
    from itertools import product

    want = {}
    for (g, a, x), (h, b, y) in product(rows, rows):
        c = float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
        if g == h and a < b and c >= 0.15:
            want[a, b] = max(c, want.get((a, b), -1.0))
    sim = spark.createDataFrame([(a, b, c) for (a, b), c in want.items()], "src bigint, dst bigint, s_sim double")
    return vectors, signals.sparse_signals(order, cooc, definition), signals.prune(signals.merge_signals(order, cooc, definition, sim)), want


def _rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("repeated", [False, True])
def test_similar_pairs_are_not_replicated_by_blocks(spark, repeated, monkeypatch):
    from gradus.operators import blocks

    monkeypatch.setattr(blocks, "CELLS", 200)
    vectors, _, _, want = _strip_case(spark, repeated)
    got = signals.similarity_signal(vectors)
    assert {(r.src, r.dst): round(r.s_sim, 9) for r in got.groupBy("src", "dst").agg(F.max("s_sim").alias("s_sim")).collect()} == {k: round(v, 9) for k, v in want.items()}
    rows = vectors.select(F.col("domain_id").alias("grp"), F.col("concept_id").alias("id"), F.col("embedding").alias("vec")).where("id >= 5")
    strips = blocks.cosine_strips(rows, 0.15, lambda src, dst, s, row, n: [src, dst, s], blocks.PAIRS, strip=7)
    assert {(r.src, r.dst) for r in strips.collect()} == {k for k in want if min(k) >= 5}


@pytest.mark.parametrize("repeated", [False, True])
def test_merged_pairs_are_made_where_they_are_compared(spark, repeated):
    vectors, about, merged, _ = _strip_case(spark, repeated)
    got = signals.pruned(vectors, about)
    assert _rounded(got) == _rounded(merged)
    if not repeated:
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]


@pytest.mark.parametrize("repeated", [False, True])
def test_ranks_within_strips(spark, repeated):
    vectors, about, merged, _ = _strip_case(spark, repeated)
    assert _rounded(signals.pruned_order(vectors, about)) == _rounded(signals.heuristic_order(merged))


@pytest.mark.parametrize("repeated", [False, True])
def test_verdicts_within_strips(spark, repeated):
    vectors, about, merged, want = _strip_case(spark, repeated)
    v = spark.createDataFrame([(b, a, a / 60) for a, b in want] + [(a, b, None) for a, b in want], "src bigint, dst bigint, s double")
    assert _rounded(signals.pruned_plausible(vectors, about, v, most=4)) == _rounded(signals.plausible(merged, v, most=4).select(*merged.columns, "s_plaus"))


@pytest.mark.parametrize("repeated", [False, True])
def test_exact_medians_without_the_pairs(spark, repeated):
    import statistics

    vectors, about, merged, _ = _strip_case(spark, repeated)
    rows = merged.collect()
    want = sorted((c, *(round(f(r[c] for r in rows), 9) for f in (min, statistics.median, max)), len(rows)) for c in signals.MERGED)
    assert _rounded(signals.signal_profile(vectors, about)) == want
    assert _rounded(signals.signal_profile(vectors, about, buckets=1)) == want


def test_knapsacks_hold_one_group_as_objects(spark):
    items = spark.createDataFrame([(1, "a", 2.0, 1.0), (1, "b", 3.0, 1.0), (2, "c", 1.0, 9.0)], "grp int, id string, value double, cost double")
    needs = spark.createDataFrame([(1, "a", "b")], "grp int, src string, dst string")
    budgets = spark.createDataFrame([(1, 2.0, "b"), (2, 2.0, None), (3, 2.0, None)], "grp int, budget double, goal string")
    got = planning.knapsacks(items, needs, budgets)
    assert sorted((r.grp, r.feasible, r.best_value, tuple(r.chosen)) for r in got.collect()) == [("1", True, 5.0, ("a", "b")), ("2", True, 0.0, ()), ("3", False, 0.0, ())]
    assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()
