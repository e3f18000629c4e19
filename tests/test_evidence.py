"""Signals that are counted where pairs are compared, from mentions and files of a domain."""

import numpy as np
import pytest
from gradus.operators import blocks, signals
from gradus.plans import signal_queries
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_vector_is_shuffled_for_a_strip(spark):
    rows = spark.createDataFrame([(g, 10 * g + i, [float(i), 1.0]) for g in (1, 2) for i in range(9)], "grp int, id bigint, vec array<double>")
    got = blocks.cosine_strips(rows, 0.5, lambda src, dst, s, row, n: [src, dst, s], blocks.PAIRS, strip=2)
    assert not [x for x in plan(got).split("\n") if "Exchange" in x and "vec" in x] and "FlatMapGroupsInArrow" not in plan(got)
    want = {(10 * g + i, 10 * g + j) for g in (1, 2) for i in range(9) for j in range(i + 1, 9) if (i * j + 1) / np.sqrt((i * i + 1) * (j * j + 1)) >= 0.5}
    assert {(r.src, r.dst) for r in got.collect()} == want


def case(spark, repeated=False):
    """Vectors and evidence of two domains; a document and a section are without number, and one document stands in both."""
    rng = np.random.default_rng(3)
    rows = [(1 + i % 2, i, (rng.normal(size=4) + 0.7).tolist()) for i in range(40)] + [(2, 0, [1.0, 0.5, 0.2, 0.1])] * repeated
    met = [(u, c, int(rng.integers(0, 9))) for u in range(30) for c in rng.permutation(40)[:7].tolist()]
    documents = spark.createDataFrame([(u, c, p, 1 + 2 * (u % 2)) for u, c, p in met] + [(None, 3, 0, 1)], "unit bigint, concept_id bigint, pos int, w int")
    sections = spark.createDataFrame([((u // 2, u % 2), c, p) for u, c, p in met], "unit struct<doc_id: bigint, n: int>, concept_id bigint, pos int")
    definition = spark.createDataFrame([(1, 3, 0.9), (3, 1, 0.6), (4, 2, 0.7)], "src bigint, dst bigint, s_def double")
    return spark.createDataFrame(rows, "domain_id bigint, concept_id bigint, embedding array<double>"), signals.Evidence(documents, sections, 30, definition)


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("repeated", [False, True])
def test_counted_in_strips(spark, repeated, monkeypatch):
    monkeypatch.setattr(blocks, "CELLS", 100)
    monkeypatch.setattr(blocks, "MET", 10)
    vectors, evidence = case(spark, repeated)
    got, want = signals.pruned(vectors, evidence), signals.pruned(vectors, evidence.table())
    assert rounded(got) == rounded(want) and want.where("order_fwd > 0 and cooc > 0").count() > 20


def test_places_of_evidence(spark):
    vectors, evidence = case(spark)
    assert rounded(signals.pruned_order(vectors, evidence)) == rounded(signals.pruned_order(vectors, evidence.table()))
    assert "Join" not in plan(signal_queries.q_heuristic_order(spark, D))


def test_verdicts_beside_evidence(spark):
    vectors, evidence = case(spark)
    v = vectors.select(F.col("concept_id").alias("src"), (F.col("concept_id") + 2).alias("dst"), (F.col("concept_id") / 40).alias("s"))
    assert rounded(signals.pruned_plausible(vectors, evidence, v, most=3)) == rounded(signals.pruned_plausible(vectors, evidence.table(), v, most=3))
    assert "Join" not in plan(signal_queries.q_plausible(spark, D))


def test_profile_keeps_no_pairs_of_mentions(spark, monkeypatch):
    from gradus.session import Scratch

    kept, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, *by: kept.append(df.columns) or keep(self, df, *by))
    assert signal_queries.q_signal_profile(spark, D).count() == 6
    assert kept and not [c for c in kept if "cooc" in c]


def test_corr_joins_no_pairs(spark):
    assert "Join" not in plan(signal_queries.q_s_corr(spark, D))


def test_merge_joins_no_pairs(spark):
    assert "Join" not in plan(signal_queries.q_signal_merge(spark, D))
