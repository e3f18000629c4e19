import numpy as np
from gradus.llm import neighbours
from gradus.llm.neighbours import Hashing, nearest, similar_pairs

SCHEMA = "concept_id bigint, embedding array<float>, id string, vec int, n int"


def brute(rows, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    sims = np.round(x @ x.T, 12)
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sims[i, j], ids[j]))
        out[int(ids[i])] = [int(ids[j]) for j in order[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(z) for z in v], "c", 1, 2) for i, v in rows], SCHEMA)


def clustered(n, dims=64, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 20, dims))
    return [(i + 1, (centres[rng.integers(len(centres))] + 0.6 * rng.standard_normal(dims)).astype(np.float32)) for i in range(n)]


def test_recall_against_brute_force(spark):
    rows = clustered(1500)
    want = {(i, j) for i, js in brute(rows, 10).items() for j in js}
    got = {(r.id, r.near) for r in nearest(frame(spark, rows), "concept_id", "embedding").collect()}
    assert len(got & want) / len(want) > 0.95


def test_all_cells_visited_is_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)  # cells in many blocks give the same
    rows = clustered(90, dims=4, seed=2)
    found = nearest(frame(spark, rows), "concept_id", "embedding", k=4, dims=4, hashing=Hashing(tables=1, hashes=1, width=100.0, probes=3))
    got = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.near)
    assert got == brute(rows, 4)


def test_equal_vectors_and_ties(spark):
    base = np.eye(4)
    rows = [(i, base[0]) for i in range(1, 9)] + [(i, base[1]) for i in range(20, 23)] + [(30, base[0] + base[1])]
    found = nearest(frame(spark, rows), "concept_id", "embedding", k=3, dims=4, hashing=Hashing(tables=1, hashes=1, width=100.0, probes=3))
    got = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.near)
    assert got == brute(rows, 3)


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 0]), (2, [1, 0.1]), (2, [1, 0.1]), (3, None), (4, [0, 0]), (5, [nan, 1]), (6, [1]), (7, [inf, 1]), (None, [1, 1]), (8, [])]
    got = nearest(frame(spark, rows), "concept_id", "embedding", k=2, dims=2).collect()
    assert sorted((r.id, r.near) for r in got) == [(1, 2), (2, 1)]


def test_one_or_no_vector(spark):
    assert similar_pairs(nearest(frame(spark, [(1, [1, 2])]), "concept_id", "embedding", dims=2)).count() == 0
    assert nearest(frame(spark, []), "concept_id", "embedding").count() == 0


def shuffled(spark):
    """Bytes that the session's tasks have written to shuffles so far, and those whose files are still there."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    executors = sc.statusStore().executorList(False)
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size())), sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle"))


def test_no_vector_is_shuffled_for_a_visit(spark):
    n = 3000
    df = frame(spark, [(i + 1, x) for i, x in enumerate(np.random.default_rng(5).standard_normal((n, 64)))])
    written, left = shuffled(spark)
    assert nearest(df, "concept_id", "embedding").count() == 10 * n
    now, still = shuffled(spark)
    assert now - written < 8 * 256 * n  # 256 bytes of floats a vector: made distinct by key and by vector, sorted in two tables
    assert still - left < 256 * n  # no shuffle outlives the table that it is for


def test_places_beyond_the_outermost_cells():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.standard_normal((200, 8)), 1e6 * np.eye(8)])
    tables = Hashing(hashes=2, success=0.999999).fit(len(x), np.zeros(8), np.eye(8) * 1e-9)
    places = tables.places(x, 0)
    assert np.abs(places).max() == neighbours.REACH
    own = tables.chances(x, np.full(len(x), 1e-5), 0)
    assert own.visited(np.arange(len(x)), places, np.arange(len(x))).diagonal().all()
