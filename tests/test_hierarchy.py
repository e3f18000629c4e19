"""The hierarchy operator on forests with rings, against steps along the parents."""

import random

from gradus.operators.hierarchy import Forest, hierarchy

SCHEMA = "node_id string, parent_id string, children_ids array<string>, updated_at timestamp"


def brute(parent):
    out = {}
    for n in parent:
        seen, at = [n], parent[n]
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        out[n] = ("", -1, None) if at is not None else (seen[-1], len(seen) - 1, seen[::-1])
    return out


def links(spark, parent):
    return spark.createDataFrame(list(parent.items()), "node string, parent string")


def check(spark, parent):
    f, want = Forest(links(spark, parent)), brute(parent)
    assert {r.node: (r.root, r.depth) for r in f.nodes.collect()} == {n: w[:2] for n, w in want.items()}
    assert {r.node: r.path for r in f.paths().collect()} == {n: w[2] for n, w in want.items() if w[2]}
    pairs = {(a, n): w[2].index(n) - w[2].index(a) for n, w in want.items() if w[2] for a in w[2][:-1]}
    assert {(r.ancestor, r.node): r.steps for r in f.descendants().collect()} == pairs
    for r in f.nodes.where("depth >= 0").collect():
        assert r["size"] == 1 + sum(a == r.node for a, _ in pairs)


def test_random_forests_with_rings(spark):
    rng = random.Random(3)
    parent = {f"n{i}": None if i < 3 or rng.random() < 0.1 else f"n{rng.randrange(i)}" for i in range(60)}
    parent |= {"r0": "r1", "r1": "r2", "r2": "r0", "below": "r1", "self": "self"}
    check(spark, parent)


def test_long_chain_and_wide_parent(spark):
    parent = {"c0": None} | {f"c{i}": f"c{i - 1}" for i in range(1, 70)} | {f"w{i}": "c1" for i in range(300)}
    check(spark, parent)


def test_only_a_ring_and_nothing(spark):
    check(spark, {"a": "b", "b": "a"})
    f = Forest(spark.createDataFrame([], "node string, parent string"))
    assert f.nodes.count() == 0 and f.descendants().count() == 0 and f.paths().count() == 0


def test_dirty_rows(spark):
    t = ["2024-01-01", "2024-01-02"]
    rows = [
        ("root", None, ["a", "a", None, "gone"], t[0]),
        ("root", None, ["a", "a", None, "gone"], t[0]),
        ("a", "  ", None, t[0]),
        ("b", "\t a\n", [], t[0]),
        ("c", "b", [], t[0]),
        ("c", "root", [], t[1]),
        ("d", "missing", [], None),
        ("e", "", ["x"], t[0]),
        (None, "root", [], t[0]),
    ]
    df = spark.createDataFrame(rows, "node_id string, parent_id string, children_ids array<string>, t string").selectExpr("node_id", "parent_id", "children_ids", "cast(t as timestamp) updated_at", "1 as root", "2 as depth")
    got = {r.node: (r.root, r.depth) for r in hierarchy(df).nodes.collect()}
    assert got == {"root": ("root", 0), "a": ("root", 1), "b": ("root", 2), "c": ("root", 1), "d": ("d", 0), "e": ("e", 0)}
