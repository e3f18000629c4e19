import random

from gradus.llm.grouping import connected_groups

SCHEMA = "left_id bigint, right_id bigint, a string, v int, score double"


def brute(links):
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            par[max(a, b)] = min(a, b)
    return {x: find(x) for x in par}


def groups(spark, links, **kw):
    df = spark.createDataFrame([(a, b, "x", 1, None) for a, b in links], SCHEMA)
    got = connected_groups(df, "left_id", "right_id", **kw).collect()
    assert len(got) == len({r.record_id for r in got})
    return {r.record_id: r.group_id for r in got}


def test_random_links(spark):
    rng = random.Random(5)
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]
    links += [(1000, 1000 + i) for i in range(1, 200)]
    assert groups(spark, links) == brute([x for x in links if x[0] != x[1]])


def test_giant_with_long_tail_and_chains(spark):
    ids = list(range(500, 580))
    random.Random(1).shuffle(ids)
    links = [(5000, 6000 + i) for i in range(30)] + list(zip(ids, ids[1:])) + [(6000, ids[0])] + [(i, i + 1) for i in range(0, 40)]
    assert groups(spark, links, least_gain=0.5) == brute(links)


def test_dirty_links(spark):
    assert groups(spark, [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (5, None)]) == {1: 1, 2: 1}


def test_no_links(spark):
    assert groups(spark, []) == {}
    assert groups(spark, [(7, 7), (None, None)]) == {}
