import random

import numpy as np
import pytest
from gradus.llm import packing
from gradus.llm.packing import pack_texts, sum_of_squares
from pyspark.sql import functions as F


def slow(sizes, capacity):
    boxes, out = [], []
    for s in sizes:
        best = None
        for gap in sorted({b[0] for b in boxes if b[0] >= s}) + [capacity]:
            count = {}
            for b in boxes:
                count[b[0]] = count.get(b[0], 0) + 1
            if gap < capacity or any(b[0] == capacity for b in boxes):
                count[gap] = count.get(gap, 0) - 1
            if gap - s:
                count[gap - s] = count.get(gap - s, 0) + 1
            total = sum(n * n for g, n in count.items() if 0 < g < capacity)
            if best is None or total < best[0]:
                best = (total, gap)
        gap = best[1]
        at = max((i for i, b in enumerate(boxes) if b[0] == gap), key=lambda i: boxes[i][1], default=None) if gap < capacity else None
        if at is None:
            boxes.append([capacity, 0])
            at = len(boxes) - 1
        boxes[at] = [boxes[at][0] - s, len(out) + 1]
        out.append(at)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_rule_equals_its_definition(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 21) for _ in range(60)]
    assert sum_of_squares(np.array(sizes), 20)[0].tolist() == slow(sizes, 20)


def table(spark):
    rng = random.Random(9)
    texts = ["word " * rng.randrange(1, 400) for _ in range(120)] + ["", None, "word " * 5000, "word " * 5000]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumnRenamed("text", "body").selectExpr("doc_id", "body", "'x' container_id", "1 item", "2 doc")


@pytest.mark.parametrize("shard", [20_000, 25])
def test_pack_texts(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_ITEMS", shard)
    windows = spark.createDataFrame([(1, 512), (2, 2048), (3, None), (4, 0)], "window_id int, capacity_tokens int")
    rows = pack_texts(table(spark), "doc_id", "body", windows, "window_id", "capacity_tokens").collect()
    sizes = {i: sum(r.n_tokens for r in rows if r.window_id == 1 and r.doc_id == i) for i in range(124)}
    for w, cap in ((1, 512), (2, 2048)):
        own = [r for r in rows if r.window_id == w]
        filled = {}
        for r in own:
            if r.container_id is not None:
                filled[r.container_id] = filled.get(r.container_id, 0) + r.n_tokens
        assert max(filled.values()) <= cap and {r.doc_id for r in own} == set(range(124))
        for i, n in sizes.items():
            pieces = sorted((r.piece_no, r.token_start, r.n_tokens) for r in own if r.doc_id == i)
            assert sum(p[2] for p in pieces) == n and (len(pieces) == 1 or n > cap)
            assert [p[1] for p in pieces] == [sum(q[2] for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(filled.values()) / (len(filled) * cap) > 0.9
    assert {r.window_id for r in rows} == {1, 2} and all(r.container_id is None for r in rows if not r.n_tokens)


def test_nothing_to_pack(spark):
    windows = spark.createDataFrame([(1, 8)], "window_id int, capacity_tokens int")
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pack_texts(empty, "doc_id", "text", windows, "window_id", "capacity_tokens").count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert pack_texts(one, "doc_id", "text", windows.limit(0), "window_id", "capacity_tokens").count() == 0


def test_repeated_rows_are_items_of_their_own(spark):
    windows = spark.createDataFrame([(1, 4)], "window_id int, capacity_tokens int")
    df = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six")], "doc_id bigint, text string")
    rows = pack_texts(df, "doc_id", "text", windows, "window_id", "capacity_tokens").collect()
    filled = {}
    for r in rows:
        filled[r.container_id] = filled.get(r.container_id, 0) + r.n_tokens
    assert sum(filled.values()) == 12 and max(filled.values()) <= 4


def test_result_does_not_depend_on_partitions(spark):
    from gradus.llm import packing

    df = spark.createDataFrame([(i % 37 if i % 5 else None, "word " * (i % 23)) for i in range(300)], "doc_id bigint, text string")
    windows = spark.createDataFrame([(1, 16), (2, 40)], "window_id int, capacity_tokens int")
    one, two = (sorted(map(str, packing.pack_texts(df.repartition(n), "doc_id", "text", windows, "window_id", "capacity_tokens").collect())) for n in (1, 7))
    assert one == two
    p = packing.pack_texts(df.withColumn("doc_id", F.monotonically_increasing_id()), "doc_id", "text", windows, "window_id", "capacity_tokens")
    for r in packing.invariants(p, windows, "window_id", "capacity_tokens", "doc_id").collect():
        assert r.n_over == 0 and r.n_torn == 0 and r.unused < 0.1
