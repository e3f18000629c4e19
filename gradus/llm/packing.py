"""Filling containers of fixed capacity with items of varying length, by the sum-of-squares rule.

Shards of items, cut at random by a hash of the key, are packed side by side; each shard puts its items, one after the
other, where the sum over all residual gaps of the squared number of open containers with that gap becomes least. Two
further passes pack again, in other shards, what went into containers that are not nearly full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.bpe import TOKENIZER, count_tokens
from gradus.session import Scratch

#: Items of one shard; bounds what a task holds, and what a pass leaves open by shard.
SHARD_ITEMS = 20_000
PASSES = 3


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Container number of each item, in the order given, and the number of containers.

    Sizes are at least 1 and at most ``capacity``. An item goes to the open container, or to a new one, for which the
    sum of squares of the counts of open containers by residual gap is least afterwards; of equal ones to the one with
    the smallest gap, and to a new one last. Of the containers with the chosen gap the one that got it last is filled.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap; gaps 0 and capacity are never counted
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    none = np.iinfo(np.int64).max
    total = 0
    for i, size in enumerate(sizes.tolist()):
        # taking a gap g to g - size changes the sum by 2 * (count[g - size] - count[g] + 1); to 0 by 1 - 2 * count[g]
        there = count[size:]
        change = np.where(there > 0, 2 * (count[: capacity + 1 - size] - there + 1), none)
        if there[0] > 0:
            change[0] = 1 - 2 * there[0]
        gap = int(change.argmin()) + size
        opened = 2 * count[capacity - size] + 1 if size < capacity else 0
        if change[gap - size] <= opened and change[gap - size] != none:
            box = by_gap[gap].pop()
            count[gap] -= 1
        else:
            box, gap = total, capacity
            total += 1
        out[i] = box
        if gap > size:
            by_gap[gap - size].append(box)
            count[gap - size] += 1
    return out, total


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard, its largest items first: the container of each item, and what that container holds."""
    pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable")
    sizes = pdf["size"].to_numpy()
    box, n = sum_of_squares(sizes, int(pdf["capacity"].iloc[0]))
    filled = np.bincount(box, weights=sizes, minlength=n).astype(np.int64)
    return pdf.assign(box=box, filled=filled[box])


def pack(items: DataFrame, scratch: Scratch) -> DataFrame:
    """Items (window_id, capacity, item, size, ...) with the added column container_id, unique in a window.

    Three passes over shards of about ``SHARD_ITEMS`` items; each packs again what the one before put into containers
    that stay more than a hundredth empty, in other company and fewer shards. No task holds more than a shard, whatever the sizes are.
    """
    done = []
    for turn in range(1, PASSES + 1):
        count = items.groupBy("window_id").count().select("window_id", F.ceil(F.col("count") / SHARD_ITEMS).alias("shards"))
        sharded = items.join(F.broadcast(count), "window_id").withColumn("shard", F.pmod(F.xxhash64("item", "window_id", F.lit(turn)), "shards")).drop("shards")
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sharded.schema.fields)
        packed = scratch.keep(sharded.groupBy("window_id", "shard").applyInPandas(_pack, f"{kind}, box bigint, filled bigint"))
        name = F.format_string("%d-%d-%d", F.lit(turn), F.col("shard"), F.col("box"))
        good = F.col("filled") >= F.col("capacity") * 0.99 if turn < PASSES else F.lit(True)
        done.append(packed.where(good).select(*items.columns, name.alias("container_id")))
        items = packed.where(~good).select(*items.columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def invariants(packed: DataFrame, windows: DataFrame, window: str, capacity: str, key: str) -> DataFrame:
    """(window_id, n_tokens, n_containers, n_over, n_torn, unused): of each capacity the tokens packed, containers, those over capacity, texts split though they fit, and the unused share."""
    caps = windows.where(F.col(capacity) >= 1).groupBy(F.col(window).cast("int").alias("window_id")).agg(F.max(capacity).cast("bigint").alias("capacity"))
    rows = packed.where("container_id is not null").join(caps, "window_id")
    boxes = rows.groupBy("window_id", "capacity", "container_id").agg(F.sum("n_tokens").alias("filled"))
    boxes = boxes.groupBy("window_id").agg(F.sum("filled").alias("n_tokens"), F.count("*").alias("n_containers"), F.count_if(F.col("filled") > F.col("capacity")).alias("n_over"), (1 - F.sum("filled") / F.sum("capacity")).alias("unused"))
    pieces = rows.groupBy("window_id", "capacity", key).agg(F.sum("n_tokens").alias("size"), F.max("piece_no").alias("last"))
    torn = pieces.groupBy("window_id").agg(F.count_if((F.col("last") > 0) & (F.col("size") <= F.col("capacity"))).alias("n_torn"))
    return boxes.join(torn, "window_id").select("window_id", "n_tokens", "n_containers", "n_over", "n_torn", F.round("unused", 4).alias("unused"))


def pack_texts(docs: DataFrame, key: str, text: str, windows: DataFrame, window: str, capacity: str, path: str = TOKENIZER) -> DataFrame:
    """(window_id, container_id, <key>, piece_no, token_start, n_tokens): where the tokens of each text go, for each capacity.

    A text that fits a container is one piece, piece_no 0. A longer one is cut into pieces of exactly the capacity,
    which fill a container each, and a rest, which is packed like any item. Texts without tokens (null or empty) take
    no container: one row with container_id null and n_tokens 0. Every row of ``docs`` is an item of its own, also
    where a key repeats or is null. Capacities that are null or below 1 are left out; no documents or no capacity
    give no rows. ``windows`` is a small table of at most 1,000 rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    caps = windows.where(F.col(capacity) >= 1).select(F.col(window).cast("int"), F.col(capacity).cast("bigint")).distinct().limit(1001).collect()
    if len(caps) > 1000:
        raise ValueError("more than 1000 containers sizes")
    # Rows of one key and size can stand for each other, so they are numbered within these: the result does not depend on the partitioning.
    counts = count_tokens(docs, key, text, path).groupBy(F.col(key).alias("doc"), "n_tokens").agg(F.count("*").alias("copies"))
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    sizes = scratch.keep(counts.select("doc", "n_tokens", copy).select("doc", "n_tokens", F.concat_ws("~", F.col("doc").cast("string"), F.col("n_tokens").cast("string"), F.col("copy").cast("string")).alias("item")))
    kinds = F.array(*(F.struct(F.lit(w).alias("window_id"), F.lit(c).alias("capacity")) for w, c in caps)) if caps else F.array().cast("array<struct<window_id:int,capacity:bigint>>")
    each = sizes.select("doc", "item", "n_tokens", F.inline(kinds))
    n, cap = F.col("n_tokens"), F.col("capacity")
    whole = F.when(n > cap, F.floor(n / cap)).otherwise(0).cast("int")
    items = each.where(n - whole * cap > 0).select("window_id", "capacity", "item", (n - whole * cap).alias("size"), "doc", whole.alias("piece_no"))
    rest = pack(items, scratch).select("window_id", "container_id", "doc", "piece_no", (F.col("piece_no") * cap).alias("token_start"), F.col("size").alias("n_tokens"))
    full = each.where(n > cap).select("window_id", "doc", "item", cap.alias("n_tokens"), F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece_no"))
    full = full.select("window_id", F.format_string("0-%s-%d", "item", "piece_no").alias("container_id"), "doc", "piece_no", (F.col("piece_no") * F.col("n_tokens")).alias("token_start"), "n_tokens")
    none = each.where(n == 0).select("window_id", F.lit(None).cast("string").alias("container_id"), "doc", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("token_start"), "n_tokens")
    return full.unionByName(rest).unionByName(none).withColumnRenamed("doc", key)
