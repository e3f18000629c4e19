"""Study paths: the best set of items within a budget that holds every item's prerequisites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.operators.graph import closure, nodes_of
from gradus.session import Scratch


def _forest(order: list[int], need: list[int], ratio: list[float]) -> tuple[list[int], list[int]]:
    """The items of ``order`` with each behind all it needs, and for each place where those end that need its item.

    An item is below the last placed of those it needs, and the items below one follow it at once. Otherwise larger ratios come first.
    """
    unlocks, missing = {i: [] for i in order}, {i: need[i].bit_count() for i in order}
    for i in order:
        n = need[i]
        while n:
            unlocks[(n & -n).bit_length() - 1].append(i)
            n &= n - 1
    first = lambda items: sorted(items, key=lambda i: -ratio[i])[::-1]
    out, at, end = [], {}, [0] * len(order)
    stack = [(i, False) for i in first([i for i in order if not missing[i]])]
    while stack:
        i, left = stack.pop()
        if left:
            end[at[i]] = len(out)
            continue
        at[i] = len(out)
        out.append(i)
        stack.append((i, True))
        for j in unlocks[i]:
            missing[j] -= 1
        stack += [(j, False) for j in first([j for j in unlocks[i] if not missing[j]])]
    return out, end


def solve(ids: list, values: list[float], costs: list[float], edges: set[tuple], budget: float, goal=None, most_steps: int | None = None) -> tuple[bool, bool, float, list]:
    """Precedence-constrained knapsack by branch and bound: (feasible, optimal, best value, chosen ids).

    An edge (u, v) means that v needs u. The goal, if given, must be chosen. Items are tried in the order of value per cost,
    each behind what it needs; of equal values the first found counts. The bound is the best choice of the items left if each
    needed only one of those it needs, from a table over the budget; of states that differ only in what no item left needs, the most
    valuable goes on. After ``most_steps`` branches the best so far is given with optimal false. A budget of 0 or less, or a
    goal that does not fit, is infeasible.
    """
    if budget <= 0:
        return False, True, 0.0, []
    place = {x: i for i, x in enumerate(ids)}
    need = [0] * len(ids)
    for u, v in edges:
        if u in place and v in place:
            need[place[v]] |= 1 << place[u]
    order, done = [], 0
    while len(order) < len(ids):
        ready = [i for i in range(len(ids)) if not done >> i & 1 and need[i] & ~done == 0]
        if not ready:  # a ring: none of its items can be chosen
            break
        order += ready
        for i in ready:
            done |= 1 << i
    must = 0
    if goal is not None:
        if goal not in place or not done >> place[goal] & 1:
            return False, True, 0.0, []
        todo = [place[goal]]
        while todo:
            i = todo.pop()
            if not must >> i & 1:
                must |= 1 << i
                todo += [j for j in range(len(ids)) if need[i] >> j & 1]
    spent = sum(costs[i] for i in range(len(ids)) if must >> i & 1)
    if spent > budget:
        return False, True, 0.0, []
    ratio = [v / c if c > 0 else float("inf") for v, c in zip(values, costs, strict=True)]
    open_ = [i for i in order if not must >> i & 1]
    free, end = _forest(open_, [n & ~must for n in need], ratio)
    # Costs rounded down to at most a thousand units of the budget: never less than what can be added.
    unit = max(1.0, budget / 1000)
    most = int((budget - spent) // unit)
    bound = np.zeros((len(free) + 1, most + 1))
    for k in range(len(free) - 1, -1, -1):
        bound[k] = bound[end[k]]
        c = max(0, int(costs[free[k]] // unit))
        if c <= most:
            np.maximum(bound[k, c:], bound[k + 1, : most + 1 - c] + values[free[k]], out=bound[k, c:])
    last, needed = 0, [0] * (len(free) + 1)
    for k in range(len(free) - 1, -1, -1):
        last |= need[free[k]]
        needed[k] = last
    best, chosen, steps, seen = -1.0, 0, 0, {}
    stack = [(0, must, spent, sum(values[i] for i in range(len(ids)) if must >> i & 1))]
    while stack:
        k, taken, cost, value = stack.pop()
        steps += 1
        if value > best + 1e-9:
            best, chosen = value, taken
        if most_steps is not None and steps > most_steps:
            break
        if k == len(free) or value + bound[k, min(most, int((budget - cost) // unit))] <= best + 1e-9:
            continue
        state = (k, taken & needed[k], cost)
        if seen.get(state, float("-inf")) >= value:
            continue
        seen[state] = value
        i = free[k]
        stack.append((end[k], taken, cost, value))
        if need[i] & ~taken == 0 and cost + costs[i] <= budget:
            stack.append((k + 1, taken | 1 << i, cost + costs[i], value + values[i]))
    return True, most_steps is None or steps <= most_steps, max(best, 0.0), [ids[i] for i in order if chosen >> i & 1]


def knapsacks(items: DataFrame, needs: DataFrame, budgets: DataFrame, most_steps: int | None = None) -> DataFrame:
    """(grp, feasible, optimal, best_value, chosen) for each group of ``items`` (grp, id, value, cost).

    ``needs``: (grp, src, dst) with dst needing src; ``budgets``: (grp, budget, goal). A group is one learner's plan of at
    most some hundred items. Items with a null value or cost are left out; a group without items is infeasible.
    """
    own = items.where("value is not null and cost is not null").groupBy("grp").agg(F.sort_array(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), F.col("value").cast("double").alias("value"), F.col("cost").cast("double").alias("cost")))).alias("items"))
    links = needs.groupBy("grp").agg(F.collect_set(F.struct(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))).alias("links"))
    plans = budgets.join(own, "grp", "left").join(links, "grp", "left").select(F.col("grp").cast("string").alias("grp"), F.col("budget").cast("double").alias("budget"), F.col("goal").cast("string").alias("goal"), "items", "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            # One group after the other: as Python objects, the items of a whole batch take many times the memory of their columns.
            for grp, budget, goal, own_, links_ in zip(*b.columns, strict=True):
                its, ends = own_.values, links_.values
                edges = set(zip(ends.field("src").to_pylist(), ends.field("dst").to_pylist(), strict=True)) if ends is not None else set()
                got = solve(*(its.field(c).to_pylist() for c in ("id", "value", "cost")), edges, budget.as_py(), goal.as_py(), most_steps) if its is not None and len(its) else (False, True, 0.0, [])
                rows.append((grp.as_py(), *got))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), pa.bool_(), pa.bool_(), pa.float64(), pa.list_(pa.string())), strict=True)], names=["grp", "feasible", "optimal", "best_value", "chosen"])

    return plans.mapInArrow(run, "grp string, feasible boolean, optimal boolean, best_value double, chosen array<string>")


def scopes(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """(grp, id): the nodes of an acyclic graph that each goal (grp, goal) is planned over.

    The goal and its ancestors; for a goal without any the goal and its descendants, if these are three or more; else all nodes.
    """
    reach = closure(edges).select("src", "dst")
    up = goals.join(reach.withColumnRenamed("dst", "goal"), "goal").select("grp", "goal", F.col("src").alias("id"))
    rest = goals.join(up.select("grp").distinct(), "grp", "left_anti")
    down = rest.join(reach.withColumnRenamed("src", "goal"), "goal").select("grp", "goal", F.col("dst").alias("id"))
    wide = down.groupBy("grp").count().where("count >= 3").select("grp")
    down = down.join(wide, "grp", "left_semi")
    own = up.unionByName(down)
    bounded = own.select("grp", "id").unionByName(own.select("grp", F.col("goal").alias("id")))
    # Every node, for each goal that nothing bounds.
    lone = rest.join(wide, "grp", "left_anti").select("grp", F.lit(1).alias("k"))
    return bounded.unionByName(lone.join(nodes_of(edges).select(F.col("node").alias("id"), F.lit(1).alias("k")), "k").select("grp", "id")).distinct()


def optimize_paths(edges: DataFrame, nodes: DataFrame, goals: DataFrame, mastery: DataFrame | None = None, mastered: float = 0.8, minutes: float = 15.0, cross: float = 0.3) -> DataFrame:
    """(grp, place, id, feasible): for each goal (grp, goal, budget) the nodes to study, in order.

    Over the goal's scope, without what is ``mastered`` (mastery: grp, id, level): the choice of the largest value within the
    budget, with all prerequisites in the scope and the goal. Value is the number of nodes of the scope that a node leads to, those
    of another cluster counting ``cross``, at least 1; cost the estimated minutes, ``minutes`` where unknown. ``nodes``: (node, cluster,
    cost). The order is by longest-path depth, then larger value, then id. Where no choice is feasible, the first nodes of the scope in
    that order, one for every ``minutes`` of the budget, at least one.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    scope = scratch.keep(scopes(edges, goals))
    reach = scratch.keep(closure(edges, longest=True))
    deep = reach.groupBy(F.col("dst").alias("id")).agg(F.max("most").alias("depth"))
    about = nodes.groupBy(F.col("node").alias("id")).agg(F.min("cluster").alias("cluster"), F.max("cost").alias("cost"))
    a = scope.join(about, "id", "left").select("grp", F.col("id").alias("src"), F.col("cluster").alias("ca"))
    b = scope.join(about, "id", "left").select("grp", F.col("id").alias("dst"), F.col("cluster").alias("cb"))
    w = F.when(F.col("ca").isNull() | F.col("ca").eqNullSafe(F.col("cb")), 1.0).otherwise(cross)
    value = a.join(reach.where("src <> dst").select("src", "dst"), "src").join(b, ["grp", "dst"]).groupBy("grp", F.col("src").alias("id")).agg(F.sum(w).alias("value"))
    items = scope.join(value, ["grp", "id"], "left").join(about, "id", "left").join(deep, "id", "left")
    items = items.select("grp", "id", F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(1.0)).alias("value"), F.coalesce(F.nullif(F.col("cost").cast("double"), F.lit(0.0)), F.lit(minutes)).alias("cost"), F.coalesce("depth", F.lit(0)).alias("depth"))
    if mastery is not None:
        items = items.join(mastery.where(F.col("level") >= mastered).select("grp", "id").distinct(), ["grp", "id"], "left_anti")
    items = scratch.keep(items)
    needs = edges.join(items.select("grp", F.col("id").alias("src")), "src").join(items.select("grp", F.col("id").alias("dst")), ["grp", "dst"]).select("grp", "src", "dst")
    here = goals.join(items.select("grp", F.col("id").alias("goal"), F.lit(True).alias("open")), ["grp", "goal"], "left")
    plans = scratch.keep(knapsacks(items, needs, here.select("grp", "budget", F.when(F.col("open"), F.col("goal")).alias("goal"))))
    plans = plans.select(F.col("grp").alias("g"), (F.col("feasible") & (F.size("chosen") > 0)).alias("feasible"), "chosen")
    order = Window.partitionBy("grp").orderBy("depth", F.desc("value"), "id")
    all_ = items.join(goals.select("grp", "budget"), "grp").join(plans, F.col("g") == F.col("grp").cast("string"))
    chosen = all_.where(F.col("feasible") & F.array_contains("chosen", F.col("id").cast("string"))).withColumn("place", F.row_number().over(order))
    most = F.greatest(F.lit(1), F.floor(F.col("budget") / minutes))
    other = all_.where(~F.col("feasible")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return chosen.unionByName(other).select("grp", "place", "id", "feasible")
