"""Parent-child rows as full hierarchies: root, depth, path, ancestors and descendants of every node, and its rings.

Subtree sizes are added up towards the roots, and siblings get consecutive preorder ranges by prefix sums on the way
down, so that each subtree is one range of numbers (nested sets). Both directions step in doubled strides along the
parent links: a tree of depth d takes about log2(d) rounds, whatever its width. Nodes that still have an ancestor to
step to when nothing is finished any more lie on or below a ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.session import Scratch

_SPACE = r"^[\s  - 　]+|[\s  - 　]+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, _SPACE, "")


def valid_rows(rows: DataFrame, node: str = "node_id", parent: str = "parent_id", children: str = "children_ids", changed: str = "updated_at") -> DataFrame:
    """(node, parent, children): of each node the row changed last; a null time is the earliest, equal times go to the greater row."""
    content = F.struct(F.col(parent).alias("parent"), F.col(children).alias("children"))
    last = rows.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.max(F.struct(F.col(changed), content.alias("c"))).alias("m"))
    return last.select("node", "m.c.*")


def child_places(valid: DataFrame) -> DataFrame:
    """(parent, node, place): where a node stands first in the list of children of a row (node, children), from 0."""
    listed = valid.select(F.col("node").alias("parent"), F.posexplode("children").alias("place", "node")).where("node is not null")
    return listed.groupBy("parent", "node").agg(F.min("place").alias("place"))


def parent_links(valid: DataFrame) -> DataFrame:
    """(node, parent) with parent null for roots.

    The parent is the stripped parent id; where that is empty, the node that lists this one (the least of several). A
    parent without a row of its own counts as none. A node may be its own parent, which is a ring.
    """
    named = valid.select("node", F.nullif(stripped(F.col("parent")), F.lit("")).alias("parent"), "children")
    listed = named.select(F.col("node").alias("lister"), F.explode("children").alias("node")).where("node is not null").groupBy("node").agg(F.min("lister").alias("lister"))
    own = named.where("parent is not null").select("node", "parent")
    other = named.where("parent is null").select("node").join(listed, "node", "left").select("node", F.col("lister").alias("parent"))
    there = named.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    return own.unionByName(other).join(there, "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("parent"))


class Forest:
    """Nested sets of all trees among ``links`` (node, parent), one row a node; see ``nested_sets``."""

    def __init__(self, links: DataFrame):
        self.scratch = Scratch(links.sparkSession, "forest")
        self.links = self.scratch.keep(links)
        self.strides: list[DataFrame] = []
        self._upward()
        self.nodes = self._downward()

    def _upward(self) -> None:
        """Sizes of subtrees, roots and depths; ``strides[k]`` has the ancestor 2**k steps above, where there is one.

        After k rounds ``size`` counts the nodes less than 2**k steps below, ``up`` is the ancestor 2**k steps above, and
        a node without one knows its root and depth.
        """
        state = self.links.select("node", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("size"), F.lit(0).alias("depth"), F.col("node").alias("top"))
        state = self.scratch.keep(state)
        left = state.where("up is not null").count()
        k = 0
        while left:
            self.strides.append(state.where("up is not null").select("node", "up"))
            below = state.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("below"))
            above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("top").alias("top2"))
            # Finished nodes step nowhere: kept out of the join, where all of them would have the same null key.
            moved = state.where("up is not null").join(above, "up").select("node", F.col("up2").alias("up"), "size", (F.lit(2**k) + F.col("depth2")).alias("depth"), F.col("top2").alias("top"))
            new = moved.unionByName(state.where("up is null")).join(below, "node", "left")
            state = self.scratch.keep(new.select("node", "up", (F.col("size") + F.coalesce("below", F.lit(0))).alias("size"), "depth", "top"))
            now = state.where("up is not null").count()
            k += 1
            if now == left:  # each round finishes the nodes whose ancestors just end, so none is left in a tree
                break
            left = now
        self.state = state

    def _offsets(self) -> DataFrame:
        """(node, parent, add): how far a node's number is above its parent's: 1 and the sizes of the siblings before it.

        Siblings are ordered by name over all partitions: sums within a partition first, then those of the partitions
        before, so that a parent with very many children is no single task.
        """
        alive = self.state.where("up is null").select("node", "size")
        kids = self.links.where("parent is not null").join(alive, "node").repartitionByRange("parent", "node").withColumn("part", F.spark_partition_id())
        kids = self.scratch.keep(kids)
        parts = kids.groupBy("parent", "part").agg(F.sum("size").alias("whole"))
        before = Window.partitionBy("parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("parent", "part", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("base"))
        within = Window.partitionBy("parent", "part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        sums = kids.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        return sums.join(parts, ["parent", "part"]).select("node", "parent", (1 + F.col("inner") + F.col("base")).alias("add"))

    def _downward(self) -> DataFrame:
        """(node, parent, root, depth, first, size); root '' and depth -1 on or below a ring, with first and size null."""
        offsets = self._offsets()
        sums = self.state.select("node", "top", "depth", "size", F.col("up").isNotNull().alias("ring")).join(offsets.select("node", "add"), "node", "left")
        sums = self.scratch.keep(sums.select("node", "top", "depth", "size", "ring", F.coalesce("add", F.lit(0)).cast("bigint").alias("first")))
        for stride in self.strides:
            above = sums.select(F.col("node").alias("up"), F.col("first").alias("more"))
            moved = sums.join(stride, "node").join(above, "up").select("node", "top", "depth", "size", "ring", (F.col("first") + F.col("more")).alias("first"))
            new = moved.unionByName(sums.join(stride, "node", "left_anti"))
            old, sums = sums, self.scratch.keep(new)
            self.scratch.drop(old)
        fine = ~F.col("ring")
        out = sums.join(self.links, "node").select("node", "parent", F.when(fine, F.col("top")).otherwise("").alias("root"), F.when(fine, F.col("depth")).otherwise(-1).alias("depth"), F.when(fine, F.col("first")).alias("first"), F.when(fine, F.col("size")).alias("size"))
        return self.scratch.keep(out)

    def descendants(self) -> DataFrame:
        """(ancestor, node, steps): each node of a tree with each of its ancestors, by nested-set ranges.

        A range is cut into its dyadic blocks and a number names the block of each width it is in, which makes the range
        join one on equal keys: no tree, however large, is joined with itself.
        """
        tree = self.nodes.where("depth >= 0 and size > 1")
        lo, hi = F.col("first") + 1, F.col("first") + F.col("size")
        blocks = tree.select(F.col("node").alias("ancestor"), F.col("depth").alias("d"), "root", F.explode(dyadic_blocks(lo, hi)).alias("b"))
        widths = [r[0] for r in blocks.select("b.width").distinct().collect()]  # at most 62
        if not widths:
            return tree.select(F.col("node").alias("ancestor"), "node", F.col("depth").alias("steps")).limit(0)
        levels = F.array(*(F.struct(F.lit(w).alias("width"), F.shiftright("first", w).alias("no")) for w in sorted(widths)))
        points = self.nodes.where("depth > 0").select("node", "depth", "root", F.explode(levels).alias("p"))
        blocks = blocks.select("ancestor", "d", "root", "b.width", "b.no")
        return points.select("node", "depth", "root", "p.width", "p.no").join(blocks, ["root", "width", "no"]).select("ancestor", "node", (F.col("depth") - F.col("d")).alias("steps"))

    def gathered(self, values: DataFrame, shared: bool = False) -> DataFrame:
        """(node, total): sum of the values (node, x) of each tree node and of all below it; ``shared``: each step up divides by the number of children.

        Sums travel up in the strides: after k rounds a total covers the nodes less than 2**k steps below, and ``share``
        is the product of 1 / children over 2**k steps. No pair of a node and its ancestor is built.
        """
        tree = self.nodes.where("depth >= 0").select("node", "parent")
        kids = tree.where("parent is not null").groupBy(F.col("parent")).agg((1.0 / F.count("*")).alias("share") if shared else F.lit(1.0).alias("share"))
        state = tree.join(values.select("node", "x"), "node", "left").join(kids, "parent", "left").select("node", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("total"), "share")
        state = self.scratch.keep(state)
        for stride in self.strides:
            step = stride.join(state, "node")
            below = step.groupBy(F.col("up").alias("node")).agg(F.sum(F.col("total") * F.col("share")).alias("below"))
            further = step.join(state.select(F.col("node").alias("up"), F.col("share").alias("more")), "up").select("node", (F.col("share") * F.col("more")).alias("next"))
            new = state.join(below, "node", "left").join(further, "node", "left").select("node", (F.col("total") + F.coalesce("below", F.lit(0.0))).alias("total"), F.col("next").alias("share"))
            old, state = state, self.scratch.keep(new)
            self.scratch.drop(old)
        return state.select("node", "total")

    def below(self, marked: DataFrame) -> DataFrame:
        """(node): each tree node with a marked one (node) among its ancestors, found in the strides."""
        flag = marked.select(F.col("node").alias("parent"), F.lit(True).alias("hit")).distinct()
        state = self.nodes.where("depth >= 0").select("node", "parent").join(flag, "parent", "left").select("node", F.coalesce("hit", F.lit(False)).alias("hit"))
        state = self.scratch.keep(state)
        for stride in self.strides:
            up = stride.join(state.where("hit").select(F.col("node").alias("up")), "up").select("node", F.lit(True).alias("far"))
            old, state = state, self.scratch.keep(state.join(up, "node", "left").select("node", (F.col("hit") | F.coalesce("far", F.lit(False))).alias("hit")))
            self.scratch.drop(old)
        return state.where("hit").select("node")

    def paths(self, label: Column | None = None) -> DataFrame:
        """(node, path): the nodes from the root to each node of a tree, as a list."""
        sofar = self.nodes.select("node", F.array("node").alias("path"))
        fine = self.nodes.where("depth >= 0").select("node")
        sofar = self.scratch.keep(sofar.join(fine, "node", "left_semi"))
        for stride in self.strides:
            above = sofar.select(F.col("node").alias("up"), F.col("path").alias("head"))
            moved = sofar.join(stride, "node").join(above, "up").select("node", F.concat("head", "path").alias("path"))
            new = moved.unionByName(sofar.join(stride, "node", "left_anti"))
            old, sofar = sofar, self.scratch.keep(new)
            self.scratch.drop(old)
        return sofar


def dyadic_blocks(lo: Column, hi: Column) -> Column:
    """Blocks (width, no) of numbers no * 2**width .. (no + 1) * 2**width - 1 that together are lo .. hi - 1.

    From below, a block starts at every set bit of the rising start; from above, at every set bit of the end.
    """
    kind = "array<struct<width:int,no:bigint>>"

    def step(acc: Column, w: Column) -> Column:
        a, b = acc["a"], acc["b"]
        low = (a < b) & (a.bitwiseAND(F.lit(1)) == 1)
        a2 = F.when(low, a + 1).otherwise(a)
        high = (a2 < b) & (b.bitwiseAND(F.lit(1)) == 1)
        b2 = F.when(high, b - 1).otherwise(b)
        out = F.concat(acc["out"], F.when(low, F.array(F.struct(w.alias("width"), a.alias("no")))).otherwise(F.array().cast(kind)), F.when(high, F.array(F.struct(w.alias("width"), (b - 1).alias("no")))).otherwise(F.array().cast(kind)))
        return F.struct(F.shiftright(a2, 1).alias("a"), F.shiftright(b2, 1).alias("b"), out.cast(kind).alias("out"))

    start = F.struct(lo.cast("bigint").alias("a"), hi.cast("bigint").alias("b"), F.array().cast(kind).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(61)), start, step, lambda acc: acc["out"])


def hierarchy(rows: DataFrame, node: str = "node_id", parent: str = "parent_id", children: str = "children_ids", changed: str = "updated_at") -> Forest:
    """The forest of the valid rows of a table with parent ids and lists of children.

    Repeated and outdated rows of a node, null or blank parents, lists that are null or have null, repeated or unknown
    entries, and parents without a row are all allowed; rows without a node id are left out; an empty table is an
    empty forest. Columns beyond the four named play no part.
    """
    return Forest(parent_links(valid_rows(rows, node, parent, children, changed)))
