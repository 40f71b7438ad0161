"""Hierarchies as intervals: what is below a node is a range of numbers.

Every node of a forest gets its root, depth, subtree size, pre-order number `pre` and `last`, the
number of its last descendant, so v is at or below u if u.pre <= v.pre <= u.last. They are found in
rounds, as many as the logarithm of the depth, by pointers that double: a node knows the ancestor 2^k above it, how far
that is, and how many nodes are less than 2^k below itself; the nodes exactly 2^k below add theirs.
Sizes of earlier siblings make a node's offset from its parent's number, and numbers are sums of
offsets along the same pointers. No round goes by level, and no node's children meet in a task.

A node has one parent; a second one, or a cycle, is an error. Siblings are in order of their names.
Edges with a null end are left out. What isn't a forest is `graph.closure`'s."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.lineage import cut, remove, shared_dir
from ledgerloom.operators.inverted import mark, path_of
from ledgerloom.operators.ranges import sum_before

#: Numbers that a range is cut into for an equality join.
BLOCK = 4096
LABELS = "node string, parent string, root string, depth long, size long, pre long, last long"


class NotAForest(ValueError):
    """A node has two parents, or is its own ancestor."""


def pointers(parents: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, parent, root, depth, size) and the pointers (node, jump) of each round. parents: node and parent, null for roots."""
    state = cut(parents.select("node", "parent", F.col("parent").alias("jump"), F.coalesce("parent", "node").alias("root"), F.col("parent").isNotNull().cast("long").alias("depth"), F.lit(1).cast("long").alias("size")), "pointers")
    rounds, jumps = math.ceil(math.log2(state.count() + 1)) + 1, []
    while True:
        live = cut(state.where("jump is not null").select("node", "jump"), "jumps")
        if live.isEmpty():
            remove(live)
            return state.drop("jump"), jumps
        if len(jumps) > rounds:
            raise NotAForest(f"{live.count()} nodes never reach a root: there is a cycle")
        jumps.append(live)
        hop = state.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"), F.col("root").alias("far"))
        moved = live.join(hop, "jump").select("node", "next", "more", "far")
        below = state.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.sum("size").alias("under"))
        both = state.join(moved, "node", "left").join(below, "node", "left")
        state = cut(both.select("node", "parent", F.col("next").alias("jump"), F.coalesce("far", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("size") + F.coalesce("under", F.lit(0))).alias("size")), "pointers", instead_of=state)


def label(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """LABELS of each node, and the pointers of each round; edges: src (parent) and dst (child)."""
    known = edges.where("src is not null and dst is not null").select("src", "dst")
    held = known.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"), F.max("src").alias("other"))
    tops = known.select(F.col("src").alias("node")).distinct().join(held.select("node"), "node", "left_anti").select("node", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("other"))
    held = cut(held.unionByName(tops), "parents")
    if not held.where("parent <> other").isEmpty():
        raise NotAForest("a node has two parents")
    state, jumps = pointers(held)
    # roots come one after another, as if they had a parent that isn't counted
    placed = sum_before(state.withColumn("__of", F.coalesce("parent", F.lit(""))), ["__of"], [F.asc("node")], F.col("size"), "pre").drop("__of")
    placed = cut(placed.withColumn("pre", F.col("pre") + F.col("parent").isNotNull().cast("long")), "offsets")
    for jump in jumps:
        far = jump.join(placed.select(F.col("node").alias("jump"), F.col("pre").alias("up")), "jump").select("node", "up")
        placed = cut(placed.join(far, "node", "left").withColumn("pre", F.col("pre") + F.coalesce("up", F.lit(0))).drop("up"), "offsets", instead_of=placed)
    return placed.withColumn("last", F.col("pre") + F.col("size") - 1).select("node", "parent", "root", "depth", "size", "pre", "last"), jumps


class Hierarchy:
    """Labels and pointers of a forest, in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        rounds = spark.read.schema("rounds int").parquet(f"{folder}/about").first().rounds
        self.labels = spark.read.schema(LABELS).parquet(f"{folder}/labels")
        self.jumps = [spark.read.schema("node string, jump string").parquet(f"{folder}/jumps-{k}") for k in range(rounds)]

    def descendants(self, roots: DataFrame) -> DataFrame:
        """root, node and depth of everything at or below each root (node): a range join, made an equality of blocks of numbers.

        A block meets the ranges that reach into it, of which there are no more than roots in it and above it."""
        top = roots.select("node").distinct().join(self.labels, "node").select(F.col("node").alias("root"), F.col("depth").alias("from"), F.col("pre").alias("low"), "last")
        blocks = top.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("last") / BLOCK))))
        nodes = self.labels.select("node", "depth", "pre", F.floor(F.col("pre") / BLOCK).alias("block"))
        return nodes.join(blocks, "block").where("pre between low and last").select("root", "node", (F.col("depth") - F.col("from")).cast("int").alias("depth"))

    def ancestors(self, starts: DataFrame) -> DataFrame:
        """start, node and depth of everything at or above each start (node), in a round for each pointer."""
        found = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
        for k, jump in enumerate(self.jumps):
            found = found.unionByName(found.join(jump, "node").select("start", F.col("jump").alias("node"), (F.col("depth") + (1 << k)).alias("depth")))
        return found


def build(edges: DataFrame, folder: str) -> Hierarchy:
    spark = edges.sparkSession
    labels, jumps = label(edges)
    labels.repartitionByRange("pre").sortWithinPartitions("pre").write.mode("overwrite").parquet(f"{folder}/labels")
    for k, jump in enumerate(jumps):
        jump.write.mode("overwrite").parquet(f"{folder}/jumps-{k}")
        remove(jump)
    spark.range(1).select(F.lit(len(jumps)).cast("int").alias("rounds")).write.mode("overwrite").parquet(f"{folder}/about")
    return Hierarchy(spark, folder)


def hierarchy_of(edges: DataFrame, label: str = "") -> Hierarchy:
    """The labels of edges (src, dst), which come from files, in the shared folder; built if they aren't there as a whole."""
    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/hierarchy-{mark(edges, label)}"
    fs, done = path_of(spark, f"{folder}/about/_SUCCESS")
    return Hierarchy(spark, folder) if fs.exists(done) else build(edges, folder)
