"""Connected components by alternating large-star and small-star steps, on DataFrames alone.

Each step is a grouped minimum, which combines before its shuffle, and a join with it. Nodes of high
degree, HOT_NODES at most, meet their neighbours by a broadcast, so no key of the shuffled join has
more rows than the degree that sets them apart. Edges are written between rounds, so lineage stays
short and a lost executor costs one round. Nothing but a checksum of the edges reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.lineage import cut

#: Degree from which a node may be hot, and a bound on hot nodes: degrees add up to twice the edges.
HOT_DEGREE, HOT_NODES = 1000, 50_000


def with_least(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """rows (u, v) with m of u. least: u, m and degree n, of which no more than 2 * n_edges are counted."""
    limit = max(HOT_DEGREE, 2 * n_edges // HOT_NODES)
    hot, rest = least.where(F.col("n") > limit).select("u", "m"), least.where(F.col("n") <= limit).select("u", "m")
    marked = rows.join(F.broadcast(hot), "u", "left")
    others = marked.where("m is null").drop("m").join(rest.hint("merge"), "u")
    return marked.where("m is not null").select("u", "v", "m").unionByName(others.select("u", "v", "m"))


def large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return with_least(both, least, n_edges).where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = with_least(down, least, n_edges).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node reachable) of every node that has an edge.

    edges: columns a and b of one orderable type, in either direction, without nulls."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(edges)
    for _ in range(rounds):
        # a larger neighbour of one node is one of another's, so large stars are no more than edges
        edges = cut(small_star(large_star(edges, before[0]), before[0]), "edges", instead_of=edges)
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components haven't settled in {rounds} rounds")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
