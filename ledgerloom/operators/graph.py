"""Edges, hierarchies and neighbourhoods."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.lineage import cut


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges are a set of (src, rel, dst)."""
    return edges.dropDuplicates(["src", "rel", "dst"])


def link(edges: DataFrame, nodes: DataFrame, key: str = "uri") -> DataFrame:
    """Edges whose two ends exist."""
    known = nodes.select(F.col(key).alias("__k"))
    return distinct_edges(edges.join(known, F.col("src") == F.col("__k"), "left_semi").join(known, F.col("dst") == F.col("__k"), "left_semi"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair in both directions, once."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def closure(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """root, node and depth of everything below each root (depth 0: itself), or down to a depth.

    Level by level: edges are written once, a level joins them once, and the walk ends when a level
    is empty. A node that was reached from the same root before isn't followed again, so cycles end."""
    known = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    level, edges = known, cut(edges.select(F.col("src").alias("node"), "dst"), "edges")
    for k in itertools.count(1) if depth is None else range(1, depth + 1):
        down = level.join(edges, "node").select("root", F.col("dst").alias("node"), F.lit(k).alias("depth")).distinct()
        level = cut(down.join(known.select("root", "node"), ["root", "node"], "left_anti"), "level")
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known


def ancestors(parents: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """start, node and depth, upwards through (node, parent)."""
    return closure(parents.select(F.col("node").alias("src"), F.col("parent").alias("dst")).where("dst is not null"), starts, depth).withColumnRenamed("root", "start")


def may_move(parents: DataFrame, folder: str, target: str) -> bool:
    """Whether folder may come under target: not itself, nor anything below it."""
    spark = parents.sparkSession
    start = spark.range(1).select(F.lit(target).alias("node"))
    return folder != target and ancestors(parents, start).where(F.col("node") == folder).isEmpty()


def descendants_per_root(edges: DataFrame, roots: DataFrame) -> DataFrame:
    return closure(edges, roots).where("depth > 0").groupBy("root").agg(F.count("*").alias("n"))


def neighbour_sets(edges: DataFrame) -> DataFrame:
    """node and its sorted neighbours."""
    return undirected(edges).groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def with_inverse(edges: DataFrame, relations: DataFrame) -> DataFrame:
    """Each edge and its inverse by a table (rel, inverse); edges of unknown type keep their own both ways."""
    named = edges.join(relations, "rel", "left").withColumn("inverse", F.coalesce("inverse", "rel"))
    both = F.explode(F.array(F.struct("src", "rel", "dst"), F.struct(F.col("dst").alias("src"), F.col("inverse").alias("rel"), F.col("src").alias("dst"))))
    return named.select(both.alias("e"), *[c for c in edges.columns if c not in ("src", "rel", "dst")]).select("e.*", *[c for c in edges.columns if c not in ("src", "rel", "dst")])


def resolve_stubs(fetch, stubs: DataFrame, passes: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Breadth-first completion: fetch(stubs) gives (nodes with uri, linked uris); failures are what it doesn't return.

    Ends when no unknown uri is left, or after `passes`. Returns nodes, failed uris, and those still wanted."""
    nodes = failed = None
    wanted = stubs.select("uri").distinct()
    for _ in range(passes):
        if wanted.isEmpty():
            break
        found, linked = fetch(wanted)
        found, linked = cut(found, "found"), linked.select("uri").distinct()
        lost = cut(wanted.join(found.select("uri"), "uri", "left_anti"), "lost")
        nodes = found if nodes is None else nodes.unionByName(found)
        failed = lost if failed is None else failed.unionByName(lost)
        wanted = cut(linked.join(nodes.select("uri"), "uri", "left_anti").join(failed, "uri", "left_anti"), "wanted")
    return nodes, failed, wanted


def top_of_group(df: DataFrame, group: list[str], order: list, n: int = 1) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")
