"""Joins, hierarchies and neighbourhoods over the star schema.

region > nation > customer > order > line stands for the containment tree of collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import graph as G
from ledgerloom.operators.intervals import hierarchy_of
from ledgerloom.tables import table


def key(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def tree(spark, d, lines=False):
    """(src, dst) edges of the containment tree."""
    t = lambda n: table(spark, d, n)
    parts = [
        t("nation").select(key("R", "n_regionkey").alias("src"), key("N", "n_nationkey").alias("dst")),
        t("customer").select(key("N", "c_nationkey").alias("src"), key("C", "c_custkey").alias("dst")),
        t("orders").select(key("C", "o_custkey").alias("src"), key("O", "o_orderkey").alias("dst")),
    ]
    if lines:
        parts.append(t("lineitem").select(key("O", "l_orderkey").alias("src"), F.concat(F.lit("L"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("dst")).distinct())
    return G.union_all(parts)


def whole_tree(spark, d):
    """Labelled by the first query that asks for it."""
    return hierarchy_of(tree(spark, d, lines=True), "lines")


def closure_paths(spark, d):
    roots = table(spark, d, "region").select(key("R", "r_regionkey").alias("node"))
    return whole_tree(spark, d).descendants(roots).groupBy("root", "depth").agg(F.count("*").alias("n"), F.min("node").alias("first"))


TREE = """edges as (select 'R' || n_regionkey as src, 'N' || n_nationkey as dst from nation
 union all select 'N' || c_nationkey, 'C' || c_custkey from customer
 union all select 'C' || o_custkey, 'O' || o_orderkey from orders{lines})"""
LINES = " union all select distinct 'O' || l_orderkey, 'L' || l_orderkey || '.' || l_linenumber from lineitem"
CLOSURE = f"""with recursive {TREE.format(lines=LINES)}, walk as (select 'R' || r_regionkey as root, 'R' || r_regionkey as node, 0 as depth from region
 union all select root, dst, depth + 1 from walk join edges on src = node)
select root, depth, count(*) as n, min(node) as first from walk group by root, depth"""


def ancestor_walk(spark, d):
    starts = table(spark, d, "orders").select(key("O", "o_orderkey").alias("node"))
    return whole_tree(spark, d).ancestors(starts).select("start", "node", "depth")


ANCESTORS = f"""with recursive {TREE.format(lines='')}, walk as (select 'O' || o_orderkey as start, 'O' || o_orderkey as node, 0 as depth from orders
 union all select start, src, depth + 1 from walk join edges on dst = node) select start, node, depth from walk"""


def descendants_per_root(spark, d):
    roots = table(spark, d, "region").select(key("R", "r_regionkey").alias("node"))
    sizes = whole_tree(spark, d).labels.join(roots, "node").select(F.col("node").alias("root"), (F.col("size") - 1).alias("n"))
    return sizes.orderBy(F.desc("n"), "root").limit(1)


DESCENDANTS = f"""with recursive {TREE.format(lines=LINES)}, walk as (select 'R' || r_regionkey as root, 'R' || r_regionkey as node, 0 as depth from region
 union all select root, dst, depth + 1 from walk join edges on src = node)
select root, count(*) as n from walk where depth > 0 group by root order by n desc, root limit 1"""


def left_join_count(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"))


LEFT_COUNT = "select o_orderkey, count(l_orderkey) as n_lines from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey"


def filtered_array_agg(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    wanted = F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))
    return joined.groupBy("c_custkey").agg(F.array_join(F.transform(F.sort_array(wanted), lambda x: x.cast("string")), ",").alias("filled"))


FILTERED = "select c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' order by o_orderkey) filter (where o_orderstatus = 'F'), '') as filled from customer left join orders on c_custkey = o_custkey group by c_custkey"


def semi_anti(spark, d):
    orders = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    some = orders.join(lines, "o_orderkey", "left_semi").select("o_orderkey", F.lit("semi").alias("side"))
    none = orders.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey", F.lit("anti").alias("side"))
    return some.unionByName(none)


SEMI = """select o_orderkey, 'semi' as side from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 40)
union all select o_orderkey, 'anti' from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)"""


def null_safe_ci(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.nullif(F.col("n_regionkey"), F.lit(0)).alias("parent"))
    a, b = n.alias("a"), n.alias("b")
    same = F.col("a.parent").eqNullSafe(F.col("b.parent")) & (F.lower(F.left("a.n_name", F.lit(1))) == F.lower(F.left("b.n_name", F.lit(1)))) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, same).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), F.col("a.parent").alias("parent"))


NULL_SAFE = """with n as (select n_nationkey, n_name, nullif(n_regionkey, 0) as parent from nation)
select a.n_nationkey as a, b.n_nationkey as b, a.parent from n a join n b on a.parent is not distinct from b.parent and lower(left(a.n_name, 1)) = lower(left(b.n_name, 1)) and a.n_nationkey < b.n_nationkey"""


def undirected_neighbours(spark, d):
    edges = table(spark, d, "lineitem").select(key("S", "l_suppkey").alias("src"), key("P", "l_partkey").alias("dst"))
    return G.neighbour_sets(edges).select("node", F.size("neighbours").cast("long").alias("n"), F.element_at("neighbours", 1).alias("first"))


UNDIRECTED = """with e as (select 'S' || l_suppkey as src, 'P' || l_partkey as dst from lineitem), u as (select src, dst from e union select dst, src from e)
select src as node, count(distinct dst) as n, min(dst) as first from u group by src"""


QUERIES = {f.__name__: f for f in (closure_paths, ancestor_walk, descendants_per_root, left_join_count, filtered_array_agg, semi_anti, null_safe_ci, undirected_neighbours)}
ORACLES = {"closure_paths": CLOSURE, "ancestor_walk": ANCESTORS, "descendants_per_root": DESCENDANTS, "left_join_count": LEFT_COUNT, "filtered_array_agg": FILTERED, "semi_anti": SEMI, "null_safe_ci": NULL_SAFE, "undirected_neighbours": UNDIRECTED}
