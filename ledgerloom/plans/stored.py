"""Queries over tables that are written, changed by key and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.lineage import shared_dir
from ledgerloom.operators.keyed import Checkpoints, KeyedTable
from ledgerloom.plans.records import REPLACE, UPSERT
from ledgerloom.tables import table


def new_folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored_upsert(spark, d):
    """upsert_merge, written and read back."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    kept = KeyedTable.create(o.where("o_orderkey % 3 <> 0").withColumn("o_orderpriority", F.lit("OLD")), new_folder(spark, "orders"), ["o_orderkey"], 16)
    kept.upsert(o.where("o_orderkey % 3 <> 1").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("O"))))
    return kept.read()


def stored_children(spark, d):
    """replace_children, written and read back."""
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    kept = KeyedTable.create(old, new_folder(spark, "lines"), ["l_orderkey"], 16)
    kept.replace_children(old.where("l_orderkey % 5 = 0 and l_quantity > 25").withColumn("l_linenumber", F.col("l_linenumber") + 100))
    return kept.read().groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.max("l_linenumber").alias("last"))


def stored_checkpoints(spark, d):
    """Customers as collections: all begin, most are extracted, some fail, some begin again."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("collection"), F.col("c_name").alias("title"), F.col("c_custkey").alias("k"))
    states, at = Checkpoints.create(spark, new_folder(spark, "states")), lambda n: F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")
    states.begin(c.where("k % 7 > 0"), "r1", at(1))
    states.save(c.where("k % 3 = 0").select("collection", F.concat(F.lit("g"), "collection").alias("graph"), F.lit("s").alias("stats")), at(2))
    states.fail(c.where("k % 3 = 1").select("collection", F.repeat(F.lit("e"), (F.col("k") % 9000).cast("int")).alias("error")), at(3))
    states.begin(c.where("k % 10 = 1"), "r2", at(4))
    return states.table.read().select("collection", "title", "run_id", "status", "graph", "stats", F.length("error").cast("long").alias("n_error"), F.date_format("updated", "yyyy-MM-dd").alias("updated"))


CHECKPOINTS = """with c as (select c_custkey as k, c_custkey::VARCHAR as collection, c_name as title, c_custkey % 7 > 0 as first, c_custkey % 10 = 1 as again from customer where c_custkey % 7 > 0 or c_custkey % 10 = 1)
select collection, title, case when again then 'r2' else 'r1' end as run_id, case when again then 'extracting' when k % 3 = 0 then 'extracted' when k % 3 = 1 then 'failed' else 'extracting' end as status,
 case when not again and k % 3 = 0 then 'g' || collection end as graph, case when not again and k % 3 = 0 then 's' end as stats, case when not again and k % 3 = 1 then least(k % 9000, 4000) end as n_error,
 case when again then '2024-01-04' when k % 3 = 0 then '2024-01-02' when k % 3 = 1 then '2024-01-03' else '2024-01-01' end as updated from c"""

QUERIES = {f.__name__: f for f in (stored_upsert, stored_children, stored_checkpoints)}
ORACLES = {"stored_upsert": UPSERT, "stored_children": REPLACE, "stored_checkpoints": CHECKPOINTS}
