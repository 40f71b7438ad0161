"""Queries beyond the parity list, on the star schema and events; and the schema catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import schema as SC
from ledgerloom.tables import table


def schema_catalogue(spark, d):
    names = ("region", "nation", "customer", "orders", "lineitem", "documents")
    props = [(label, name, [kind]) for label, name, kind in SC.properties_of({n: table(spark, d, n) for n in names})]
    edges = [("HAS_PART", "region", "nation"), ("HAS_PART", "nation", "customer"), ("HAS_PART", "customer", "orders"), ("HAS_PART", "orders", "lineitem")]
    live = spark.createDataFrame(props, "label string, property string, types array<string>")
    out = SC.assemble(live, SC.adjacency(spark.createDataFrame([(r, a, b) for r, a, b in edges], "rel string, start_label string, end_label string")))
    return out.select("label", F.size("properties").cast("long").alias("n_properties"), F.array_join(F.map_keys("properties"), ",").alias("properties"), F.coalesce(F.array_join(F.transform("relationships", lambda r: F.concat(r["rel"], F.lit(":"), r["direction"], F.lit(":"), F.array_join(r["labels"], "+"))), ";"), F.lit("")).alias("relationships"))


CATALOGUE = """with t(label, edges) as (values ('region', 'HAS_PART:out:nation'), ('nation', 'HAS_PART:in:region;HAS_PART:out:customer'), ('customer', 'HAS_PART:in:nation;HAS_PART:out:orders'), ('orders', 'HAS_PART:in:customer;HAS_PART:out:lineitem'), ('lineitem', 'HAS_PART:in:orders'), ('documents', ''))
select t.label, count(*) as n_properties, string_agg(column_name, ',' order by column_name) as properties, edges as relationships from t join duckdb_columns() c on c.table_name = t.label where not c.internal group by t.label, edges"""


def tpch_pricing(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


PRICING = "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2"


def tpch_local_supplier(spark, d):
    """Revenue by nation where customer and supplier are of one nation; dimensions are broadcast by measured size."""
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


LOCAL = "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and s_nationkey = c_nationkey join nation on s_nationkey = n_nationkey group by n_name"


def topk_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey", F.col("rn").cast("long").alias("rn"))


TOPK = "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders qualify rn <= 3"


def grouping_sets(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


CUBE = "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)"


def window_frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events")
    return e.select("event_id", F.round(F.sum("value").over(w.rowsBetween(-4, 0)), 4).alias("moving"), F.lag("event_type").over(w).alias("before"))


FRAMES = "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row), 4) as moving, lag(event_type) over (partition by user_id order by ts, event_id) as before from events"


def asof_join(spark, d):
    """Each purchase with the user's last view at or before it: one sort by user instead of a range join."""
    e = table(spark, d, "events").where("event_type in ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts", F.desc("event_type"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = e.withColumn("view_ts", F.last(F.when(F.col("event_type") == "view", F.col("ts")), ignorenulls=True).over(w))
    return seen.where("event_type = 'purchase'").select("event_id", "user_id", "view_ts")


ASOF = "select p.event_id, p.user_id, v.ts as view_ts from (select * from events where event_type = 'purchase') p asof left join (select user_id, ts from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts"


def streaming_windows(spark, d):
    """The batch twin of streaming.events.windowed_counts."""
    e = table(spark, d, "events")
    return e.groupBy(F.window(F.col("ts"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


WINDOWS = "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"


QUERIES = {f.__name__: f for f in (schema_catalogue, tpch_pricing, tpch_local_supplier, topk_per_group, grouping_sets, window_frames, asof_join, streaming_windows)}
ORACLES = {"schema_catalogue": CATALOGUE, "tpch_pricing": PRICING, "tpch_local_supplier": LOCAL, "topk_per_group": TOPK, "grouping_sets": CUBE, "window_frames": FRAMES, "asof_join": ASOF, "streaming_windows": WINDOWS}
