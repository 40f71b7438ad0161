"""Queries of an application's desk: search boxes, titles, histories, prompts, tool calls, wipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import app as A
from ledgerloom.operators import graph as G
from ledgerloom.operators import tables as TB
from ledgerloom.operators import validation as V
from ledgerloom.plans.graph import TREE, key, tree
from ledgerloom.tables import table


def substring_filter(spark, d):
    return A.substring_filter(table(spark, d, "part"), " ST", ["p_name", "p_brand", "p_type"]).select("p_partkey")


SUBSTRING = "select p_partkey from part where contains(lower(p_name), 'st') or contains(lower(p_brand), 'st') or contains(lower(p_type), 'st')"


def title_order(spark, d):
    """Customers as conversations: a title for most, in order of title."""
    titled = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise(F.lit(" ")).alias("title"))
    ranked = A.by_title(titled, "title", "c_custkey").select("c_custkey", "shown")
    return ranked.withColumn("position", F.row_number().over(A.Window.partitionBy("shown").orderBy(F.lower("shown"), "c_custkey")).cast("long"))


TITLES = """with t as (select c_custkey, case when c_custkey % 3 > 0 then c_mktsegment else 'Untitled chat' end as shown from customer)
select c_custkey, shown, row_number() over (partition by shown order by c_custkey) as position from t"""


def job_history(spark, d):
    """The newest jobs; those that haven't begun come last."""
    jobs = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("ts")).alias("started")).where("event_id % 5 = 0 or event_type = 'purchase'")
    return A.job_history(jobs, "started", "event_id").limit(50).select("event_id", "started")


JOB_HISTORY = "select event_id, case when event_id % 5 > 0 then ts end as started from events where event_id % 5 = 0 or event_type = 'purchase' order by started desc nulls last, event_id limit 50"


def left_join_on(spark, d):
    """Every customer, with the number of orders of one status: the status stands in the join's condition."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    joined = c.join(o, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderstatus") == "F"), "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_totalprice").alias("largest"))


LEFT_ON = "select c_custkey, count(o_orderkey) as n, max(o_totalprice) as largest from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F' group by c_custkey"


def prompt_tags(spark, d):
    """Prompts (parts) with their tags (words of the name), by a link table."""
    p = table(spark, d, "part")
    links = p.select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    tags = links.select("word").distinct().withColumn("tag", F.upper("word"))
    return links.join(tags, "word").where("p_partkey % 2 = 0 or length(tag) > 4").select("p_partkey", "tag")


TAGS = "select distinct p_partkey, upper(word) as tag from (select p_partkey, unnest(string_split(p_name, ' ')) as word from part) where p_partkey % 2 = 0 or length(word) > 4"


def used_relations(spark, d):
    """Relation types in use that a menu knows: an intersection of sets."""
    used = table(spark, d, "part").select(T.relation_type(F.col("p_type")).alias("rel")).distinct()
    return used.intersect(table(spark, d, "part").where("p_size > 25").select(T.relation_type(F.col("p_type")).alias("rel")))


USED = "select upper(regexp_replace(p_type, '[^a-zA-Z0-9]', '_', 'g')) as rel from part intersect select upper(regexp_replace(p_type, '[^a-zA-Z0-9]', '_', 'g')) from part where p_size > 25"


def cleaned_queries(spark, d):
    """Queries written over several lines, each on one and without limits."""
    said = F.concat(F.lit("MATCH (n)\nWHERE n.k = "), F.col("event_id").cast("string"), F.lit("\\nRETURN n  LIMIT "), F.col("user_id").cast("string"), F.lit("\nunion match (m) return m limit $cap\t"))
    return table(spark, d, "events").select("event_id", A.cleaned_query(said).alias("query"))


CLEANED = "select event_id, 'MATCH (n) WHERE n.k = ' || event_id || ' RETURN n union match (m) return m' as query from events where true"


def tool_calls(spark, d):
    """The first fault of each call, by a specification of tools and arguments."""
    spec = spark.createDataFrame([("view", "k", "int", True), ("purchase", "k", "int", True), ("purchase", "price", "float", True), ("click", "q", "str", False), ("error", "k", "bool", True)], "tool string, argument string, type string, required boolean")
    return V.call_errors(table(spark, d, "events").select(F.col("event_id").alias("call"), F.col("event_type").alias("tool"), F.col("props").alias("arguments")), spec).select("call", "tool", "error")


CALLS = """select event_id as call, event_type as tool, case event_type when 'purchase' then 'missing price' when 'click' then 'unexpected k' when 'error' then 'wrong type of k' else 'unknown tool' end as error
from events where event_type <> 'view'"""


def wiped(spark, d):
    """What a wipe of everything but nations and customers leaves of the containment tree."""
    edges = tree(spark, d)
    nodes = edges.select(F.col("dst").alias("uri")).unionByName(edges.select(F.col("src").alias("uri"))).distinct()
    left, between = TB.wipe(nodes, edges, F.left("uri", F.lit(1)).isin("N", "C"))
    return left.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n").unionByName(between.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n"))


WIPED = f"""with {TREE.format(lines='')}, n as (select dst as uri from edges union select src from edges), k as (select uri from n where left(uri, 1) in ('N', 'C'))
select 'nodes' as what, count(*) as n from k union all select 'edges', count(*) from edges where src in (select uri from k) and dst in (select uri from k)"""


def vector_write_back(spark, d):
    """Documents with new vectors where there are any, and their old ones elsewhere."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array(F.lit(1.0)).alias("embedding"))
    new = table(spark, d, "embeddings").where("label < 5").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = TB.write_vectors(docs, new, "id")
    return out.select("id", F.size("embedding").cast("long").alias("n"), F.round(F.element_at("embedding", 1), 5).alias("first"))


WRITTEN = "select doc_id as id, case when vec_id is null then 1 else len(embedding) end as n, round(case when vec_id is null then 1.0 else embedding[1]::DOUBLE end, 5) as first from documents left join embeddings on vec_id = doc_id and label < 5"


def checked_edges(spark, d):
    """Edges whose ends exist: lines to parts and suppliers that are listed."""
    t = lambda n: table(spark, d, n)
    nodes = t("part").where("p_size > 10").select(key("P", "p_partkey").alias("uri")).unionByName(t("supplier").select(key("S", "s_suppkey").alias("uri")))
    edges = t("lineitem").select(key("S", "l_suppkey").alias("src"), F.lit("OFFERS").alias("rel"), key("P", "l_partkey").alias("dst"))
    return G.link(edges, nodes).select("src", "dst")


CHECKED = "select distinct 'S' || l_suppkey as src, 'P' || l_partkey as dst from lineitem where l_partkey in (select p_partkey from part where p_size > 10) and l_suppkey in (select s_suppkey from supplier)"


def deleted_lines(spark, d):
    """Lines that are left once those of some orders are deleted by a join."""
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return TB.delete_using(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), gone, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


DELETED = "select l_orderkey, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by l_orderkey"


def upsert_returning(spark, d):
    """The rows that an upsert touches, as they are afterwards."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = o.where("o_orderkey % 7 = 0").withColumn("o_orderpriority", F.lit(None).cast("string")).withColumn("o_orderstatus", F.lit("Z"))
    return TB.returned(o.where("o_orderkey % 2 = 0"), new, ["o_orderkey"])


RETURNING = "select o_orderkey, 'Z' as o_orderstatus, case when o_orderkey % 2 = 0 then o_orderpriority end as o_orderpriority from orders where o_orderkey % 7 = 0"


def best_chunk(spark, d):
    """The best chunk of each record: an arg-max over (score, position); and the least parent instead of any."""
    e = table(spark, d, "events")
    best = F.max_by(F.struct("event_id", "event_type"), F.struct("value", -F.col("event_id")))
    return e.groupBy("user_id").agg(best.alias("b"), F.min("event_type").alias("parent")).select("user_id", "b.event_id", "b.event_type", "parent")


BEST = "select user_id, arg_max(event_id, (value, -event_id)) as event_id, arg_max(event_type, (value, -event_id)) as event_type, min(event_type) as parent from events group by user_id"


def rehydrate(spark, d):
    """User turns of aligned conversations, with the passages that were retrieved for them in front."""
    c = table(spark, d, "conversations").where("role <> 'system'")
    messages = c.select(F.col("conv_id").alias("conv"), F.concat_ws(".", "conv_id", "turn").alias("id"), "role", "text")
    refs = c.where("turn % 2 = 0").select(F.concat_ws(".", "conv_id", "turn").alias("id"), F.explode(F.array(F.struct(F.lit(1).alias("at"), (F.col("turn") % 5).alias("chunk")), F.struct(F.lit(0).alias("at"), (F.col("conv_id") % 7).alias("chunk")))).alias("r")).select("id", "r.*")
    chunks = table(spark, d, "benchmark").where("item_id < 6").select(F.col("item_id").alias("chunk"), F.col("text").alias("passage"))
    given = c.groupBy("conv_id").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("conv"), (F.col("n") + F.when(F.col("conv_id") % 4 == 0, 1).otherwise(0)).alias("n"))
    return A.rehydrated(messages, refs, chunks, given).select("id", "text")


REHYDRATED = """with c as (select *, conv_id || '.' || turn as id from conversations where role <> 'system'),
r as (select id, 1 as pos, turn % 5 as chunk from c where turn % 2 = 0 union all select id, 0, conv_id % 7 from c where turn % 2 = 0),
t as (select id, string_agg(b.text, E'\\n\\n' order by pos) as context from r join benchmark b on b.item_id = r.chunk and b.item_id < 6 group by id)
select c.id, case when conv_id % 4 > 0 and role = 'user' and context is not null then context || E'\\n\\n' || text else text end as text from c left join t using (id)"""


def visible_collections(spark, d):
    """Shared collections, and a user's own."""
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("shared"), F.col("c_nationkey").alias("owner"))
    return A.visible(rows, F.lit(3)).select("c_custkey")


VISIBLE = "select c_custkey from customer where c_acctbal < 0 or c_nationkey = 3"


def pending_work(spark, d):
    """Customers that an incremental run still has to do: what failed is tried again."""
    states = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.when(F.max("o_orderstatus") == "P", "failed").otherwise("done").alias("status"))
    return A.pending_collections(table(spark, d, "customer").select("c_custkey"), states, "c_custkey")


PENDING = "select c_custkey from customer where c_custkey not in (select o_custkey from orders group by o_custkey having max(o_orderstatus) <> 'P')"


def lost_jobs(spark, d):
    """Jobs whose worker is gone beyond a grace period have failed."""
    e = table(spark, d, "events")
    jobs = e.select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"), F.col("ts").cast("timestamp").alias("create_ts"))
    workers = e.where("event_id % 3 < 2").select(F.col("event_id").alias("job_id"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("active").alias("verdict"))
    return A.reconcile_jobs(jobs, workers, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("job_id", "status")


LOST = """select event_id as job_id, case when event_type <> 'view' then 'done' when event_id % 3 = 0 then 'failed' when event_id % 3 = 2 and epoch(timestamp '2024-01-15') - epoch(date_trunc('second', ts)) > 60 then 'failed' else 'running' end as status from events"""


def answer_forms(spark, d):
    """Answers of a model: tool names, passage chips, JSON, years, context shares."""
    e = table(spark, d, "events")
    said = F.concat(F.lit("<think>{x}</think> ```json\n"), "props", F.lit("\n``` see [Passage "), F.col("event_id").cast("string"), F.lit("]"))
    return e.select("event_id", T.tool_name(F.concat(F.lit("functions."), F.upper("event_type"), F.lit("_Run it"))).alias("tool"), T.json_object(said).alias("object"), T.passage_chips(F.concat(F.lit("[Passage "), F.col("user_id").cast("string"), F.lit("]"))).alias("chips"), T.year_of(F.concat(F.lit("circa "), F.col("ts").cast("string"))).cast("long").alias("year"), A.context_percent(F.col("event_id"), 7000).alias("share"))


FORMS = """select event_id, event_type || '-run-it' as tool, props as object, '<span class="chip" data-passage="' || user_id || '">' || user_id || '</span>' as chips, extract(year from ts) as year, round(event_id / 7000::DOUBLE * 100, 1) as share from events"""


NAMES = (substring_filter, title_order, job_history, left_join_on, prompt_tags, used_relations, cleaned_queries, tool_calls, wiped, vector_write_back, checked_edges, deleted_lines, upsert_returning, best_chunk, rehydrate, visible_collections, pending_work, lost_jobs, answer_forms)
QUERIES = {f.__name__: f for f in NAMES}
ORACLES = dict(zip(QUERIES, (SUBSTRING, TITLES, JOB_HISTORY, LEFT_ON, TAGS, USED, CLEANED, CALLS, WIPED, WRITTEN, CHECKED, DELETED, RETURNING, BEST, REHYDRATED, VISIBLE, PENDING, LOST, FORMS), strict=True))
