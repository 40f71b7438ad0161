"""Queries of the inferred graph: validation, salvage, merging, resolution, twins; and retrieval as a whole."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import knowledge as K
from ledgerloom.operators import passages as P
from ledgerloom.operators import resolution as R
from ledgerloom.operators import search as S
from ledgerloom.operators import validation as V
from ledgerloom.plans.search import COSINE, QUERY_ID, TERMS, bm25_sql
from ledgerloom.tables import table


def graph(spark, d):
    """Entities of parts, relations of lines, and numbered units, with faults of every kind."""
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    size = F.col("p_size")
    entities = p.select(
        F.col("p_partkey").alias("n"), F.when(size % 11 == 0, "").when(size % 13 == 0, "p1").otherwise(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("id"), F.when(size % 7 == 0, " ").otherwise(F.col("p_name")).alias("name"),
        F.element_at(F.array(F.lit("agent"), F.lit("place"), F.lit("event"), F.lit("thing")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("type"), F.when(size % 3 > 0, "person").otherwise("robot").alias("agent_type"), F.array(size.cast("long"), (size + 1).cast("long")).alias("evidence"),
    )
    relations = li.groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").cast("long").alias("q")).select(
        (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("n"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("p"), (F.col("l_suppkey") * 7).cast("string")).alias("dst"),
        F.when(F.col("q") % 5 == 0, "likes").otherwise("knows").alias("type"), F.concat(F.lit('"UNIT  '), F.col("q").cast("string"), F.lit('"')).alias("quote"), F.array((F.col("q") + F.col("l_suppkey") % 2).cast("long")).alias("evidence"),
    )
    units = spark.range(1, 49).select(F.col("id").alias("i"), F.concat(F.lit("Here is unit "), F.col("id").cast("string"), F.lit(".")).alias("text"), F.concat(F.lit("/u/"), (F.col("id") % 9).cast("string")).alias("source_uri"))
    return entities, relations, units


GRAPH = """e as (select p_partkey as n, case when p_size % 11 = 0 then '' when p_size % 13 = 0 then 'p1' else 'p' || p_partkey end as id, case when p_size % 7 = 0 then ' ' else p_name end as name,
 ['agent', 'place', 'event', 'thing'][p_partkey % 4 + 1] as type, case when p_size % 3 > 0 then 'person' else 'robot' end as agent_type, p_size + 1 between 2 and 48 as cited from part),
e_err as (select n, unnest(list_filter([case when id = '' then 'no id' end, case when id <> '' and n > min(n) over (partition by id) then 'duplicate id' end, case when trim(name) = '' then 'no name' end, case when type = 'thing' then 'invalid type' end,
 case when type = 'agent' and agent_type = 'robot' then 'invalid agent_type' end, case when not cited then 'evidence' end], lambda x: x is not null)) as error from e),
l as (select l_partkey, l_suppkey, max(l_quantity)::BIGINT as q from lineitem group by all),
r as (select l_partkey * 100000 + l_suppkey as n, 'p' || l_partkey as src, 'p' || l_suppkey * 7 as dst, case when q % 5 = 0 then 'likes' else 'knows' end as type, q, q + l_suppkey % 2 as ev from l),
good as (select * from e where n not in (select n from e_err where error <> 'duplicate id'))"""
RELATION_ERRORS = """select n, unnest(list_filter([case when src not in (select id from {known}) or dst not in (select id from {known}) then 'unknown end' end, case when src = dst then 'relates to itself' end, case when type = 'likes' then 'type not in menu' end,
 case when ev not between 1 and 48 then 'evidence' end, case when ev between 1 and 48 and not contains('here is unit ' || ev || '.', 'unit ' || q) then 'quote not in evidence' end], lambda x: x is not null)) as error from r"""


def graph_errors(spark, d):
    entities, relations, units = graph(spark, d)
    of = lambda df, kind: df.select(F.lit(kind).alias("kind"), "n", "error")
    return of(V.entity_errors(entities, units), "entity").unionByName(of(V.relation_errors(relations, entities, units), "relation"))


ERRORS = f"with {GRAPH} select 'entity' as kind, n, error from e_err union all select 'relation', n, error from ({RELATION_ERRORS.format(known='e')})"


def graph_salvage(spark, d):
    entities, relations = V.salvage(*graph(spark, d))
    return entities.select(F.lit("entity").alias("kind"), "n").unionByName(relations.select(F.lit("relation").alias("kind"), "n"))


SALVAGE = f"with {GRAPH}, b as ({RELATION_ERRORS.format(known='good')}) select 'entity' as kind, n from good union all select 'relation', n from r where n not in (select n from b)"


def relations_merge(spark, d):
    """Relations of chunks between merged entities, with evidence, sources, confidence, quotes and dates."""
    li = table(spark, d, "lineitem")
    rows = li.select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("at"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("p"), (F.col("l_suppkey") * 3).cast("string")).alias("dst"), F.col("l_returnflag").alias("type"),
        F.array((F.col("l_quantity")).cast("long")).alias("evidence"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).otherwise(F.lit(0.0)).alias("confidence"), F.when(F.col("l_linenumber") > 2, F.concat(F.lit("q"), (F.col("l_quantity") % 3).cast("int").cast("string"))).otherwise("").alias("quote"),
        F.when(F.col("l_linenumber") == 3, F.col("l_linestatus")).otherwise("").alias("date"), F.lit("").alias("nature"),
    ).groupBy("at", "src", "dst", "type").agg(*(F.max(c).alias(c) for c in ("evidence", "confidence", "quote", "date", "nature")))
    ids = table(spark, d, "part").where("p_size % 9 > 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("local"), F.concat(F.lit("b"), F.col("p_brand")).alias("merged"))
    units = spark.range(1, 41).select(F.col("id").alias("i"), F.concat(F.lit("/u/"), (F.col("id") % 4).cast("string")).alias("source_uri"))
    out = R.with_sources(R.remap_relations(rows, ids, "at"), units, ["src", "dst", "type"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("src", "dst", "type", text("evidence").alias("evidence"), F.round("confidence", 4).alias("confidence"), text("quotes").alias("quotes"), "date", "nature", F.coalesce(text("source_uri"), F.lit("")).alias("sources"))


RELATIONS = """with l as (select ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey as pos, 'p' || l_partkey as src, 'p' || l_suppkey * 3 as dst, l_returnflag as type, l_linenumber, l_quantity::BIGINT as q, l_discount, l_linestatus from lineitem),
s as (select pos, src, dst, type, max(q) as q, max(case when l_linenumber % 2 = 0 then l_discount else 0 end) as confidence, max(case when l_linenumber > 2 then 'q' || q % 3 else '' end) as quote, max(case when l_linenumber = 3 then l_linestatus else '' end) as date from l group by all),
ids as (select 'p' || p_partkey as local, 'b' || p_brand as merged from part where p_size % 9 > 0),
m as (select s.*, a.merged as ms, b.merged as md from s join ids a on a.local = src join ids b on b.local = dst where a.merged <> b.merged),
u as (select i, '/u/' || i % 4 as uri from range(1, 41) r(i)),
f as (select ms, md, type, quote, min(pos) as pos from m where quote <> '' group by all),
qs as (select ms, md, type, array_to_string(list(quote order by pos)[:3], ',') as quotes from f group by all)
select ms as src, md as dst, m.type, string_agg(distinct q::VARCHAR, ',' order by lpad(q::VARCHAR, 3, '0'), q::VARCHAR) as evidence, round(max(coalesce(nullif(confidence, 0), 0.5)), 4) as confidence, coalesce(any_value(quotes), '') as quotes, arg_min(date, pos) filter (where date <> '') as date, null::VARCHAR as nature,
 coalesce(string_agg(distinct uri, ',' order by uri), '') as sources from m left join u on i = q left join qs using (ms, md, type) group by ms, md, m.type"""


def successions(spark, d):
    """Pairs of core names that a succession links, whatever their order."""
    n = table(spark, d, "nation")
    names = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lower("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(" company")).otherwise(F.lit(""))).alias("normal"))
    cores = names.select("id", T.core_name(F.col("normal")).alias("core"))
    relations = n.select(F.col("n_nationkey").alias("src"), F.pmod(F.col("n_nationkey") * 3 + 1, F.lit(25)).alias("dst"), F.when(F.col("n_nationkey") % 3 == 0, "hasSuccessor").when(F.col("n_nationkey") % 3 == 1, "isSuccessorOf").when(F.col("n_nationkey") % 2 == 0, "wasMergedInto").otherwise("knows").alias("type"))
    return R.succession_pairs(relations, cores)


SUCCESSIONS = "select distinct least(lower(a.n_name), lower(b.n_name)) as a, greatest(lower(a.n_name), lower(b.n_name)) as b from nation a join nation b on b.n_nationkey = (a.n_nationkey * 3 + 1) % 25 where a.n_nationkey % 3 < 2 and a.n_name <> b.n_name"


def twin_records(spark, d):
    """Entities with the one record of the same name, and what that record holds; several are ambiguous."""
    p = table(spark, d, "part")
    entities = p.groupBy("p_name").agg(F.min("p_partkey").alias("entity")).select("entity", F.col("p_name").alias("normal"))
    records = p.where("p_size > 30").select(F.concat(F.lit("/agents/people/"), F.col("p_partkey").cast("string")).alias("uri"), F.col("p_name").alias("normal"), F.col("p_brand").alias("display"))
    twins = R.exact_twins(entities, records.select("uri", "normal"), "entity", "uri")
    return twins.join(records.select("uri", "display"), "uri", "left").select("entity", "n_matches", "uri", "display")


TWINS = """with e as (select p_name, min(p_partkey) as entity from part group by p_name), r as (select '/agents/people/' || p_partkey as uri, p_name, p_brand from part where p_size > 30),
m as (select entity, count(distinct uri) as n_matches, case when count(distinct uri) = 1 then min(uri) end as uri from e join r using (p_name) group by entity) select entity, n_matches, m.uri, p_brand as display from m left join r on r.uri = m.uri"""


def agreeing_names(spark, d):
    """Candidates all of whose query's distinctive words they bear."""
    p = table(spark, d, "part")
    return p.where(K.names_agree(F.concat(F.lit("The "), F.substring_index("p_name", " ", 1), F.lit(" of "), F.substring_index("p_type", " ", 1)), F.array("p_name", "p_type"))).select("p_partkey")


AGREEING = "select p_partkey from part where list_has_all(string_split(lower(p_name || ' ' || p_type), ' '), [lower(split_part(p_name, ' ', 1)), lower(split_part(p_type, ' ', 1))])"


def neighbour_jaccard(spark, d):
    """How far suppliers sell the same parts."""
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("near"))
    chain = pairs.select(F.col("l_suppkey").alias("a"), F.col("near").alias("near_a")).join(pairs.select((F.col("l_suppkey") - 1).alias("a"), F.col("near").alias("near_b")), "a")
    return chain.select("a", F.round(R.neighbour_overlap(F.col("near_a"), F.col("near_b")), 6).alias("overlap"))


JACCARD = """with s as (select l_suppkey, list(distinct l_partkey) as near from lineitem group by l_suppkey)
select a.l_suppkey as a, round(len(list_intersect(a.near, b.near))::DOUBLE / len(list_distinct(list_concat(a.near, b.near))), 6) as overlap from s a join s b on b.l_suppkey = a.l_suppkey + 1"""


def resolution_stats(spark, d):
    """Statistics of a whole resolution of part names, with dates, neighbours and successions."""
    n = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.max("p_size").alias("size"))
    entities = n.select("id", F.lit("agent").alias("type"), F.lit("person").alias("agent_type"), F.array("p_name").alias("names"), F.array(T.name_tokens(F.col("p_name"))).alias("tokens"), (F.lit(1850) + F.col("size")).cast("int").alias("start"), F.when(F.col("size") % 2 == 0, F.lit(1860)).cast("int").alias("end"), F.lit(None).cast("int").alias("year"), F.array(F.substring_index("p_name", " ", 1)).alias("neighbours"))
    relations = n.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("hasSuccessor").alias("type"))
    judge = lambda pairs: pairs.select("a", "b", F.lit(True).alias("same_entity"), F.col("score").alias("confidence"), "reason")
    return R.resolve(entities, relations, judge=judge)[1]


CONTEXT_CHARS = 6000


def document_retrieval(spark, d):
    """Retrieval as a whole: two lists, gate, fusion, junk, neighbours, judge, passages in order, numbered within a budget."""
    chunks = table(spark, d, "conversations")
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "conv_id")
    near = S.top(S.cosines(vectors, "conv_id", S.vector_of(vectors, "conv_id", QUERY_ID)), "conv_id", 60).where("score >= 0.05")
    words = S.bm25(chunks.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text")), "conv_id", "text", TERMS)
    fused = S.gate(near, words, "conv_id", 0.05, 0.5, rescue=10, cap=40)
    ranked = fused.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("fused", 8)), "conv_id")))  # 40 rows at most
    hits = K.junk_free(chunks.where("role = 'assistant'")).join(ranked.select("conv_id", "rank"), "conv_id").select("conv_id", "turn", "rank")
    grown = P.neighbours(chunks, hits, "conv_id", "turn")
    kept = grown.join(hits.select("conv_id", "turn", F.lit(True).alias("hit")), ["conv_id", "turn"], "left").where(F.col("hit") | ~T.is_junk(F.col("text")))
    judged = K.relevant("topic", kept.select("conv_id", "turn", "role", "text"), lambda question, texts: [len(t) % 10 > 0 for t in texts])
    told = P.passages(judged, "conv_id", "turn", "text").join(ranked.select("conv_id", "rank"), "conv_id")
    order = Window.orderBy("rank", "conv_id", "first")  # runs of 40 records at most
    numbered = told.withColumn("number", F.row_number().over(order).cast("long")).withColumn("upto", F.sum(F.length("passage")).over(order))
    return numbered.where(F.col("upto") <= CONTEXT_CHARS).select("number", "conv_id", "first", "n", F.concat(F.lit("[Passage "), F.col("number").cast("string"), F.lit("]\n"), F.col("passage")).alias("block"))


RETRIEVAL = rf"""with near as (select * from (select vec_id as doc_id, round({COSINE.format(q=QUERY_ID)}, 6) as score from embeddings order by score desc, doc_id limit 60) where score >= 0.05),
joined as (select conv_id as doc_id, string_agg(text, ' ' order by text) as text from conversations group by conv_id),
lex as (select * from ({bm25_sql(TERMS, 10).replace('from documents)', 'from joined)')}) where score >= 0.5),
r as (select doc_id, 1.0::DOUBLE / (60 + row_number() over (order by score desc, doc_id)) as r from near union all select doc_id, 1.0::DOUBLE / (60 + row_number() over (order by score desc, doc_id)) from lex),
f as (select doc_id as conv_id, row_number() over (order by round(sum(r), 8) desc, doc_id) as rank from r group by doc_id order by rank limit 40),
j as (select conv_id, turn, role, text, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') as toks from conversations),
k as (select conv_id, turn, role, text, (length(trim(text)) < 30 or (len(regexp_extract_all(text, '<td>')) + len(regexp_extract_all(text, '</tr>'))) >= 3 or contains(lower(text), '©') or contains(lower(text), 'all rights reserved')
 or contains(lower(text), 'isbn') or len(regexp_extract_all(text, '[\p{{L}}\s]')) < 0.55 * length(text) or (len(toks) >= 12 and len(list_filter(toks, lambda t: length(t) = 1)) > 0.3 * len(toks))) as junk from j),
hits as (select conv_id, turn from k join f using (conv_id) where not junk and role = 'assistant'),
g as (select distinct k.conv_id, k.turn, k.text from k join hits h on h.conv_id = k.conv_id and k.turn between h.turn - 1 and h.turn + 1 where (not junk or exists (select 1 from hits x where x.conv_id = k.conv_id and x.turn = k.turn)) and length(text) % 10 > 0),
w as (select *, turn - row_number() over (partition by conv_id order by turn) as run from g),
p as (select conv_id, min(turn) as first, count(*) as n, string_agg(text, E'\n\n' order by turn) as passage from w group by conv_id, run),
z as (select *, row_number() over (order by rank, conv_id, first) as number, sum(length(passage)) over (order by rank, conv_id, first) as upto from p join f using (conv_id))
select number, conv_id, first, n, '[Passage ' || number || ']' || chr(10) || passage as block from z where upto <= {CONTEXT_CHARS}"""


NAMES = (graph_errors, graph_salvage, relations_merge, successions, twin_records, agreeing_names, neighbour_jaccard, resolution_stats, document_retrieval)
QUERIES = {f.__name__: f for f in NAMES}
ORACLES = {"graph_errors": ERRORS, "graph_salvage": SALVAGE, "relations_merge": RELATIONS, "successions": SUCCESSIONS, "twin_records": TWINS, "agreeing_names": AGREEING, "neighbour_jaccard": JACCARD, "document_retrieval": RETRIEVAL}
