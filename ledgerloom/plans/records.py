"""Queries on record fields: text, names, dates, cards, upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import records as R
from ledgerloom.functions import text as T
from ledgerloom.operators import industry as I
from ledgerloom.operators import tables as TB
from ledgerloom.tables import table


def strip_markup(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_markup(F.col("html")).alias("text"))


STRIP = "select page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g')) as text from pages"


def parse_source_uri(spark, d):
    """Addresses of pages in parts; their numbers as records of every kind, with label, type and staff address."""
    pages = table(spark, d, "pages")
    kinds = F.array(*map(F.lit, ("/repositories/2/resources/", "/repositories/2/archival_objects/", "/repositories/2/accessions/", "/repositories/2/digital_objects/", "/agents/people/", "/agents/corporate_entities/", "/odd/")))
    uri = F.concat(F.element_at(kinds, (F.col("page_id") % 7 + 1).cast("int")), F.col("page_id").cast("string"))
    host, number = F.regexp_extract("url", r"^https?://([^/]+)", 1), F.regexp_extract("url", r"/(\d+)$", 1)
    resource = F.when(F.col("page_id") % 2 == 0, F.lit("/repositories/2/resources/9"))
    return pages.withColumn("uri", uri).withColumn("resource", resource).select(
        "page_id", host.alias("host"), number.alias("number"), F.regexp_extract("url", r"/([^/]+)/[^/]*$", 1).alias("kind"), F.when(F.col("url").rlike("^https://"), "secure").otherwise("plain").alias("scheme"),
        R.record_label(F.col("uri")).alias("label"), R.agent_type(F.col("uri")).alias("agent"), R.public_url("http://b/", F.col("uri"), F.col("resource")).alias("address"),
    )


PARSE = r"""with p as (select *, ['resources', 'archival_objects', 'accessions', 'digital_objects', 'people', 'corporate_entities', 'odd'][page_id % 7 + 1] as k, page_id % 7 as m from pages)
select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_extract(url, '/(\d+)$', 1) as number, regexp_extract(url, '/([^/]+)/[^/]*$', 1) as kind,
 case when regexp_matches(url, '^https://') then 'secure' else 'plain' end as scheme, ['Collection', 'ArchivalObject', 'Accession', 'DigitalObject', 'Agent', 'Agent', null][m + 1] as label,
 case m when 4 then 'person' when 5 then 'corporate_entity' else '' end as agent,
 case when m = 0 then 'http://b/resources/' || page_id || '#tree::resource_' || page_id when m = 1 and page_id % 2 = 0 then 'http://b/resources/9#tree::archival_object_' || page_id when m in (2, 3) then 'http://b/' || k || '/' || page_id when m in (4, 5) then 'http://b/agents/' || k || '/' || page_id else '' end as address from p"""


def credit_extract(spark, d):
    said = F.concat(F.lit("Processed. By: "), F.regexp_replace("p_name", " ", " and "), F.lit("."))
    return table(spark, d, "part").select("p_partkey", F.explode(T.credits(said)).alias("name"))


CREDITS = r"""with c as (select p_partkey, regexp_extract('Processed. By: ' || regexp_replace(p_name, ' ', ' and ') || '.', '\b[Bb]y:\s*([^.;\n]{2,60})', 1) as found from part)
select distinct p_partkey, trim(x) as name from (select p_partkey, unnest(regexp_split_to_array(found, '\s+and\s+|\s*,\s*|\s*&\s*')) as x from c) where length(trim(x)) >= 2"""


def sanitise_type(spark, d):
    p = table(spark, d, "part")
    camel = F.concat(F.lower(F.substring_index("p_name", " ", 1)), F.initcap(F.substring_index("p_name", " ", -1)))
    relation = T.relation_type(F.col("p_type"))
    return p.select("p_partkey", relation.alias("relation"), T.relation_constant(camel).alias("constant"), T.humanised(F.concat(F.lit("RICO_"), relation)).alias("said"))


SANITISE = r"""with c as (select p_partkey, upper(regexp_replace(p_type, '[^a-zA-Z0-9]', '_', 'g')) as relation, lower(split_part(p_name, ' ', 1)) || upper(split_part(p_name, ' ', -1)[1]) || lower(split_part(p_name, ' ', -1)[2:]) as camel from part)
select p_partkey, relation, 'RICO_' || upper(regexp_replace(camel, '([a-z0-9])([A-Z])', '\1_\2', 'g')) as constant, lower(replace(relation, '_', ' ')) as said from c"""


def date_pivot(spark, d):
    """Each user's last value of each event type, pivoted as `date_<type>_expression`."""
    e = table(spark, d, "events")
    dates = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value"))), lambda x: F.struct(x["event_type"].alias("date_type"), F.round(x["value"], 2).cast("string").alias("expression"), F.lit("").alias("begin"), F.lit("").alias("end")))
    pivot = e.groupBy("user_id").agg(R.date_pivot(dates).alias("m"))
    return pivot.select("user_id", F.explode(F.map_filter("m", lambda k, v: k.endswith("_expression")))).select("user_id", "key", F.round(F.col("value").cast("double"), 2).alias("value"))


PIVOT = "select user_id, 'date_' || event_type || '_expression' as key, round(max_by(value, (ts, event_id)), 2) as value from events group by user_id, event_type"


def normalise_names(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.initcap("p_name"), F.lit(" & "), F.col("p_brand"), F.lit(" Co., "), F.when(F.col("p_size") % 4 == 0, F.lit("1850-1920")).when(F.col("p_size") % 4 == 2, F.lit("1850 - ")).otherwise(F.lit("Inc. and Company")))
    normal = T.normal_name(name)
    return p.select("p_partkey", normal.alias("normal"), T.core_name(normal).alias("core"), F.size(T.name_tokens(normal)).cast("long").alias("n_tokens"))


NAMES = r"""with a as (select p_partkey, lower(p_name || ' & ' || p_brand || ' Co., ' || case p_size % 4 when 0 then '1850-1920' when 2 then '1850 - ' else 'Inc. and Company' end) as x from part),
b as (select p_partkey, trim(regexp_replace(replace(regexp_replace(x, '[.,;:''"()\[\]]', ' ', 'g'), '&', ' and '), '\s+', ' ', 'g')) as y from a),
c as (select p_partkey, trim(regexp_replace(y, '\s*\b\d{4}\s*-\s*(\d{4})?$', '')) as n0 from b),
e as (select p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n0, '\bco\b', 'company', 'g'), '\bcorp\b', 'corporation', 'g'), '\binc\b', 'incorporated', 'g'), '\brail road\b', 'railroad', 'g'), '\brail-road\b', 'railroad', 'g') as normal from c)
select p_partkey, normal, array_to_string(list_filter(string_split(normal, ' '), lambda t: t not in ('company', 'corporation', 'incorporated')), ' ') as core,
 len(list_distinct(list_filter(string_split(normal, ' '), lambda t: t not in ('', 'the', 'of', 'and', '&')))) as n_tokens from e"""


def property_card(spark, d):
    s = table(spark, d, "supplier")
    props = F.create_map(*(x for c in sorted(s.columns) if c != "s_suppkey" for x in (F.lit(c), F.nullif(F.col(c).cast("string"), F.lit("0")))))
    return s.select("s_suppkey", R.property_card(F.map_filter(props, lambda k, v: ~k.isin("s_acctbal"))).alias("card"))


CARD = "select s_suppkey, concat_ws(chr(10), 's_name: ' || s_name, 's_nationkey: ' || nullif(s_nationkey::VARCHAR, '0')) as card from supplier"


def row_serialise(spark, d):
    p = table(spark, d, "part")
    props = F.create_map(*(x for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size") for x in (F.lit(c), F.nullif(F.col(c).cast("string"), F.lit("1")))))
    return p.select("p_partkey", R.serialised(props).alias("line"))


SERIALISE = "select p_partkey, concat_ws('; ', 'p_partkey: ' || nullif(p_partkey::VARCHAR, '1'), 'p_name: ' || p_name, 'p_brand: ' || p_brand, 'p_type: ' || p_type, 'p_size: ' || nullif(p_size::VARCHAR, '1')) as line from part"


def upsert_merge(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    old = o.where("o_orderkey % 3 <> 0").withColumn("o_orderpriority", F.lit("OLD"))
    new = o.where("o_orderkey % 3 <> 1").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("O")))
    return TB.upsert(old, new, ["o_orderkey"])


UPSERT = """with o as (select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders),
a as (select o_orderkey, o_orderstatus, o_totalprice, 'OLD' as o_orderpriority from o where o_orderkey % 3 <> 0),
b as (select o_orderkey, nullif(o_orderstatus, 'O') as o_orderstatus, o_totalprice, o_orderpriority from o where o_orderkey % 3 <> 1)
select coalesce(b.o_orderkey, a.o_orderkey) as o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) as o_orderstatus, coalesce(b.o_totalprice, a.o_totalprice) as o_totalprice, coalesce(b.o_orderpriority, a.o_orderpriority) as o_orderpriority
from a full join b on a.o_orderkey = b.o_orderkey"""


def replace_children(spark, d):
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = old.where("l_orderkey % 5 = 0 and l_quantity > 25").withColumn("l_linenumber", F.col("l_linenumber") + 100)
    out = TB.replace_children(old, new, "l_orderkey")
    return out.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.max("l_linenumber").alias("last"))


REPLACE = """with n as (select l_orderkey, l_linenumber + 100 as l_linenumber, l_quantity from lineitem where l_orderkey % 5 = 0 and l_quantity > 25),
u as (select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey not in (select l_orderkey from n) union all select * from n)
select l_orderkey, count(*) as n, sum(l_quantity) as quantity, max(l_linenumber) as last from u group by l_orderkey"""


def industry_hierarchy(spark, d):
    p = table(spark, d, "part")
    sizes = p.select(F.col("p_size").cast("string").alias("code")).unionByName(p.select(F.left(F.col("p_size").cast("string"), F.lit(1)).alias("code"))).distinct().where("code <> '7'")
    lookup = sizes.select("code", F.concat(F.lit("label "), "code").alias("label"))
    rows = p.select("p_partkey", F.concat(F.when(F.col("p_partkey") % 4 == 0, F.lit("ARCH ")).otherwise(F.lit("Mss: ")), F.col("p_size").cast("string"), F.lit(" a")).alias("id_0"))
    return I.with_industry(rows, "id_0", lookup).withColumn("prefix", R.collection_prefix(F.col("id_0")))


INDUSTRY = """with l as (select distinct code, 'label ' || code as label from (select p_size::VARCHAR as code from part union all select left(p_size::VARCHAR, 1) from part) where code <> '7'),
r as (select p_partkey, case when p_partkey % 4 = 0 then 'ARCH ' else 'Mss: ' end || p_size || ' a' as id_0, case when p_partkey % 4 <> 0 then p_size::VARCHAR end as c from part),
j as (select r.*, coalesce(o.label, 'Not Found') as own, coalesce(t.label, 'Not Found') as top, coalesce(s.label, 'None') as sec from r left join l o on o.code = c left join l t on t.code = left(c, 1) left join l s on s.code = left(c, 2))
select p_partkey, id_0, case when c is null then 'Arch' else 'Mss' end as prefix, coalesce(c, 'Not Applicable') as industry_code, case when c is null then 'Not Applicable' else own end as industry_label,
 case when c is null then 'Not Applicable' when length(c) = 1 then own when length(c) = 2 then top || '-' || own else top || '-' || sec || '-' || own end as industry_path,
 case when c is null then 'Not Applicable' else left(c, 1) end as industry_top_code, case when c is null then 'Not Applicable' else top end as industry_top,
 case when c is null then 'Not Applicable' when length(c) < 2 then 'None' else left(c, 2) end as industry_second_code, case when c is null then 'Not Applicable' when length(c) < 2 then 'None' else sec end as industry_second from j"""


def csv_export_cells(spark, d):
    return table(spark, d, "documents").select("doc_id", T.csv_cell(F.col("text")).alias("cell"), T.markdown_cell(F.col("text")).alias("markdown"), T.slug(F.col("text")).alias("stem"))


CSV = r"""with a as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as x, text as h from documents), b as (select doc_id, x, h, case when regexp_matches(x, '^[=+\-@]') then '''' || x else x end as y from a)
select doc_id, case when regexp_matches(y, '[",\n\r]') then '"' || replace(y, '"', '""') || '"' else y end as cell, replace(replace(replace(x, '|', '\|'), '[', '\['), ']', '\]') as markdown,
 coalesce(nullif(left(regexp_replace(regexp_replace(lower(h), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), ''), 'chart') as stem from b"""


def page_slice(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).alias("size"), "p_name")
    return TB.page(rows, [F.desc_nulls_last("size"), F.asc("p_partkey")], 3, 25)


PAGE = "select p_partkey, nullif(p_size, 1) as size, p_name from part order by size desc nulls last, p_partkey limit 25 offset 50"


def json_path(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").groupBy(k.cast("long").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


JSON_PATH = "select (props::JSON->>'$.k')::BIGINT as k, count(*) as n, round(sum(value), 2) as total from events group by 1"


def text_budget(spark, d):
    docs = table(spark, d, "documents")
    best = Window.partitionBy("source").orderBy(F.desc(F.length("text")), "doc_id")
    return docs.withColumn("rn", F.row_number().over(best)).where("rn <= 3").select("source", "doc_id", F.col("rn").cast("long").alias("rn"), T.within_budget(F.col("text"), 1500).alias("text"), F.left("text", F.lit(150)).alias("excerpt"))


BUDGET = """with r as (select *, row_number() over (partition by source order by length(text) desc, doc_id) as rn from documents)
select source, doc_id, rn, case when length(text) > 1500 then left(text, 1500) || '…' else text end as text, left(text, 150) as excerpt from r where rn <= 3"""


QUERIES = {f.__name__: f for f in (strip_markup, parse_source_uri, credit_extract, sanitise_type, date_pivot, normalise_names, property_card, row_serialise, upsert_merge, replace_children, industry_hierarchy, csv_export_cells, page_slice, json_path, text_budget)}
ORACLES = {"strip_markup": STRIP, "parse_source_uri": PARSE, "credit_extract": CREDITS, "sanitise_type": SANITISE, "date_pivot": PIVOT, "normalise_names": NAMES, "property_card": CARD, "row_serialise": SERIALISE, "upsert_merge": UPSERT, "replace_children": REPLACE, "industry_hierarchy": INDUSTRY, "csv_export_cells": CSV, "page_slice": PAGE, "json_path": JSON_PATH, "text_budget": BUDGET}
