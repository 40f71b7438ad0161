"""Entity-resolution queries on part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.lineage import cut
from ledgerloom.operators import resolution as R
from ledgerloom.tables import table


def names(spark, d):
    """Distinct part names with the least part of each."""
    return table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))


def pairs(spark, d):
    return R.blocked_pairs(R.token_index(names(spark, d), "id", F.col("p_name")).withColumn("type", F.lit("agent")), "id", ["type"])


def pair_blocking(spark, d):
    return pairs(spark, d)


BLOCKING = """with n as (select p_name, min(p_partkey) as id from part group by p_name), t as (select distinct id, unnest(string_split(p_name, ' ')) as token from n),
s as (select token from t group by token having count(*) < 200), k as (select t.* from t join s using (token))
select distinct x.id as a, y.id as b from k x join k y on x.token = y.token and x.id < y.id"""


def entities(spark, d):
    e = names(spark, d).withColumn("names", F.array("p_name")).withColumn("tokens", F.array(T.name_tokens(F.col("p_name"))))
    return e.select("id", F.lit("agent").alias("type"), F.lit("person").alias("agent_type"), "names", "tokens", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("int").alias("year"), F.array().cast("array<string>").alias("neighbours"))


def pair_score(spark, d):
    return R.banded(R.scored_pairs(pairs(spark, d), entities(spark, d), "id").withColumn("type", F.lit("agent"))).select("a", "b", F.round("score", 6).alias("score"), "reason", "band")


def containment_match(spark, d):
    n = names(spark, d)
    small = R.token_index(n, "id", F.col("p_name"))
    large = R.token_index(n.withColumnRenamed("id", "other"), "other", F.concat_ws(" ", "p_name", F.lit("works")))
    return R.contained(small, large, "id", "other")


CONTAINED = """with n as (select p_name, min(p_partkey) as id from part group by p_name), s as (select distinct id, unnest(string_split(p_name, ' ')) as token from n),
l as (select distinct id as other, unnest(string_split(p_name || ' works', ' ')) as token from n), z as (select id, count(*) as n from s group by id having count(*) >= 2),
m as (select s.id, l.other, count(*) as c from s join l using (token) group by 1, 2)
select m.id, count(*) as n_matches, case when count(*) = 1 then min(other) end as other from m join z on z.id = m.id and z.n = m.c group by m.id"""


def cluster_components(spark, d):
    scored = cut(R.scored_pairs(pairs(spark, d), entities(spark, d), "id"), "scored")
    accepted = scored.where("score >= 0.35").withColumn("auto", F.col("score") >= 0.4)
    conflicts = scored.where("score < 0.35 and (a + b) % 7 = 0").select("a", "b")
    return R.clusters(accepted, R.pair_facts(conflicts))[0]


def merge_canonical(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("at"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("").alias("description"), F.array((F.col("p_partkey") % 7).cast("long")).alias("evidence"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") / 100).otherwise(0.0).alias("confidence"))
    out = R.merge_entities(rows, ["key"], "at", ["description"])
    return out.select("key", "name", "description", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"), F.round("confidence", 4).alias("confidence"), F.array_join("alternate_names", ";").alias("alternate_names"))


CANONICAL = """with r as (select p_brand as key, p_partkey as pos, p_name as name, case when p_size > 25 then p_type else '' end as description, p_partkey % 7 as evidence, case when p_size % 2 = 0 then p_size / 100.0 else 0 end as confidence from part),
g as (select key, arg_max(name, (length(name), -pos)) as name, arg_min(description, pos) filter (where description <> '') as description, string_agg(distinct evidence::VARCHAR, ',' order by evidence::VARCHAR) as evidence, round(max(coalesce(nullif(confidence, 0), 0.5)), 4)::DOUBLE as confidence from r group by key),
a as (select r.key, string_agg(distinct r.name, ';' order by r.name) as alternate_names from r join g on g.key = r.key and r.name <> g.name group by r.key)
select g.*, coalesce(alternate_names, '') as alternate_names from g left join a using (key)"""


QUERIES = {f.__name__: f for f in (pair_blocking, pair_score, containment_match, cluster_components, merge_canonical)}
ORACLES = {"pair_blocking": BLOCKING, "containment_match": CONTAINED, "merge_canonical": CANONICAL}
