"""Bookkeeping queries over conversations, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import app as A
from ledgerloom.operators import graph as G
from ledgerloom.operators import tables as TB
from ledgerloom.tables import table


def scope_union(spark, d):
    user = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("at"))
    conversation = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("at"))
    return A.effective_scope(user, conversation, "id", "at").select("id", "scope")


SCOPE = """with u as (select c_custkey as id from customer where c_nationkey < 5) select id, 'user' as scope from u
union all select distinct o_custkey, 'conversation' from orders where o_orderstatus = 'F' and o_custkey not in (select id from u)"""


def latest_per_user(spark, d):
    return TB.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


LATEST = "select user_id, event_id, event_type, round(value, 4) as value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"


def job_status_tally(spark, d):
    e = table(spark, d, "events")
    jobs = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("succeeded"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value") > 50).alias("active"), F.min("ts").alias("start_ts"), F.max("ts").alias("finish_ts"))
    return A.job_runs(jobs.withColumns({"start_ts": F.col("start_ts").cast("timestamp"), "finish_ts": F.col("finish_ts").cast("timestamp")})).select("user_id", "status", "seconds", "succeeded", "failed", "active")


JOBS = """select user_id, case when succeeded > 0 then 'succeeded' when failed > 0 then 'failed' when active > 0 then 'running' else 'pending' end as status,
 floor(epoch(date_trunc('second', b)) - epoch(date_trunc('second', a)))::BIGINT as seconds, succeeded, failed, active
from (select user_id, count(*) filter (where event_type = 'purchase') as succeeded, count(*) filter (where event_type = 'error') as failed, count(*) filter (where value > 50) as active, min(ts) as a, max(ts) as b from events group by user_id)"""


def dedupe_calls(spark, d):
    return A.dedupe_calls(table(spark, d, "events"), ["user_id"], "event_type", "props", "event_id").select("event_id", "user_id", "event_type")


DEDUPE = "select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type, props order by event_id) = 1"


def message_history(spark, d):
    return A.history(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "position", "text")


HISTORY = "select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as position, text from conversations where role not in ('tool', 'system')"


def conversation_counts(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last"))


COUNTS = "select conv_id, count(*) as n, count(*) filter (where role = 'user') as n_user, sum(length(text))::BIGINT as chars, max(turn) as last from conversations group by conv_id"


def fragment_fold(spark, d):
    return A.fold_fragments(table(spark, d, "conversations"), ["conv_id", "role"], "turn", "text")


FOLD = "select conv_id, role, string_agg(text, '' order by turn) as text, count(*) as n_fragments from conversations group by conv_id, role"


def median_mode(spark, d):
    e = table(spark, d, "events")
    typical = G.top_of_group(e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id"], [F.desc("n"), F.asc("event_type")])
    return e.groupBy("user_id").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median")).join(typical.where("n >= 2"), "user_id", "left").select("user_id", "median", F.col("event_type").alias("mode"), "n")


MEDIAN = """with m as (select user_id, round(quantile_cont(value, 0.5), 6) as median from events group by user_id),
c as (select user_id, event_type, count(*) as n from events group by user_id, event_type),
t as (select * from c qualify row_number() over (partition by user_id order by n desc, event_type) = 1)
select m.user_id, median, event_type as mode, n from m left join t on t.user_id = m.user_id and n >= 2"""


def sample_extrapolate(spark, d):
    o = table(spark, d, "orders")
    totals = o.agg(F.count("*").alias("total"), F.count_if((F.col("o_orderkey") % 10 == 0)).alias("sampled"), F.count_if((F.col("o_orderkey") % 10 == 0) & (F.col("o_orderstatus") == "F")).alias("hits"))
    return totals.select("total", "sampled", "hits", F.floor(F.col("hits") * F.col("total") / F.col("sampled")).cast("long").alias("estimate"))


EXTRAPOLATE = """with t as (select count(*) as total, count(*) filter (where o_orderkey % 10 = 0) as sampled, count(*) filter (where o_orderkey % 10 = 0 and o_orderstatus = 'F') as hits from orders)
select total, sampled, hits, floor(hits * total::DOUBLE / sampled)::BIGINT as estimate from t"""


QUERIES = {f.__name__: f for f in (scope_union, latest_per_user, job_status_tally, dedupe_calls, message_history, conversation_counts, fragment_fold, median_mode, sample_extrapolate)}
ORACLES = {"scope_union": SCOPE, "latest_per_user": LATEST, "job_status_tally": JOBS, "dedupe_calls": DEDUPE, "message_history": HISTORY, "conversation_counts": COUNTS, "fragment_fold": FOLD, "median_mode": MEDIAN, "sample_extrapolate": EXTRAPOLATE}
