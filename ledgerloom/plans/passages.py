"""Passage and chunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.lineage import cut
from ledgerloom.operators import passages as P
from ledgerloom.tables import table


def neighbour_range_join(spark, d):
    c = table(spark, d, "conversations")
    return P.neighbours(c, c.where("length(text) > 600"), "conv_id", "turn").select("conv_id", "turn", "role")


NEIGHBOURS = "select distinct a.conv_id, a.turn, a.role from conversations a join conversations b on a.conv_id = b.conv_id and a.turn between b.turn - 1 and b.turn + 1 where length(b.text) > 600"


def islands_passages(spark, d):
    c = table(spark, d, "conversations").where("length(text) % 3 <> 0")
    return P.passages(c, "conv_id", "turn", "text")


ISLANDS = """with r as (select *, turn - row_number() over (partition by conv_id order by turn) as run from conversations where length(text) % 3 <> 0)
select conv_id, min(turn) as first, count(*) as n, string_agg(text, E'\\n\\n' order by turn) as passage from r group by conv_id, run"""


def chunk_text(spark, d):
    return P.chunked(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "seq", F.length("chunk").cast("long").alias("n_chars"), F.sha2("chunk", 256).alias("digest"))


def chunk_pack(spark, d):
    return P.pack(table(spark, d, "conversations").withColumn("size", T.estimated_tokens(F.col("text")) + 20), "conv_id", "turn", "size", 500)


PACK = """with recursive s as (select conv_id, turn, length(text) // 4 + 1 + 20 as size from conversations),
w as (select conv_id, turn, 0::BIGINT as bin, size as used from s where turn = 0
 union all select s.conv_id, s.turn, case when used + size > 500 then bin + 1 else bin end, case when used + size > 500 then size else used + size end from w join s on s.conv_id = w.conv_id and s.turn = w.turn + 1)
select conv_id, turn, bin from w"""


def section_growth(spark, d):
    chunks = P.chunked(table(spark, d, "documents"), "doc_id", "text", 400, 80).withColumnRenamed("chunk", "text")
    score = F.round(F.pmod(F.xxhash64("text"), F.lit(1000)) / 1000, 3)
    ranked = chunks.withColumn("score", score).withColumn("kept", score > 0.9).withColumn("heading", F.lit(None).cast("string")).withColumn("rank", F.col("score"))
    return P.section_growth(cut(ranked, "chunks"), "doc_id")


QUERIES = {f.__name__: f for f in (neighbour_range_join, islands_passages, chunk_text, chunk_pack, section_growth)}
ORACLES = {"neighbour_range_join": NEIGHBOURS, "islands_passages": ISLANDS, "chunk_pack": PACK}
