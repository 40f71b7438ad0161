"""Search queries over documents and embeddings, with the SQL that states them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions import vectors as V
from ledgerloom.lineage import cut
from ledgerloom.operators import inverted as I
from ledgerloom.operators import search as S
from ledgerloom.tables import table

TERMS = ["the", "with", "und", "que"]
TOPIC = "with the"
QUERY_ID, OTHER_ID = 0, 7


def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return S.top(S.cosines(e, "vec_id", S.vector_of(e, "vec_id", QUERY_ID)), "vec_id", 20).select("vec_id", "score")


COSINE = "list_dot_product(embedding::DOUBLE[], (select embedding::DOUBLE[] from embeddings where vec_id = {q})) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt((select list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) from embeddings where vec_id = {q})))"
VECTOR_TOPK = f"select vec_id, round({COSINE.format(q=QUERY_ID)}, 6) as score from embeddings order by score desc, vec_id limit 20"


def bm25_sql(terms, limit):
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) as tf_{k}" for k, w in enumerate(terms))
    df = ", ".join(f"count(*) filter (where tf_{k} > 0) as df_{k}" for k in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df_{k} + 0.5) / (df_{k} + 0.5)) * tf_{k} * 2.2 / (tf_{k} + 1.2 * (0.25 + 0.75 * length / mean))" for k in range(len(terms)))
    return f"""with toks as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') as t from documents),
counted as (select doc_id, len(t) as length, {tf} from toks),
stats as (select count(*)::DOUBLE as n, avg(length) as mean, {df} from counted)
select doc_id, round({score}, 6) as score from counted, stats where {' or '.join(f'tf_{k} > 0' for k in range(len(terms)))} order by score desc, doc_id limit {limit}"""


def documents_index(spark, d):
    """Built by the first query that asks for it."""
    return I.index_of(table(spark, d, "documents"), "doc_id", "text")


def linked_index(spark, d):
    """The index of the documents that have a vector, sorted because a join gives no order."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return I.index_of(table(spark, d, "documents").join(vectors, "doc_id", "left_semi").sortWithinPartitions("doc_id"), "doc_id", "text", "linked")


PLAIN = dict.fromkeys(TERMS, 1.0)


def lexical_bm25(spark, d):
    return I.best(documents_index(spark, d), PLAIN, 50).select("doc_id", "score")


FUZZY = "erther wither"


def lexical_fuzzy(spark, d):
    """Words, terms within their edits, and the boosted phrase."""
    return S.top(I.lexical(documents_index(spark, d), FUZZY), "doc_id", 50).select("doc_id", "score")


FUZZY_SQL = r"""with docs as (select doc_id, lower(text) as low, list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '') as t from documents),
size as (select count(*)::DOUBLE as n, avg(len(t)) as mean from docs), post as (select doc_id, len(t) as length, unnest(t) as term from docs),
terms as (select term, count(*) as n from post group by term), words as (select unnest(['erther', 'wither']) as word),
near as (select word, term, levenshtein(term, word) as edits from terms, words where levenshtein(term, word) between 1 and 1 qualify row_number() over (partition by word order by levenshtein(term, word), n desc, term) <= 50),
weights as (select term, max(weight) as weight from (select word as term, 1.0::DOUBLE as weight from words union all select term, 1 - edits::DOUBLE / length(word) from near) group by term),
found as (select doc_id, length, term, weight, count(*) as tf from post join weights using (term) group by all
 union all select doc_id, len(t), 'erther wither', 2.0, len(regexp_extract_all(' ' || low || ' ', '[^\p{L}]erther[^\p{L}]+wither[^\p{L}]')) from docs where regexp_matches(' ' || low || ' ', '[^\p{L}]erther[^\p{L}]+wither[^\p{L}]')),
df as (select term, count(*)::DOUBLE as df from found group by term)
select doc_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score from found join df using (term), size group by doc_id order by score desc, doc_id limit 50"""


def rrf_two_lists(spark, d):
    e = table(spark, d, "embeddings")
    lists = [(S.top(S.cosines(e, "vec_id", S.vector_of(e, "vec_id", q)), "vec_id", 100), 1.0) for q in (QUERY_ID, OTHER_ID)]
    fused = S.fuse(lists, "vec_id")
    return fused.select("vec_id", F.round("fused", 6).alias("rrf"), "best").orderBy(F.desc("rrf"), "vec_id").limit(50)


RRF_TWO = f"""with a as (select vec_id, round({COSINE.format(q=QUERY_ID)}, 6) as score from embeddings order by score desc, vec_id limit 100),
b as (select vec_id, round({COSINE.format(q=OTHER_ID)}, 6) as score from embeddings order by score desc, vec_id limit 100),
r as (select vec_id, score, 1.0::DOUBLE / (60 + row_number() over (order by score desc, vec_id)) as r from a
 union all select vec_id, score, 1.0::DOUBLE / (60 + row_number() over (order by score desc, vec_id)) from b)
select vec_id, round(sum(r), 6) as rrf, max(score) as best from r group by vec_id order by rrf desc, vec_id limit 50"""


def relevance_gate(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    semantic = S.top(S.cosines(e, "doc_id", S.vector_of(e, "doc_id", QUERY_ID)), "doc_id", 1000)
    lexical = I.best(documents_index(spark, d), PLAIN, 10)
    return S.gate(semantic, lexical, "doc_id", 0.30, 1.0).select("doc_id", F.round("fused", 6).alias("rrf"))


GATE = f"""with s as (select * from (select vec_id as doc_id, round({COSINE.format(q=QUERY_ID)}, 6) as score from embeddings order by score desc, doc_id limit 1000) where score >= 0.30),
l as (select * from (select * from ({bm25_sql(TERMS, 10)}) order by score desc, doc_id limit 3) where score >= 1.0),
r as (select doc_id, 1.0::DOUBLE / (60 + row_number() over (order by score desc, doc_id)) as r from s union all select doc_id, 1.0::DOUBLE / (60 + row_number() over (order by score desc, doc_id)) from l)
select doc_id, round(sum(r), 6) as rrf from r group by doc_id order by round(sum(r), 8) desc, doc_id limit 1000"""


def hybrid_rrf(spark, d):
    """Semantic, title-like and lexical branches, fused; the best ten with an excerpt.

    Ranks are found on ids alone; texts are fetched for the ten that are left."""
    docs = table(spark, d, "documents")
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    queries = [S.vector_of(vectors, "doc_id", q) for q in (QUERY_ID, OTHER_ID)]
    both = docs.select("doc_id").join(vectors, "doc_id").select("doc_id", *(V.cosine(F.col("embedding"), V.literal(q)).alias(f"s{k}") for k, q in enumerate(queries)))
    both = cut(both, "similarities")
    semantic, titles = (S.top(both.select("doc_id", F.col(f"s{k}").alias("score")), "doc_id", n) for k, n in ((0, 150), (1, 50)))
    lexical = I.best(linked_index(spark, d), PLAIN, 250)
    fused = S.fuse([(semantic, 1.0), (titles, 0.5), (lexical, 1.0)], "doc_id")
    best = cut(fused.select("doc_id", F.round("fused", 4).alias("rrf")).orderBy(F.desc("rrf"), "doc_id").limit(10), "best")
    return docs.join(F.broadcast(best), "doc_id").select("doc_id", "rrf", F.left("text", F.lit(150)).alias("excerpt"), "source").orderBy(F.desc("rrf"), "doc_id")


HYBRID = f"""with linked as (select d.*, e.embedding from documents d join embeddings e on e.vec_id = d.doc_id),
sem as (select doc_id, round({COSINE.format(q=QUERY_ID)}, 6) as score from linked order by score desc, doc_id limit 150),
tit as (select doc_id, round({COSINE.format(q=OTHER_ID)}, 6) as score from linked order by score desc, doc_id limit 50),
lex as ({bm25_sql(TERMS, 250).replace('from documents)', 'from linked)')}),
r as (select doc_id, 1.0::DOUBLE / (60 + row_number() over (order by score desc, doc_id)) as r from sem
 union all select doc_id, 0.5::DOUBLE / (60 + row_number() over (order by score desc, doc_id)) from tit
 union all select doc_id, 1.0::DOUBLE / (60 + row_number() over (order by score desc, doc_id)) from lex),
best as (select doc_id, round(sum(r), 4) as rrf from r group by doc_id order by rrf desc, doc_id limit 10)
select b.doc_id, b.rrf, left(l.text, 150) as excerpt, l.source from best b join linked l using (doc_id) order by rrf desc, doc_id"""


def hybrid_records(spark, d):
    """All five branches over records of several kinds: note chunks, collection titles, agent names, item titles, words.

    A vector is of the kind that its number says; eight note chunks, or texts, belong to one owner."""
    e = table(spark, d, "embeddings")
    kind = lambda c: F.pmod(c, F.lit(4))
    record = lambda c: F.when(kind(c) == 0, F.concat(F.lit("owner"), F.floor(c / 8).cast("string"))).when(kind(c) == 1, F.concat(F.lit("collection"), c.cast("string"))).when(kind(c) == 2, F.concat(F.lit("agent"), c.cast("string"))).otherwise(F.concat(F.lit("item"), c.cast("string")))
    names = ("note", "collection title", "agent name", "item title")
    near = cut(S.cosines(e, "vec_id", S.vector_of(e, "vec_id", QUERY_ID)).select(record(F.col("vec_id")).alias("rec"), "score", kind(F.col("vec_id")).alias("kind"), F.col("vec_id").cast("string").alias("excerpt")), "near")
    branches = [(near.where(F.col("kind") == k).select("rec", "score", F.lit(names[k]).alias("source"), "excerpt"), n, w) for k, (n, w) in enumerate(((150, 1.0), (50, 1.0), (25, 0.5), (150, 1.0)))]
    said = I.scores(documents_index(spark, d), PLAIN)
    words = said.select(record(F.col("doc_id")).alias("rec"), "score", F.when(kind(F.col("doc_id")) == 0, "note word match").otherwise("word match").alias("source"), F.col("doc_id").cast("string").alias("excerpt"))
    return S.hybrid([*branches, (words, 250, 1.0)], "rec", 50)


RECORDS = f"""with rec as (select *, case {{0}} % 4 when 0 then 'owner' || {{0}} // 8 when 1 then 'collection' || {{0}} when 2 then 'agent' || {{0}} else 'item' || {{0}} end as rec from ({{1}}) t),
hits as (select rec, score, ['note', 'collection title', 'agent name', 'item title'][vec_id % 4 + 1] as source, vec_id::VARCHAR as excerpt, vec_id % 4 as branch from near_rec
 union all select rec, score, case when doc_id % 4 = 0 then 'note word match' else 'word match' end, doc_id::VARCHAR, 4 from word_rec),
best as (select rec, branch, max(score) as score, arg_max((source, excerpt), (score, source, excerpt)) as m from hits group by all),
ranked as (select *, row_number() over (partition by branch order by score desc, rec) as rank from best),
r as (select rec, m, case when branch = 2 then 0.5 else 1.0 end::DOUBLE / (60 + rank) as r from ranked where rank <= [150, 50, 25, 150, 250][branch + 1])
select rec, round(sum(r), 4) as score, arg_max(m, (r, m[1]))[1] as source, arg_max(m, (r, m[1]))[2] as excerpt from r group by rec order by score desc, rec limit 50"""
_head, _rest = RECORDS.split("\nhits", 1)
_of = lambda name, column, source: _head.replace("with rec as", f"{name} as", 1).format(column, source)
RECORDS = "with " + _of("near_rec", "vec_id", f"select vec_id, round({COSINE.format(q=QUERY_ID)}, 6) as score from embeddings") + " " + _of("word_rec", "doc_id", bm25_sql(TERMS, 1_000_000_000)) + "\nhits" + _rest


def junk_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_junk(F.col("text")).alias("junk"))


JUNK = r"""with x as (select doc_id, text, length(text) as n, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') as toks from documents)
select doc_id, (length(trim(text, E' ')) < 30 or (len(regexp_extract_all(text, '<td>')) + len(regexp_extract_all(text, '</tr>'))) >= 3 or contains(lower(text), '©') or contains(lower(text), 'all rights reserved')
 or contains(lower(text), 'isbn') or len(regexp_extract_all(text, '[\p{L}\s]')) < 0.55 * n or (len(toks) >= 12 and len(list_filter(toks, lambda t: length(t) = 1)) > 0.3 * len(toks))) as junk from x"""


QUERIES = {"hybrid_rrf": hybrid_rrf, "hybrid_records": hybrid_records, "vector_topk": vector_topk, "lexical_bm25": lexical_bm25, "lexical_fuzzy": lexical_fuzzy, "rrf_two_lists": rrf_two_lists, "relevance_gate": relevance_gate, "junk_filter": junk_filter}
ORACLES = {"hybrid_rrf": HYBRID, "hybrid_records": RECORDS, "vector_topk": VECTOR_TOPK, "lexical_bm25": bm25_sql(TERMS, 50), "lexical_fuzzy": FUZZY_SQL, "rrf_two_lists": RRF_TWO, "relevance_gate": GATE, "junk_filter": JUNK}
