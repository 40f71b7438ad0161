"""Lexical and vector search, and the fusion of ranked lists.

Scoring is a projection over the documents that match, and a top-k keeps k rows for each partition
before anything is shuffled. Corpus statistics are sums over all documents."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions import vectors
from ledgerloom.lineage import cut

K1, B, RRF_K = 1.2, 0.75, 60
#: Terms that one fuzzy word stands for at most, as full-text engines have it (fixed value).
EXPANSIONS = 50
LETTERS = r"[^\p{L}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), LETTERS), lambda t: t != "")


def with_frequencies(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, length in tokens, and tf_0.. of each term. Tokens are runs of letters, so patterns count them in place."""
    low = F.lower(F.col(text))
    return docs.select(key, low.alias("__low")).select(key, F.regexp_count("__low", F.lit(r"\p{L}+")).alias("length"), *(F.regexp_count("__low", F.lit(rf"(?<!\p{{L}}){re.escape(w)}(?!\p{{L}})")).alias(f"tf_{k}") for k, w in enumerate(terms)))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], weights: list[float] | None = None) -> DataFrame:
    """key and score of the documents that hold a term. One row of statistics is collected."""
    terms = list(dict.fromkeys(terms))
    weights = weights or [1.0] * len(terms)
    counted = cut(with_frequencies(docs, key, text, terms), "frequencies")  # texts are read once, for statistics and scores alike
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf_{k}") > 0).alias(f"df_{k}") for k in range(len(terms)))).first()
    score = F.lit(0.0)
    for k, w in enumerate(weights):
        tf, df = F.col(f"tf_{k}").cast("double"), F.lit(float(stats[f"df_{k}"]))
        idf = F.log(1 + (F.lit(float(stats["n"])) - df + 0.5) / (df + 0.5))
        score = score + F.lit(w) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(float(stats["mean"] or 1.0))))
    return counted.where(" or ".join(f"tf_{k} > 0" for k in range(len(terms)))).select(key, score.alias("score"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, length and term of every token: what an inverted index is built from."""
    split = docs.select(key, tokens(F.col(text)).alias("__t"))
    return split.select(key, F.size("__t").alias("length"), F.explode("__t").alias("term"))


def near_terms(index: DataFrame, edits: dict[str, int]) -> DataFrame:
    """word and term: the EXPANSIONS most frequent terms within a word's edits, with how many they are."""
    words = [w for w, n in edits.items() if n]
    terms = index.groupBy("term").agg(F.count("*").alias("n"))
    distance = F.array(*(F.struct(F.lit(w).alias("word"), F.levenshtein("term", F.lit(w), edits[w]).alias("edits")) for w in words))
    near = terms.select("term", "n", F.inline(distance)).where("edits between 1 and 2")
    best = Window.partitionBy("word").orderBy("edits", F.desc("n"), "term")
    return near.withColumn("__rn", F.row_number().over(best)).where(F.col("__rn") <= EXPANSIONS).select("word", "term", "edits")


def lexical(docs: DataFrame, key: str, text: str, topic: str, fuzzy: bool = True) -> DataFrame:
    """key and score by a topic's query: its words, terms within their edits at a lower weight, and the phrase, boosted.

    Postings of the query's terms alone are shuffled; terms and their weights, EXPANSIONS for a word
    at most, are broadcast."""
    query = T.lexical_query(topic.lower(), fuzzy)
    index = postings(docs, key, text)
    spark, words = docs.sparkSession, list(dict.fromkeys(query["words"]))
    weights = spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("term"), F.lit(1.0).alias("weight"))
    if any(query["edits"].values()):
        near = near_terms(index, query["edits"])
        weights = weights.unionByName(near.groupBy("term").agg(F.max(1 - F.col("edits") / F.length("word")).alias("weight"))).groupBy("term").agg(F.max("weight").alias("weight"))
    weights = cut(weights, "terms")
    found = index.join(F.broadcast(weights), "term").groupBy(key, "length", "term", "weight").agg(F.count("*").alias("tf"))
    if query["phrase"]:
        phrase = r"(?<!\p{L})" + r"\P{L}+".join(map(re.escape, query["words"])) + r"(?!\p{L})"
        whole = docs.select(key, F.regexp_count(F.lower(text), F.lit(r"\p{L}+")).alias("length"), F.lit(query["phrase"]).alias("term"), F.lit(query["phrase_boost"]).alias("weight"), F.regexp_count(F.lower(text), F.lit(phrase)).cast("long").alias("tf"))
        found = found.unionByName(whole.where("tf > 0"))
    found = cut(found, "found")
    size = docs.agg(F.count("*").alias("n"), F.avg(F.regexp_count(F.lower(text), F.lit(r"\p{L}+"))).alias("mean")).first()
    df = found.groupBy("term").agg(F.count("*").alias("df"))  # as few as the query's terms
    idf = F.log(1 + (F.lit(float(size["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(size["mean"] or 1.0))))
    return found.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(part).alias("score"))


def vector_of(vectors_: DataFrame, key: str, value, column: str = "embedding") -> list[float]:
    """One vector, by key."""
    return list(vectors_.where(F.col(key) == value).select(column).first()[0])


def cosines(vectors_: DataFrame, key: str, query: list[float], column: str = "embedding", rescaled: bool = False) -> DataFrame:
    return vectors_.select(key, vectors.cosine(F.col(column), vectors.literal(query), rescaled).alias("score"))


def top(scored: DataFrame, key: str, k: int, digits: int = 6) -> DataFrame:
    """The k best by rounded score, ties by key."""
    return scored.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), key).limit(k)


def ranks(scored: DataFrame, key: str) -> DataFrame:
    """rank from 1; for lists that top() has already bounded."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fuse(lists: list[tuple[DataFrame, float]], key: str, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of bounded lists: key, fused, and the best score of any list."""
    parts = [ranks(found, key).select(key, "score", (F.lit(weight) / (F.lit(k) + F.col("rank"))).alias("r")) for found, weight in lists]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(key).agg(F.sum("r").alias("fused"), F.max("score").alias("best"))


def best_matches(hits: DataFrame, key: str, k: int) -> DataFrame:
    """The k best records of a branch's hits (key, score, source, excerpt), each with its best hit."""
    best = F.max_by(F.struct("source", "excerpt"), F.struct("score", "source", "excerpt"))
    return hits.withColumn("score", F.round("score", 6)).groupBy(key).agg(F.max("score").alias("score"), best.alias("m")).orderBy(F.desc("score"), key).limit(k)


def hybrid(branches: list[tuple[DataFrame, int, float]], key: str, limit: int) -> DataFrame:
    """key, score, source and excerpt: weighted rank fusion over branches (hits, how many records, weight).

    A record shows the match of the branch that ranks it best. Lists are as short as their k says."""
    parts = [ranks(best_matches(hits, key, k), key).select(key, "m", (F.lit(weight) / (RRF_K + F.col("rank"))).alias("r")) for hits, k, weight in branches]
    rows = functools.reduce(DataFrame.unionByName, parts)
    fused = rows.groupBy(key).agg(F.round(F.sum("r"), 4).alias("score"), F.max_by("m", F.struct("r", "m.source")).alias("m"))
    return fused.select(key, "score", "m.source", "m.excerpt").orderBy(F.desc("score"), key).limit(limit)


def gate(semantic: DataFrame, lexical: DataFrame, key: str, floor: float, lexical_floor: float, rescue: int = 3, cap: int = 1000) -> DataFrame:
    """Survivors of a relevance gate: all semantic ones above a floor, the strongest lexical ones, fused."""
    strong = semantic.where(F.col("score") >= floor)
    words = top(lexical, key, rescue).where(F.col("score") >= lexical_floor)
    return fuse([(strong, 1.0), (words, 1.0)], key).orderBy(F.desc(F.round("fused", 8)), key).limit(cap)
