"""Operator 12: homomorphic multiset hashes of documents. DataFrame functions only.

A text is the multiset of its paragraphs, its lines: n line ends make n + 1 of them, empty ones
included. Each paragraph is hashed to a wide vector of whole numbers, and the fingerprint is the
sum of the vectors modulo powers of two, component by component. So order is of no account,
inserting a paragraph adds its vector, deleting subtracts it, and the sum of two fingerprints is
that of both texts with a line end between them.

Of a paragraph's vector, EXACT components modulo 2 ** 32 are its SHA-512; they tell equal multisets
from others. One counts its pieces (up to four words, fewer where a word has punctuation) modulo 2 ** 32.
The rest tell how alike two texts are: each of 60 counts the pieces whose hash has a certain bit,
modulo 2 ** 15, four to a number modulo 2 ** 60. Twice a count less all pieces is a sum of random
signs; the mean square of two texts' differences in these sums estimates the squared distance of their
multisets of pieces, |A - B|^2, and against a text without pieces it estimates |A|^2.

    likeness = 1 - |A - B|^2 / (|A|^2 + |B|^2), kept within 0 and 1

is 1 for equal fingerprints, about a half where half of the pieces agree, and about 0 for strangers, within a
standard error of 0.13 from its 60 signs.

Documents follow each other by doc_id (null first), then by hash of their text; a repeated row is
followed by its copy, the last document by the first, a single one by itself. Null texts are empty.
The order is found on ids alone; texts move once, keyed by row, and the halves that replace others
move to their places. An empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, repeated, table

#: Components: of the exact part, and numbers of four counts each; bits of a count.
EXACT, PACKED, BITS = 16, 15, 15
PIECE = r"(?:[^\s.,;:!?]++[ \t]++){0,3}+\S++"
WORD32, WORD60, ONES = (1 << 32) - 1, (1 << 60) - 1, sum(1 << BITS * j for j in range(4))
N_PIECES = EXACT + PACKED


def zeros(n: int) -> Column:
    return F.array(*[F.lit(0).cast("long")] * n)


def vector(text: Column) -> Column:
    """The sum of the vectors of a text's paragraphs, as an array: EXACT components, PACKED numbers, the count of pieces."""
    digests = F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 512))
    word = lambda x, i: F.conv(F.substring(x, 8 * i + 1, 8), 16, 10).cast("long")
    exact = F.aggregate(digests, zeros(EXACT), lambda held, x: F.array(*((held[i] + word(x, i)).bitwiseAND(WORD32) for i in range(EXACT))))
    # no piece goes beyond its line, so the pieces of a text are those of its paragraphs
    hashes = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p))
    counts = F.aggregate(hashes, zeros(PACKED), lambda held, x: F.array(*((held[i] + F.shiftright(x, i).bitwiseAND(ONES)).bitwiseAND(WORD60) for i in range(PACKED))))
    return F.concat(exact, counts, F.array(F.size(hashes).cast("long")))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of two texts together; sign -1 takes the second one's paragraphs away from the first."""
    modulus = F.array(*(F.lit(WORD60 if EXACT <= i < N_PIECES else WORD32) for i in range(N_PIECES + 1)))
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + y if sign > 0 else x - y), modulus, lambda x, m: x.bitwiseAND(m))


def fingerprint(v: Column) -> Column:
    digits = lambda part, n: F.array_join(F.transform(part, lambda x: F.lower(F.lpad(F.hex(x), n, "0"))), "")
    return F.concat(digits(F.slice(v, 1, EXACT), 8), digits(F.slice(v, EXACT + 1, PACKED), 15), digits(F.slice(v, N_PIECES + 1, 1), 8))


def squared_distance(a: Column, b: Column) -> Column:
    """Four times PACKED times the estimate of |A - B|^2, a whole number."""
    more = a[N_PIECES] - b[N_PIECES]
    half = F.floor(more / 2).cast("long")
    # what each count differs by beyond half of all pieces is small, so it's read from its digits, with a middle added to keep them above 0
    shift = reduce(lambda x, y: x + y, (F.shiftleft(half.bitwiseAND((1 << 60 - BITS * j) - 1), BITS * j) for j in range(4)))
    gap = F.zip_with(F.slice(a, EXACT + 1, PACKED), F.slice(b, EXACT + 1, PACKED), lambda x, y: x - y - shift + F.lit(ONES << (BITS - 1)))
    signs = lambda x: F.array(*(2 * F.shiftright(x, BITS * j).bitwiseAND((1 << BITS) - 1) - (1 << BITS) - (more - 2 * half) for j in range(4)))
    return F.aggregate(F.flatten(F.transform(gap, signs)), F.lit(0).cast("long"), lambda held, x: held + x * x)


def likeness(a: Column, b: Column) -> Column:
    empty = zeros(N_PIECES + 1)
    both = squared_distance(a, empty) + squared_distance(b, empty)
    near = F.try_divide((both - squared_distance(a, b)).cast("double"), both.cast("double"))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(near, F.lit(0.0)))))


def following(rows: DataFrame) -> DataFrame:
    """key, next_key, need and copies of each place where one document follows another. rows: doc_id, key, n_chars.

    Ids are dealt by range and followed within a range; a range's last is followed by the next range's first."""
    groups = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.first("n_chars").alias("n_chars"))
    order = [F.asc_nulls_first("doc_id"), F.asc("key")]
    dealt = cut(groups.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "order")
    within = dealt.withColumn("inside", F.lead("key").over(Window.partitionBy("__part").orderBy(*order)))
    firsts = dealt.groupBy("__part").agg(F.min(F.struct("doc_id", "key"))["key"].alias("begin"))
    along = Window.partitionBy(F.lit(0)).orderBy("__part")  # one row for each range
    begins = firsts.select("__part", F.coalesce(F.lead("begin").over(along), F.first("begin").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("beyond"))
    need = F.floor(F.col("n_chars") / 2).cast("int").alias("need")
    linked = within.join(begins, "__part").select("key", F.coalesce("inside", "beyond").alias("next_key"), need, "n")
    copies = linked.where("n > 1").select("key", F.col("key").alias("next_key"), "need", (F.col("n") - 1).alias("copies"))
    return linked.select("key", "next_key", "need", F.lit(1).cast("long").alias("copies")).unionByName(copies)


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document, with its edited text's digest and fingerprint, and likenesses."""
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text), 256))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", key.alias("key"))
    links = cut(following(rows.select("doc_id", "key", F.char_length("text").alias("n_chars"))), "links")
    # one exchange of texts serves both joins
    once = rows.withColumn("v", vector(F.col("text"))).groupBy("key").agg(*(F.first(c).alias(c) for c in ("doc_id", "text", "v")))
    sent = links.join(once.withColumnRenamed("key", "next_key"), "next_key").select("key", "copies", F.col("doc_id").alias("next_doc_id"), F.left("text", F.col("need")).alias("tail"), F.col("v").alias("next_v"), "need")
    met = once.join(sent, "key")
    n_chars = F.char_length("text").cast("long")
    edited = met.select("doc_id", "next_doc_id", n_chars.alias("n_chars"), "v", "next_v", "copies", F.concat(F.left("text", F.char_length("text") - F.col("need")), F.col("tail")).alias("edited"))
    printed = edited.select("*", F.sha2("edited", 256).alias("edited_sha256"), vector(F.col("edited")).alias("edited_v")).drop("edited")
    out = printed.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("v")).alias("fingerprint"), fingerprint(F.col("edited_v")).alias("edited_fingerprint"), likeness(F.col("v"), F.col("edited_v")).alias("near_edited"), likeness(F.col("v"), F.col("next_v")).alias("near_next"), "next_doc_id", "copies")
    return repeated(out, "copies")


def op12_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
