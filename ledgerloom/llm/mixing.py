"""Operator 4: mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source's target is its share of all words by weight, capped at CAP times its own words, the
excess reshared by weight until none is above. A source that takes `rate` = target / size times its
words gives every document floor(rate) certain whole copies, so none is lost to copies of others.
The words that are lacking come from one more copy of some, long documents likelier than short ones:

    p = min(1, c * root of size)        c such that p * size adds up to the words that are lacking

(in proportion to size itself, short documents would hardly ever be taken; the root leaves them a
share). Where p is 1 the copy is certain as well. The rest is a Pareto
order sample with inclusion probabilities p: documents are ranked by q = (u / (1 - u)) / (p / (1 - p)),
u uniform by a hash of the row, and the smallest are taken until the sample has the words that the
target still lacks after all certain copies, ending where it's nearest. The sample's fixed size is thus
one of words, as targets are.

No source is ever sorted as a whole, as one may hold most rows: words are summed by (source, size)
for c, and by (source, bucket of rank) for the sample's end; that bucket is dealt into finer ones,
and only the rows of the last are ranked one by one. What every row then needs is one row of its
source. Weights, sums and targets are whole numbers or exact decimals, so order changes nothing.

Null texts have size 0, null sources are one source, last in order; rows that are alike in every
hashed column share their fate. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, cut, table

CAP = 3
WEIGHTS = (1, 2, 3)
#: Buckets of rank for each source, and into how many finer ones the sample's last one is dealt.
BUCKETS = 2048
SEED = 20_240_101


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*columns) -> Column:
    """In (0, 1), by a hash of the columns: the same on every run and partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def before(rows: DataFrame, order: list[Column], label: str, **values: Column) -> DataFrame:
    """rows with the sum of each value over all rows before it in an order without ties.

    Rows are dealt by range; each partition is summed on its own, and the sums of those before it,
    of which there are as many as partitions, are added."""
    dealt = cut(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("__part"), *(v.alias(f"__v_{n}") for n, v in values.items())), label)
    parts = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("__part").agg(*(F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values))
    starts = sums.select(F.col("__part").alias("__p"), *(F.coalesce(F.sum(f"__s_{n}").over(parts), F.lit(0)).alias(f"__s_{n}") for n in values))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(starts, F.col("__part") == F.col("__p"))
    return joined.select(*rows.columns, *((F.col(f"__s_{n}") + F.coalesce(F.sum(f"__v_{n}").over(within), F.lit(0))).alias(n) for n in values))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size and target of each source; sizes has source and size.

    Sources are ordered twice, by code points for their weights and by room for their level, never in one task."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # UTF-8 bytes order as code points do
    ranked = before(by_source, [F.asc_nulls_last(F.col("source").cast("binary"))], "sources", rank=F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = ranked.withColumn("weight", weight.cast("long")).withColumn("room", F.lit(cap) * F.col("source_size"))
    # with sources in order of room by weight, those before the level's own are full; the level is the highest of the candidates
    summed = cut(before(weighted, [F.col("room") / F.col("weight"), F.col("rank")], "rooms", full=F.col("room"), gone=F.col("weight")), "summed")
    total = summed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("all")).first()
    words, all_ = (F.lit(total[k] or 0) for k in ("words", "all"))
    level = summed.agg(F.max((words - F.col("full")).cast("double") / (all_ - F.col("gone")))).first()[0]
    return summed.select("source", "source_size", F.least(F.col("room").cast("double"), F.lit(level or 0.0) * F.col("weight")).alias("target"))


def tilt(size: Column) -> Column:
    """What expected copies are in proportion to, as a whole number."""
    return F.floor(1024 * F.sqrt(size.cast("double"))).cast("long")


def copy_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with `base`, the copies of every document, and `rate`: c for each source. sizes: source and size (above 0) of each document.

    The windows span a source's distinct sizes, largest first: those before the rate's own have p = 1."""
    base = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) + 1e-12).cast("long")
    targets = targets.withColumn("base", base)
    by_size = sizes.groupBy("source", "size").agg(F.count("*").alias("n")).withColumn("words", (F.col("n") * F.col("size")).cast("decimal(38,0)"))
    order = Window.partitionBy("source").orderBy(F.desc("size"))
    full = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("decimal(38,0)"))
    rest = F.sum((F.col("words") * tilt(F.col("size"))).cast("decimal(38,0)")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    open_ = by_size.select(F.col("source").alias("s"), full.cast("double").alias("full"), rest.cast("double").alias("rest"))
    lacking = F.col("target") - F.col("base") * F.col("source_size")
    levels = targets.join(open_, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(F.max((lacking - F.col("full")) / F.col("rest")).alias("rate"))
    return targets.join(levels, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def extra_copy(rate: Column, size: Column) -> Column:
    """With which probability a document is taken once more."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate * tilt(size))), F.lit(0.0))


def with_shares(rows: DataFrame, of_source: DataFrame) -> DataFrame:
    """rows (source, size, ...) beside their source's row, with certain `copies`, and p of one more.

    of_source has one row for each source; adaptive execution broadcasts it when its measured size
    allows, and else joins by sorting and splits a hot source."""
    with_plan = rows.join(of_source.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    once_more = extra_copy(F.col("rate"), F.col("size"))
    certain = F.floor(once_more + 1e-9)
    return with_plan.withColumn("copies", (F.col("base") + certain).cast("long")).withColumn("p", F.when(once_more - certain > 1e-9, once_more - certain).otherwise(F.lit(0.0)))


def ranked(shared: DataFrame, key: list[str]) -> DataFrame:
    """with_shares' rows with __order, led by q, and __place: q / (q + 1 / typical odds of the source), in 0..1."""
    u, odds = uniform(*key, "size"), F.col("p") / (1 - F.col("p"))
    q = F.when(F.col("p") > 0, u / (1 - u) / odds)
    return shared.withColumn("__order", F.struct(q.alias("q"), F.xxhash64(F.lit(SEED + 1), *key, "size").alias("tie"))).withColumn("__place", q / (q + 1 / F.col("typical")))


def bucket_of(parts: int) -> Column:
    """Buckets grow with rank; `typical` odds make them about even."""
    return F.floor(F.col("__place") * parts).cast("long")


def sample_end(rows: DataFrame, bucket: Column, left: str) -> DataFrame:
    """source, __end and left_in of each source: the bucket in which its sample ends, and the words that it lacks there."""
    run = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("source", F.col(left).alias("lacking"), bucket.alias("__b")).agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(run))
    return sums.where("upto >= lacking and upto - words < lacking").select(F.col("source").alias("e_source"), F.col("__b").alias("__end"), (F.col("lacking") - F.col("upto") + F.col("words")).alias("left_in"))


def mix_plan(sizes: DataFrame, key: list[str], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix in one row for each source: target, rate, and where the source's sample ends."""
    some = sizes.where("size > 0")
    rates = cut(copy_rates(some.select("source", "size"), source_targets(sizes.select("source", "size"), weights, cap)), "rates")
    by_size = some.groupBy("source", "size").agg(F.count("*").alias("n"))
    typical = F.sum(F.col("n") * F.col("p")) / F.sum(F.col("n"))
    sums = with_shares(by_size, rates).groupBy("source").agg(F.sum(F.col("n") * F.col("copies") * F.col("size")).alias("certain"), F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.round(typical, 6))).alias("mean"))
    sums = sums.select(F.col("source").alias("s"), "certain", (F.col("mean") / (1 - F.col("mean"))).alias("typical"))
    targets = cut(rates.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("lacking", F.col("target") - F.col("certain")), "targets")
    rows = ranked(with_shares(some, targets).where("p > 0 and lacking > 0"), key)
    ends = cut(sample_end(rows, bucket_of(BUCKETS), "lacking"), "ends")
    inside = rows.join(ends, F.col("source").eqNullSafe(F.col("e_source")) & (bucket_of(BUCKETS) == F.col("__end")))
    finer = cut(sample_end(inside.drop("e_source", "__end"), bucket_of(BUCKETS * BUCKETS), "left_in").withColumnRenamed("left_in", "left"), "finer")
    inside = rows.join(finer, F.col("source").eqNullSafe(F.col("e_source")) & (bucket_of(BUCKETS * BUCKETS) == F.col("__end")))
    run = Window.partitionBy("e_source").orderBy("__order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = inside.groupBy("e_source", "left", "__order").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(run))
    # a row is in if the sample with it is no farther from the target than without it
    last = near.where("upto - left <= left - (upto - words)").groupBy("e_source").agg(F.max("__order").alias("last"))
    limits = finer.select(F.col("e_source").alias("b_source"), "__end").join(last, F.col("b_source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
    return cut(targets.join(limits, F.col("source").eqNullSafe(F.col("b_source")), "left").drop("b_source"), "mix")


def copies_of(rows: DataFrame, plan: DataFrame, key: list[str]) -> DataFrame:
    """rows with source_size, target and n_copies."""
    fine = bucket_of(BUCKETS * BUCKETS)
    # where the words that are lacking exceed those of all with p, every one of them is in
    inside = F.when(F.col("__end").isNull(), F.col("lacking") > 0).otherwise((fine < F.col("__end")) | ((fine == F.col("__end")) & F.coalesce(F.col("__order") <= F.col("last"), F.lit(False))))
    n = F.col("copies") + F.when((F.col("p") > 0) & inside, 1).otherwise(0)
    return ranked(with_shares(rows, plan), key).select(*(F.col(f"`{c}`") for c in rows.columns), "source_size", "target", n.cast("long").alias("n_copies"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row. Texts are read once, for their sizes."""
    sizes = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "sizes")
    key = ["doc_id", "text_hash"]
    return copies_of(sizes, mix_plan(sizes, key), key).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def sample_documents(docs: DataFrame) -> DataFrame:
    """All columns of docs, each row as often as the mix takes it. Texts aren't shuffled."""
    row = F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("__row")
    rows = docs.select(row).select("__row", "__row.doc_id", "__row.source", size_of(F.col("__row.text")).alias("size"), F.xxhash64("__row.text").alias("text_hash"))
    key = ["doc_id", "text_hash"]
    taken = copies_of(rows, mix_plan(cut(rows.drop("__row"), "sizes"), key), key)
    return taken.where("n_copies > 0").select("__row", F.explode(F.array_repeat(F.lit(1), F.col("n_copies").cast("int")))).select("__row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))
