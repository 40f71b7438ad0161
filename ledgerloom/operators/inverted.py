"""An inverted index on disk: built once from a table of texts, read by term.

    postings/bucket=../   term, slot, bound, docs: array<struct<key, tf, length, at>>
    terms/                term, bucket, df, n
    about/                n, mean, buckets, slots, key and its type; written last, so an index that has it is whole

A slot is up to SLOT documents that one task reads after another, so no posting is longer however common its term:
a term that every document holds is as many rows as there are slots. Rows are dealt by bucket of term
and sorted by term, so a query reads its terms' buckets (partition filter) and their row groups
(statistics of term). `at` are positions of the term among the document's tokens, for phrases. `bound`
is at least the largest share of a term's weight that any document of the slot has, by 1 / GRAIN at most; summed over
a query's terms it bounds all scores of the slot, and slots below the k-th best score so far are never read.

What building writes besides the index is one shuffle of its postings, packed: a task turns a block of documents into arrays
for each bucket, which are compressed as a whole and unpacked into rows on the other side. Texts and tokens are never shuffled,
unless keys are repeated.

Tokens are runs of letters in lower case. Null texts have none, and don't count for the mean length.
A key is expected once: rows that share one are brought together first, and count as one document where their lengths are
the same. Rows must come in the same order whenever a task reads them, as those of files do."""

from __future__ import annotations

import functools
import hashlib
import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.lineage import shared_dir

K1, B = 1.2, 0.75
LETTERS = r"[^\p{L}]+"
#: Documents of a slot, tokens of a bucket, buckets at most, and terms that a fuzzy word stands for at most.
SLOT, BUCKET, BUCKETS, EXPANSIONS = 256, 4_000_000, 4096, 50
#: Tokens that a task packs at once, texts that it gets at once, and steps of 1 in which bounds are given.
BLOCK, ARROW_ROWS, GRAIN = 1_000_000, 512, 64
#: Keys that are packed as numbers.
KINDS = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), LETTERS), lambda t: t != "")


def saturation(tf: Column, length: Column, mean: float) -> Column:
    tf = tf.cast("double")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(float(mean or 1.0))))


def inverse_frequency(df: int, n: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def path_of(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def mark(docs: DataFrame, *more: str) -> str:
    """What an index of docs is known by: names, sizes and times of its files, and how it was made."""
    spark, parts = docs.sparkSession, list(more)
    for name in sorted(docs.inputFiles()):
        fs, path = path_of(spark, name)
        status = fs.getFileStatus(path)
        parts.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def read_postings(spark: SparkSession, folder: str, key: str, kind: str) -> DataFrame:
    doc = f"struct<`{key}`: {kind}, tf: int, length: int, at: array<int>>"
    return spark.read.schema(f"term string, slot long, bound double, docs array<{doc}>, bucket int").parquet(f"{folder}/postings")


class Index:
    """An index in a folder; opened by its `about` row."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        about = spark.read.schema("n long, mean double, buckets int, slots long, key string, kind string").parquet(f"{folder}/about").first()
        self.n, self.mean, self.buckets, self.slots, self.key = about.n, about.mean, about.buckets, about.slots, about.key
        self.all_postings = read_postings(spark, folder, about.key, about.kind)
        self.all_terms = spark.read.schema("term string, bucket int, df long, n long").parquet(f"{folder}/terms")

    def postings(self, terms: list[str]) -> DataFrame:
        """Rows of these terms; reads their buckets alone."""
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return self.all_postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("bucket")

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """df of the terms that occur. As many rows as the query has terms."""
        return {r.term: r.df for r in self.all_terms.where(F.col("term").isin(terms)).select("term", "df").collect()}

    def weights(self, weighted: dict[str, float]) -> dict[str, float]:
        """Weight times inverse document frequency of each term that occurs."""
        return {t: weighted[t] * inverse_frequency(df, self.n) for t, df in self.frequencies(list(weighted)).items()}


def blocks(batches: Iterator[pa.RecordBatch], repeated: bool) -> Iterator[pa.Table]:
    """Tables of about BLOCK tokens; rows that share a key stay together, if there may be any."""
    held, size, enough = [], 0, BLOCK
    tokens_of = lambda batch: len(batch.column(1).flatten())
    for batch in batches:
        for start in range(0, batch.num_rows, SLOT):
            held.append(batch.slice(start, SLOT))
            size += tokens_of(held[-1])
            if size < enough:
                continue
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(begins(table.column(0)))[-1]) if repeated else table.num_rows
            if last:
                yield table[:last]
            held = table[last:].combine_chunks().to_batches()
            size = sum(map(tokens_of, held))
            enough = max(BLOCK, 2 * size)
    if held:
        yield pa.Table.from_batches(held)


def begins(column: pa.ChunkedArray) -> np.ndarray:
    """Whether a value differs from the one before; nulls are alike."""
    codes = column.combine_chunks().dictionary_encode("encode").indices.to_numpy()
    return np.diff(codes, prepend=-1) != 0


def thin(numbers: np.ndarray) -> tuple[int, int, bytes]:
    """Whole numbers as their least, and what they have beyond it, in as few bytes as that takes: all first bytes, all second ones, ..."""
    least = int(numbers.min()) if len(numbers) else 0
    beyond = numbers.astype(np.int64).view(np.uint64) - np.uint64(least % (1 << 64))  # modulo 2^64, so right for the largest spans too
    width = np.min_scalar_type(int(beyond.max(initial=0))).itemsize
    return least, width, beyond.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def thick(least: int, width: int, raw: bytes) -> np.ndarray:
    beyond = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()
    return (beyond.astype(np.uint64) + np.uint64(least % (1 << 64))).view(np.int64)


def pack(batches: Iterator[pa.RecordBatch], buckets: int, repeated: bool) -> Iterator[pa.RecordBatch]:
    """Batches of key and tokens to one row for each block and bucket: terms, postings of each; slot, key, tf, length of
    each posting; gaps of the positions."""
    slot, codec = TaskContext.get().partitionId() << 32, pa.Codec("zstd", compression_level=6)
    for block in blocks(batches, repeated):
        keys, lists = (c.combine_chunks() for c in block.columns)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int32)
        new = begins(block.column(0)) if repeated else np.ones(len(keys), bool)
        slots = slot + (np.cumsum(new) - 1) // SLOT
        slot = int(slots[-1]) + 1
        coded = lists.flatten().dictionary_encode()
        terms = coded.dictionary
        bucket = np.fromiter((zlib.crc32(t.encode()) % buckets for t in terms.to_pylist()), np.int32, len(terms))
        by_bucket = np.argsort(bucket, kind="stable")
        rank = np.empty(len(terms), np.int32)
        rank[by_bucket] = np.arange(len(terms), dtype=np.int32)
        term = rank[coded.indices.to_numpy()]
        # the first of the rows with this key and length stands for all
        first = np.flatnonzero(new | (np.diff(lengths, prepend=-1) != 0))
        doc = np.repeat(np.repeat(first, np.diff(first, append=len(keys))).astype(np.int32), lengths)
        at = np.arange(len(term), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
        order = np.lexsort((at, doc, term)) if repeated else np.argsort(term, kind="stable")
        term, doc, at = term[order], doc[order], at[order]
        start = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        gap = np.diff(at, prepend=0)
        gap[start] = at[start]
        tf, term, doc = np.diff(start, append=len(at)), term[start], doc[start]
        held = np.bincount(term, minlength=len(terms))  # postings of each term
        ends, bucket, names = np.cumsum(held), bucket[by_bucket], terms.take(pa.array(by_bucket)).to_pylist()
        cuts = [*np.flatnonzero(np.diff(bucket, prepend=-1)), len(terms)]
        rows = []
        for a, b in zip(cuts, cuts[1:]):
            x, y = int(ends[a] - held[a]), int(ends[b - 1])
            part, last = doc[x:y], start[y] if y < len(start) else len(gap)
            key = keys.take(pa.array(part))
            key = thin(key.to_numpy()) if pa.types.is_signed_integer(key.type) and not key.null_count else key
            # tokens are letters alone
            raw = pickle.dumps((" ".join(names[a:b]), key, *map(thin, (held[a:b], slots[part], tf[x:y], lengths[part], gap[start[x] : last]))), 5)
            rows.append((int(bucket[a]), len(raw), codec.compress(raw, asbytes=True)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "size", "packed"])


def unpack(batches: Iterator[pa.RecordBatch], key: str, kind: str, mean: float) -> Iterator[pa.RecordBatch]:
    """What pack() made, as rows of postings."""
    for batch in batches:
        for bucket, size, packed in zip(*(c.to_pylist() for c in batch.columns)):
            names, keys, *numbers = pickle.loads(pa.decompress(packed, size, "zstd", asbytes=True))
            names, (held, slots, tf, length, gap) = names.split(" "), (thick(*x) for x in numbers)
            keys = keys if isinstance(keys, pa.Array) else pa.array(thick(*keys)).cast(KINDS[kind])
            term, tf, length = np.repeat(np.arange(len(names)), held), tf.astype(np.int32), length.astype(np.int32)
            starts = np.concatenate([[0], np.cumsum(tf)]).astype(np.int32)
            at = np.cumsum(gap)
            at -= np.repeat(at[starts[:-1]] - gap[starts[:-1]], tf)
            docs = pa.StructArray.from_arrays([keys, pa.array(tf), pa.array(length), pa.ListArray.from_arrays(pa.array(starts), pa.array(at.astype(np.int32)))], [key, "tf", "length", "at"])
            row = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(slots, prepend=-1) != 0))
            share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (mean or 1.0)))
            bound = (np.floor(np.maximum.reduceat(share, row) * GRAIN) + 1) / GRAIN
            columns = [
                pa.array(np.full(len(row), bucket, np.int32)), pa.array(names, pa.string()).take(pa.array(term[row])), pa.array(slots[row]), pa.array(bound),
                pa.ListArray.from_arrays(pa.array(np.append(row, len(tf)).astype(np.int32)), docs),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "term", "slot", "bound", "docs"])


def build(docs: DataFrame, key: str, text: str, folder: str) -> Index:
    """Write the index of docs (key, text) to a folder, and open it."""
    spark = docs.sparkSession
    size = docs.select(F.regexp_count(F.lower(F.col(text)), F.lit(r"\p{L}+")).alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    slots, buckets = max(1, -(-size.n // SLOT)), max(8, min(BUCKETS, size.tokens // BUCKET))
    kind = docs.schema[key].dataType.simpleString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    rows = docs.select(F.col(key), F.col(text))
    repeated = not docs.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").isEmpty()
    split = (rows.repartition(key) if repeated else rows).select(key, tokens(F.col(text)).alias("__t"))
    if repeated:
        split = split.sortWithinPartitions(key, F.size("__t"))
    packed = split.mapInArrow(functools.partial(pack, buckets=buckets, repeated=repeated), "bucket int, size long, packed binary")
    doc = f"struct<`{key}`: {kind}, tf: int, length: int, at: array<int>>"
    # large buckets are dealt to several tasks, each of which sorts its own
    listed = packed.hint("rebalance", "bucket").mapInArrow(functools.partial(unpack, key=key, kind=kind, mean=float(size.mean or 0.0)), f"bucket int, term string, slot long, bound double, docs array<{doc}>")
    listed.sortWithinPartitions("bucket", "term", "slot").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/postings")
    held = read_postings(spark, folder, key, kind)
    n = F.aggregate("docs.tf", F.lit(0).cast("long"), lambda x, tf: x + tf)
    counted = held.groupBy("term", "bucket").agg(F.sum(F.size("docs.tf")).alias("df"), F.sum(n).alias("n"))
    counted.sortWithinPartitions("term").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/terms")
    about = spark.range(1).select(F.lit(size.n).cast("long").alias("n"), F.lit(float(size.mean or 0.0)).alias("mean"), F.lit(buckets).cast("int").alias("buckets"), F.lit(slots).cast("long").alias("slots"), F.lit(key).alias("key"), F.lit(kind).alias("kind"))
    about.write.mode("overwrite").parquet(f"{folder}/about")
    return Index(spark, folder)


def index_of(docs: DataFrame, key: str, text: str, label: str = "") -> Index:
    """The index of docs in the shared folder, built if no whole one is there. docs must come from files; label tells apart what is read from the same ones."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/index-{mark(docs, key, text, label)}"
    fs, done = path_of(spark, f"{folder}/about/_SUCCESS")
    return Index(spark, folder) if fs.exists(done) else build(docs, key, text, folder)


def literal_map(weights: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))


def scores(index: Index, weighted: dict[str, float], slots: DataFrame | None = None) -> DataFrame:
    """key and score of every document that holds a term, or of those in slots."""
    weights = index.weights(weighted)
    if not weights:
        return index.all_postings.select(F.explode("docs").alias("d")).select(F.col(f"d.{index.key}"), F.lit(0.0).alias("score")).where("false")
    rows = index.postings(list(weights))
    if slots is not None:
        rows = rows.join(slots.select("slot"), "slot", "left_semi")
    found = rows.select("slot", literal_map(weights)[F.col("term")].alias("w"), F.explode("docs").alias("d"))
    return found.groupBy("slot", f"d.{index.key}").agg(F.sum(F.col("w") * saturation(F.col("d.tf"), F.col("d.length"), index.mean)).alias("score")).drop("slot")


def best(index: Index, weighted: dict[str, float], k: int) -> DataFrame:
    """The k best documents by score rounded to six digits, ties by key.

    The slots with the highest bounds are scored first; the k-th score there is one that the k best
    reach, so slots whose bound lies below it are left unread."""
    weights = index.weights(weighted)
    if not weights:
        return scores(index, weighted)
    bounds = index.postings(list(weights)).groupBy("slot").agg(F.sum(literal_map(weights)[F.col("term")] * F.col("bound")).alias("most"))
    ahead = [r.slot for r in bounds.orderBy(F.desc("most"), "slot").limit(1 + -(-k // SLOT)).collect()]
    order = (F.desc("score"), index.key)
    rounded = lambda found: found.withColumn("score", F.round("score", 6))
    seen = scores(index, weighted, bounds.where(F.col("slot").isin(ahead)))
    floor = rounded(seen).orderBy(*order).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    left = bounds.where(F.col("most") >= (floor.least - 1e-6 if floor.n == k else 0.0))
    return rounded(scores(index, weighted, left)).orderBy(*order).limit(k)


def near_terms(index: Index, edits: dict[str, int]) -> dict[str, float]:
    """term to weight: those most frequent within a word's edits, EXPANSIONS for each word. Scans the vocabulary, not texts."""
    words = [w for w, n in edits.items() if n]
    if not words:
        return {}
    distance = F.array(*(F.struct(F.lit(w).alias("word"), F.levenshtein("term", F.lit(w), edits[w]).alias("edits")) for w in words))
    shortest, longest = min(map(len, words)) - 2, max(map(len, words)) + 2
    near = index.all_terms.where(F.length("term").between(shortest, longest)).select("term", "n", F.inline(distance)).where("edits between 1 and 2")
    order = Window.partitionBy("word").orderBy("edits", F.desc("n"), "term")
    rows = near.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= EXPANSIONS).select("word", "term", "edits").collect()
    out: dict[str, float] = {}
    for r in rows:
        out[r.term] = max(out.get(r.term, 0.0), 1 - r.edits / len(r.word))
    return out


def phrases(index: Index, words: list[str]) -> DataFrame:
    """key, length and tf of the documents that hold the words one after another; occurrences don't overlap."""
    parts = [index.postings([w]).select("slot", F.lit(k).alias("k"), F.explode("docs").alias("d")) for k, w in enumerate(words)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    of = rows.groupBy("slot", f"d.{index.key}").agg(F.max("d.length").alias("length"), *(F.max(F.when(F.col("k") == k, F.col("d.at"))).alias(f"at{k}") for k in range(len(words))))
    back = lambda k: F.transform(f"at{k}", lambda p: p - k)  # noqa: E731  where the phrase would start
    starts = functools.reduce(F.array_intersect, map(back, range(len(words))))
    step = lambda held, p: F.when(p >= held["free"], F.struct((held["n"] + 1).alias("n"), (p + len(words)).alias("free"))).otherwise(held)
    counted = F.aggregate(F.array_sort(starts), F.struct(F.lit(0).alias("n"), F.lit(0).alias("free")), step)["n"]
    return of.withColumn("tf", counted).where("tf > 0").select(index.key, "length", "tf")


def lexical(index: Index, topic: str, fuzzy: bool = True) -> DataFrame:
    """key and score by a topic's query: its words, terms within their edits at a lower weight, and the phrase, boosted."""
    query = T.lexical_query(topic.lower(), fuzzy)
    weighted = near_terms(index, query["edits"])
    weighted |= dict.fromkeys(query["words"], 1.0)
    found = scores(index, weighted)
    if query["phrase"]:
        together = phrases(index, query["words"])
        df = together.count()
        extra = together.select(index.key, (F.lit(query["phrase_boost"] * inverse_frequency(df, index.n)) * saturation(F.col("tf"), F.col("length"), index.mean)).alias("score"))
        found = found.unionByName(extra).groupBy(index.key).agg(F.sum("score").alias("score"))
    return found
