"""Operator 7: near-duplicates by SetSketch registers, joint likelihood, and full-set confirmation.

1  Every text becomes its set of word shingles, hashed to 64 bits, and the set a digest and a
   SetSketch: each of M registers keeps floor(1 - log_b x) of the smallest of exponential variates
   x, one for each shingle, truncated to 0..255. Registers of a union are the larger of both.
2  Texts with one digest are one class from here on, however many copies there are.
3  Bands of ROWS registers are hashed into buckets. Buckets with the same classes are one. Within a
   bucket, pairs are compared by their registers: a pair whose likelihood at the threshold is
   e**CUTOFF times below its largest, beyond five standard errors, is passed over. What remains
   connected is linked to its least class, so a bucket of n classes yields n - 1 links at most.
   Components of these links hold every pair that shares a band, and texts that don't share one
   with probability at most 3e-6 at the threshold (1e-12 at 0.9).
4  Within a candidate component, pairs that the registers allow are confirmed, or not, on the full
   sets. Search goes outwards from linked texts, so within a group of texts that are all alike each
   is compared once.
   Both joins with what grows (buckets, members) are sort-merge joins at every size.
   A bucket of more than BUCKET_BLOCK classes is dealt out in pairs of blocks, each pair of blocks to
   one task: no task holds more than two blocks, and every pair still meets somewhere.
   A component of more than BLOCK texts is dealt into blocks, each with the component's PIVOTS, and
   searched within them first. Its largest group so found is set apart; what is outside of it meets
   all of the component in a second round. In a family of texts that are alike nothing is outside,
   and each text's set is shuffled once; else once more for each block of what is outside.
5  Components of the confirmed links are the result.

Null and empty texts have no shingles and stand alone. Rows with a null doc_id keep their size, have
no component, and stay. Rows that repeat a doc_id with another text are nodes of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, id_and_text, map_arrow, table
from ledgerloom.operators.components import components

SHINGLE, SIMILARITY = 4, 0.8
BANDS, ROWS = 32, 5
M = BANDS * ROWS
BASE, RATE = 1.2, 20.0
CUTOFF = 14.0
#: Texts, and shingles, of one block of a candidate component; larger ones are large.
BLOCK, BLOCK_SHINGLES = 500, 1_000_000
#: Sets that every block of a large candidate component holds.
PIVOTS = 8
#: Classes of one block of a large bucket.
BUCKET_BLOCK = 4000
#: Equal registers without which a pair isn't looked at: seven standard deviations below what the threshold gives.
LEAST_EQUAL = round(0.59 * M)

_rng = np.random.default_rng(0x5E75)
FACTORS, OFFSETS = _rng.integers(0, 1 << 63, M, np.uint64) * np.uint64(2) + np.uint64(1), _rng.integers(0, 1 << 63, M, np.uint64)
#: Similarities at which likelihood is evaluated.
GRID = np.append(np.linspace(0.0, 0.99, 100), 0.999)
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; bytes.split() parts at ASCII white space alone."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    keys = h[:n].copy()
    for k in range(1, min(size, len(h))):
        keys = keys * P1 + h[k : k + n]
    keys ^= keys >> np.uint64(30)
    keys *= P2
    keys ^= keys >> np.uint64(27)
    keys *= P3
    return np.unique(keys ^ (keys >> np.uint64(31)))


def sketches(sets: list[np.ndarray], block: int = 32_768) -> np.ndarray:
    """Registers of non-empty sets, a row of M bytes for each."""
    out, start = np.empty((len(sets), M), np.uint8), 0
    while start < len(sets):
        end, n = start, 0
        while end < len(sets) and (end == start or n + len(sets[end]) <= block):
            n, end = n + len(sets[end]), end + 1
        values = np.concatenate(sets[start:end])
        at = np.cumsum([0, *(len(s) for s in sets[start : end - 1])])
        least = np.empty((M, end - start), np.uint64)
        buffer = np.empty_like(values)
        for i in range(M):
            np.multiply(values, FACTORS[i], out=buffer)
            buffer += OFFSETS[i]
            least[i] = np.minimum.reduceat(buffer, at)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[start:end] = np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, 255).T.astype(np.uint8)
        start = end
    return out


def log_likelihood(more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of registers that are larger and smaller in u than in v, for sets of known sizes.

    Returns the log-likelihood at GRID (pairs by grid points; -inf where sizes forbid) and at SIMILARITY."""
    u = (n_u / (n_u + n_v))[:, None]
    v = 1 - u

    def at(j: np.ndarray) -> np.ndarray:
        only_u, only_v = u - v * j, v - u * j
        p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / math.log(BASE)
        a, b = p(only_u), p(only_v)
        rest = np.clip(1 - a - b, 1e-9, 1)
        value = more[:, None] * np.log(a) + less[:, None] * np.log(b) + (M - more - less)[:, None] * np.log(rest)
        return np.where((only_u < -1e-9) | (only_v < -1e-9), -np.inf, value)

    return at(GRID[None, :]), at(np.array([[SIMILARITY]]))[:, 0]


def may_link(one: np.ndarray, others: np.ndarray, n_one: np.ndarray, n_others: np.ndarray) -> np.ndarray:
    """Which pairs of register rows the likelihood doesn't rule out; `one` is a row, or a row for each."""
    out = (one == others).sum(1) >= LEAST_EQUAL
    at = np.flatnonzero(out)
    if len(at):
        mine = one[at] if one.ndim == 2 else one
        n_mine = np.broadcast_to(np.asarray(n_one, float), (len(others),))[at]
        grid, there = log_likelihood((mine > others[at]).sum(1), (mine < others[at]).sum(1), n_mine, n_others[at].astype(float))
        best = grid.argmax(1)
        out[at] = (GRID[best] >= SIMILARITY) | (grid[np.arange(len(at)), best] - there <= CUTOFF)
    return out


def search_outwards(sizes: np.ndarray, linked, percent: int = round(100 * SIMILARITY)) -> list[tuple[int, int]]:
    """A forest of links over ascending sizes; linked(one, others) tells which of the others link to one.

    Only sizes that allow the similarity are compared, and nothing that is in a tree already."""
    open_, links = np.ones(len(sizes), bool), []
    for seed in range(len(sizes)):
        if not open_[seed]:
            continue
        open_[seed], frontier = False, [seed]
        while frontier:
            one = frontier.pop()
            low = np.searchsorted(sizes, -(-percent * sizes[one] // 100), "left")
            high = np.searchsorted(sizes, 100 * sizes[one] // percent, "right")
            others = np.flatnonzero(open_[low:high]) + low
            for k in range(0, len(others), 1024):
                found = linked(one, others[k : k + 1024])
                open_[found] = False
                frontier += found.tolist()
                links += [(one, int(j)) for j in found]
    return links


def exact_links(one: int, others: np.ndarray, sets: list[np.ndarray], regs: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the others link to one: by registers, then on the full sets."""
    some = others[may_link(regs[one], regs[others], sizes[one], sizes[others])]
    if not len(some):
        return some
    mine, values = sets[one], np.concatenate([sets[j] for j in some])
    place = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
    common = np.add.reduceat((mine[place] == values).astype(np.int64), np.cumsum([0, *sizes[some[:-1]]]))
    return some[100 * common >= percent * (sizes[one] + sizes[some] - common)]


def confirmed_links(sets: list[np.ndarray], percent: int = round(100 * SIMILARITY)) -> list[tuple[int, int]]:
    """A forest of confirmed links whose trees are the components of all links among the sets."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[k] for k in order]
    sizes, regs = np.array([len(s) for s in sets]), sketches(sets)
    found = search_outwards(sizes, lambda one, others: exact_links(one, others, sets, regs, sizes, percent), percent)
    return [(int(order[a]), int(order[b])) for a, b in found]


def links_across(mine: list[np.ndarray], theirs: list[np.ndarray], percent: int = round(100 * SIMILARITY)) -> list[tuple[int, int]]:
    """All confirmed links between two lists of sets, as (place in mine, place in theirs)."""
    if not mine or not theirs:
        return []
    order = np.argsort([len(s) for s in theirs], kind="stable")
    sets = [*(theirs[k] for k in order), *mine]
    sizes, regs, n, out = np.array([len(s) for s in sets]), sketches(sets), len(theirs), []
    for one in range(n, len(sets)):
        low = np.searchsorted(sizes[:n], -(-percent * sizes[one] // 100), "left")
        high = np.searchsorted(sizes[:n], 100 * sizes[one] // percent, "right")
        out += [(one - n, int(order[j])) for j in exact_links(one, np.arange(low, high), sets, regs, sizes, percent)]
    return out


def likely_links(sizes: np.ndarray, regs: np.ndarray) -> list[tuple[int, int]]:
    """The same, by registers alone."""
    order = np.argsort(sizes, kind="stable")
    sizes, regs = sizes[order], regs[order]
    found = search_outwards(sizes, lambda one, others: others[may_link(regs[one], regs[others], sizes[one], sizes[others])])
    return [(int(order[a]), int(order[b])) for a, b in found]


def stars(n: int, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(member, least member) for each member of a tree of links but the least."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [(k, find(k)) for k in range(n) if find(k) != k]


def digest(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found) if len(found) else None


def sketch_documents(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (digest of the set; null if empty) and regs of every whole text."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column(1)]
            full = [s for s in sets if len(s)]
            regs = iter(sketches(full)) if full else iter(())
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "text_hash", "n_shingles", "node", "regs"])

    return map_arrow(id_and_text(docs, F.xxhash64("text").alias("text_hash")), run, "doc_id long, text_hash long, n_shingles long, node binary, regs binary")


def in_block_pairs(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """rows (group, node, blocks, ...) with `task`: one for a group of one block, else one for each pair of blocks.

    A row of block i goes to the tasks of (i, j) for all other j; a block meets itself in any of them."""
    mine = F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    spread = rows.withColumn("__mine", mine).withColumn("__k", F.explode(F.sequence(F.lit(0), F.greatest(F.col(blocks).cast("int") - 2, F.lit(0)))))
    other = F.when(F.col("__k") >= F.col("__mine"), F.col("__k") + 1).otherwise(F.col("__k"))
    task = F.when(F.col(blocks) == 1, F.xxhash64(group)).otherwise(F.xxhash64(group, F.least("__mine", other), F.greatest("__mine", other)))
    return spread.withColumn("task", task).drop("__mine", "__k")


def candidate_components(classes: DataFrame) -> DataFrame:
    """node and root: components of the likely links within buckets."""
    keys = classes.select("node", F.explode(F.array(*(F.xxhash64(F.lit(k), F.substring("regs", k * ROWS + 1, ROWS)) for k in range(BANDS)))).alias("bucket"))
    buckets = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("same"), F.min("node").alias("least")).where("n > 1")
    buckets = buckets.groupBy("n", "same", "least").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / BUCKET_BLOCK).alias("blocks"))
    members = in_block_pairs(keys.join(buckets.hint("merge"), "bucket"), "bucket", "blocks").select("task", "bucket", "node")
    rows = members.join(classes.select("node", "n_shingles", "regs"), "node").select("task", "bucket", "node", "n_shingles", "regs")
    dealt = rows.repartition("task", "bucket").sortWithinPartitions("task", "bucket", "node")

    def run(batches):
        key, group, pairs, out = None, [], [], []

        def settle():
            """Groups of two, by far the most, are judged together."""
            if pairs:
                regs = np.frombuffer(b"".join(r for p in pairs for _, _, r in p), np.uint8).reshape(-1, 2, M)
                sizes = np.array([[n for _, n, _ in p] for p in pairs])
                fit = 100 * sizes.min(1) >= round(100 * SIMILARITY) * sizes.max(1)
                good = may_link(regs[:, 0], regs[:, 1], sizes[:, 0], sizes[:, 1]) & fit
                out.extend((pairs[k][1][0], pairs[k][0][0]) for k in np.flatnonzero(good))
                pairs.clear()

        def close():
            if len(group) == 2:
                pairs.append(tuple(group))
            elif len(group) > 2:
                regs = np.frombuffer(b"".join(r for _, _, r in group), np.uint8).reshape(-1, M)
                links = likely_links(np.array([n for _, n, _ in group]), regs)
                out.extend((group[a][0], group[b][0]) for a, b in stars(len(group), links))

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["a", "b"])
            out.clear()
            return batch

        for batch in batches:
            for t, b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (t, b) != key:
                    close()
                    key, group = (t, b), []
                group.append(tuple(row))
            if len(pairs) >= 4096:
                settle()
            yield made()
        close()
        settle()
        yield made()

    dealt.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    return components(dealt.mapInArrow(run, "a binary, b binary"))


def links_of(a: list[bytes], b: list[bytes], whole: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([whole] * len(a), pa.bool_())], names=["a", "b", "whole"])


LINKS = "a binary, b binary, whole boolean"


def links_in_groups(rows: DataFrame, read, whole: bool) -> DataFrame:
    """Links within each (task, root) of rows (task, root, node, value); read(value) gives a set, or None."""

    def run(batches):
        key, nodes, sets = None, [], []

        def done():
            found = stars(len(nodes), confirmed_links(sets)) if len(sets) > 1 else []
            return links_of([nodes[a] for a, _ in found], [nodes[b] for _, b in found], whole)

        for batch in batches:
            for task, root, node, value in zip(*batch.columns, strict=True):
                group, node = (task.as_py(), root.as_py()), node.as_py()
                if group != key:
                    yield done()
                    key, nodes, sets = group, [], []
                if not nodes or nodes[-1] != node:
                    found = read(value.as_py(), node)
                    if found is not None:
                        nodes.append(node)
                        sets.append(found)
        yield done()

    dealt = rows.select("task", "root", "node", "value").repartition("task", "root").sortWithinPartitions("task", "root", "node")
    return map_arrow(dealt, run, LINKS)


def links_between(rows: DataFrame) -> DataFrame:
    """Links in each (task, root) of rows (task, root, outside, node, value) between those outside and the others."""

    def run(batches):
        key, nodes, sets = None, ([], []), ([], [])

        def done():
            found = links_across(sets[1], sets[0])
            found = [(nodes[1][a], nodes[0][b]) for a, b in found if nodes[1][a] != nodes[0][b]]
            return links_of([max(x) for x in found], [min(x) for x in found], False)

        for batch in batches:
            for task, root, outside, node, value in zip(*batch.columns, strict=True):
                group, side = (task.as_py(), root.as_py()), int(outside.as_py())
                if group != key:
                    yield done()
                    key, nodes, sets = group, ([], []), ([], [])
                nodes[side].append(node.as_py())
                sets[side].append(np.frombuffer(value.as_py(), np.uint64))
        yield done()

    dealt = rows.select("task", "root", "outside", "node", "value").repartition("task", "root").sortWithinPartitions("task", "root")
    return map_arrow(dealt, run, LINKS)


def large_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of large components. members: node, root, blocks; sets: node and value, each once.

    First within blocks that share pivots, then between what the largest group leaves and all."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    pivots = members.groupBy("root", F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(PIVOTS)).alias("k")).agg(F.min("node").alias("node"), F.first("blocks").alias("blocks"))
    places = members.select("node", "root", mine.alias("task")).unionByName(pivots.select("node", "root", every.alias("task")))
    first = cut(links_in_groups(sets.join(places.hint("merge"), "node"), lambda value, node: np.frombuffer(value, np.uint64), False), "first-links")
    group = components(first.select("a", "b"))
    grouped = cut(members.join(group.withColumnRenamed("root", "g"), "node", "left").withColumn("g", F.coalesce("g", "node")), "grouped")
    largest = grouped.groupBy("root", "g").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("g", F.struct("n", "g")).alias("main"))
    outside = grouped.join(largest, "root").where("g <> main").select("node", "root", "blocks")
    parts = cut(outside.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "parts")
    if parts.isEmpty():
        return first
    beside = grouped.select("node", "root", "blocks").join(parts, "root")
    some = F.pmod(F.xxhash64(F.lit(2), "node"), F.col("parts")).cast("int")
    all_ = beside.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).select("node", "root", F.xxhash64(mine, "part").alias("task"), F.lit(False).alias("outside"))
    rest = outside.join(parts, "root").withColumn("block", every).select("node", "root", F.xxhash64("block", some).alias("task"), F.lit(True).alias("outside"))
    return first.unionByName(links_between(sets.join(all_.unionByName(rest).hint("merge"), "node")))


def confirmed(docs: DataFrame, classes: DataFrame, candidates: DataFrame, size: int = SHINGLE) -> DataFrame:
    """a, b and whole: each class and the least one that it's linked to, by way of others or not.

    whole: the candidate component was one task, so b is final; else links of several tasks add up."""
    members = cut(candidates.join(classes.select("node", "doc_id", "n_shingles"), "node"), "members")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = members.join(sizes, "root")
    texts = id_and_text(docs).join(dealt.select("doc_id", "node", "root", "blocks").hint("merge"), "doc_id")

    def own(text: str, node: bytes) -> np.ndarray | None:
        found = shingles(text, size)
        return found if digest(found) == node else None  # a doc_id may have other texts

    small = links_in_groups(texts.where("blocks = 1").select(F.lit(0).alias("task"), "root", "node", F.col("text").alias("value")), own, True)
    large = cut(dealt.where("blocks > 1").select("node", "doc_id", "root", "blocks"), "large")
    if large.isEmpty():
        return small

    def written(batches):
        for batch in batches:
            found = [own(text.as_py(), node.as_py()) for text, node in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x if x is None else x.tobytes() for x in found], pa.binary())], names=["node", "value"])

    kept = id_and_text(docs).join(large.select("doc_id", "node"), "doc_id")  # broadcast only if its measured size allows
    sets = cut(map_arrow(kept.select("text", "node"), written, "node binary, value binary").where("value is not null").groupBy("node").agg(F.first("value").alias("value")), "sets")
    return small.unionByName(large_links(large.drop("doc_id"), sets))


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, component_id and kept of every row.

    Small tables are written on the way: sketches, classes, members, edges and links; texts are
    shuffled once, for confirmation."""
    rows = cut(sketch_documents(docs, size), "sketches")
    classes = cut(rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")), "classes")
    links = cut(confirmed(docs, classes, candidate_components(classes), size), "links")
    roots = links.where("whole").select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    parts = links.where("not whole").select("a", "b")
    if not parts.isEmpty():
        roots = roots.unionByName(components(parts))
    linked = cut(roots.join(classes.select("node", F.col("doc_id").alias("least")), "node"), "linked")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = linked.join(named, "root").select("node", "component_id")
    alone = classes.join(by_node, "node", "left").select("node", F.coalesce("component_id", F.col("doc_id")).alias("component_id"))
    out = rows.drop("regs").join(alone, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", F.col("doc_id"))))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "node", "text_hash")


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """All columns of docs; of each component the rows of its least doc_id stay, repeated rows once.

    Decisions hold for a doc_id with a text: its other texts stay, or go, with their own groups."""
    found = cut(near_duplicates(docs, size), "near")
    dropped = found.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = (docs["doc_id"] == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    rest = docs.join(dropped.hint("merge"), same, "left_anti")  # dropped grows: one plan at every size
    twice = found.where("kept and doc_id is not null and node is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return rest
    return rest.join(twice, "doc_id", "left_anti").unionByName(rest.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("node", "text_hash")
