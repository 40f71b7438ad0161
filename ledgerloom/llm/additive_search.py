"""Operator 5: nearest neighbours by additive quantisation.

A vector is stored as its length and LEVELS codes of its direction, one from each of LEVELS codebooks of
CODES full-dimensional vectors whose sum approximates it. Codebooks are fitted on a bounded sample: by
k-means on residuals, then refined by least squares over all codebooks at once. Encoding is a beam
search over the sums. An inner product is estimated by adding LEVELS entries of the query's lookup
table, times a stored factor that leaves the rest, what the codes miss, orthogonal to the vector; the
rest's length is stored as well. The estimate is off by the query's inner product with the rest, so
every candidate whose estimate, plus the rest's length times the query's reach, comes up to the k-th
best score so far is scored again, exactly and in double precision, on the original vectors.

A query's reach is measured for itself, on rests of sampled vectors that the codebooks weren't fitted
on: the largest of its inner products with their directions, and REACH times their root mean square
at least. Vectors that the codes fit worse than those, and all where there are none, are always scored.

Every vector is indexed, in the coarse cell whose direction is nearest to its own. A query first visits
the cells nearest to it, as many as on the sample hold PROBED of sampled queries' true neighbours, and
more until they hold more than k vectors; then every other cell that can hold a vector above the k-th
best score found, by the largest projections of the cell's vectors on directions between along the
cell's and across it. No cell is left out by an estimate: clustered vectors need few, vectors without
structure all. Cells of more than twice the mean size, or CANDIDATE_BLOCK vectors, are dealt into blocks,
queries into blocks of QUERY_BLOCK, and each pair of blocks is one group of bounded size that returns at most k rows for
each of its queries, from which the nearest k are kept.

Vectors that are null, empty, zero, or that hold null or non-finite components take no part, nor do
rows without an id. Vectors of different dimensions have no inner product: each dimension is searched by
itself. Rows with one vec_id count once, by the least of their vectors of the most common of their
dimensions, so each query has one list and no neighbour twice. Equal scores are
ordered by id, and an id is never its own neighbour.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ledgerloom.llm.common import cut, table

LEVELS, CODES, BEAM, K = 12, 256, 4, 20
#: So many times the root mean square of measured errors is what an estimate may be off, at least.
REACH = 4.0
#: Vectors that codebooks are fitted on, and further ones that errors are measured on, the first by a hash of their ids.
SAMPLE, HELD = 8192, 2048
#: Most vectors of a block, what a block may hold in any case, and most queries of one.
CANDIDATE_BLOCK, LEAST_BLOCK, QUERY_BLOCK = 8_192, 256, 16_384
#: Queries whose lookup tables are held at once.
TABLES = 256
#: Coarse cells, one for 32 vectors of the sample at most; share of true neighbours that the first visited cells hold, and queries that measure it.
CELLS, PROBED, MEASURED = 64, 0.5, 256
#: Directions between along a cell's own and against it, on which its vectors' largest projections are kept.
ANGLES = np.linspace(0, np.pi, 17)
#: What rounding may change, as a share of the lengths.
ROUNDING = 1e-9
QUERY_EVERY = 20


def proper(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, whatever their dimension; components stay as wide as they are."""
    e, kind = F.col("embedding"), rows.schema["embedding"].dataType
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(e, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & ~F.coalesce(bad, F.lit(True)) & some).select(F.col("vec_id").cast("long").alias("vec_id"), (e if isinstance(kind.elementType, FloatType | DoubleType) else e.cast("array<double>")).alias("embedding"))


def nearest_codes(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x @ book.T - 0.5 * (book**2).sum(1)).argmax(1)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes of each row: the best of `beam` partial sums, extended level by level."""
    n, (levels, codes, _) = len(x), books.shape
    residual, kept = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for level in range(levels):
        book = books[level]
        # |r - c|^2 less |r|^2, added to what the partial sum has left
        error = ((residual**2).sum(2)[:, :, None] - 2 * residual @ book.T + (book**2).sum(1)).reshape(n, -1)
        width = min(beam if level < levels - 1 else 1, error.shape[1])
        best = np.argpartition(error, width - 1, axis=1)[:, :width]
        origin, code = best // codes, best % codes
        rows = np.arange(n)[:, None]
        kept = np.concatenate([kept[rows, origin], code[:, :, None].astype(np.uint8)], axis=2)
        residual = residual[rows, origin] - book[code]
    return kept[:, 0]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[k][codes[:, k]] for k in range(len(books)))


def fit_codebooks(sample: np.ndarray, levels: int = LEVELS, codes: int = CODES, rounds: int = 2) -> np.ndarray:
    """levels x codes x dimension. Fewer vectors than codes leave the other entries zero."""
    rng, residual = np.random.default_rng(11), sample.astype(np.float64).copy()
    books = np.zeros((levels, codes, sample.shape[1]))
    for level in range(levels):
        k = min(codes, len(residual))
        book = residual[rng.permutation(len(residual))[:k]].copy()
        for _ in range(8):
            own = nearest_codes(residual, book)
            counts = np.bincount(own, minlength=k)
            sums = np.zeros_like(book)
            np.add.at(sums, own, residual)
            book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        books[level, :k] = book
        residual -= book[nearest_codes(residual, book)]
    for _ in range(rounds):
        used = encode(sample, books).astype(int) + np.arange(levels) * codes
        gram, right = np.eye(levels * codes) * 1e-3, books.reshape(-1, sample.shape[1]) * 1e-3
        for a in range(levels):
            np.add.at(right, used[:, a], sample)
            for b in range(levels):
                np.add.at(gram, (used[:, a], used[:, b]), 1.0)
        books = np.linalg.solve(gram, right).reshape(books.shape)
    return books


def fit_cells(sample: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Unit directions of the cells, by k-means on directions."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    cells = max(1, min(cells, len(x) // 32))
    book = x[np.random.default_rng(13).permutation(len(x))[:cells]].copy()
    for _ in range(10):
        own = (x @ book.T).argmax(1)
        for k in range(cells):
            mean = x[own == k].sum(0)
            if (size := np.linalg.norm(mean)) > 0:
                book[k] = mean / size
    return book


def cells_to_visit(sample: np.ndarray, book: np.ndarray, k: int) -> int:
    """How many cells, in a query's order, hold PROBED of the true neighbours of MEASURED sampled queries."""
    queries = sample[: min(MEASURED, len(sample))]
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1 or len(book) < 2:
        return len(book)
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(queries @ book.T), axis=1, kind="stable"), axis=1)
    ranks = np.take_along_axis(place, own_cell(sample, book)[best], axis=1)
    held = np.array([(ranks < n).mean() for n in range(1, len(book) + 1)])
    return int(np.argmax(held >= PROBED)) + 1


def own_cell(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x @ book.T).argmax(1)


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also of components whose squares a double can't hold."""
    largest = np.maximum(np.abs(x).max(1), np.finfo(float).tiny)
    return largest * np.linalg.norm(x / largest[:, None], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(float).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def factors(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the sums of codes are multiplied by, and what is then missing of the unit vectors x."""
    sums = decode(codes, books)
    along, square = (x * sums).sum(1), (sums**2).sum(1)
    scale = np.where(along > 0.2 * np.sqrt(square), 1 / np.where(along > 0, along, 1), along / np.maximum(square, 1e-300))
    return scale, x - scale[:, None] * sums


def reaches(queries: np.ndarray, rests: np.ndarray) -> np.ndarray:
    """What an estimate for each unit query may be off, as a share of the rest's length; rests are unit vectors."""
    if not len(rests):
        return np.ones(len(queries))
    errors = queries @ rests.T
    return np.clip(np.maximum(errors.max(1), REACH * np.sqrt((errors**2).mean(1))), 1e-3, 1)


def cell_bounds(queries: np.ndarray, book: np.ndarray, supports: np.ndarray) -> np.ndarray:
    """Upper bound of each unit query's inner products with each cell's vectors.

    supports: a row for each cell, the largest projection of its vectors' (part along the cell's
    direction, length of the part across it) on each of ANGLES; -inf where a cell is empty."""
    step = ANGLES[1]
    angle = np.arccos(np.clip(queries @ book.T, -1, 1))
    low = np.minimum((angle / step).astype(int), len(ANGLES) - 2)
    cell, beyond = np.arange(len(book)), angle - low * step
    some = np.where(np.isfinite(supports), supports, 0)
    bound = (np.sin(step - beyond) * some[cell, low] + np.sin(beyond) * some[cell, low + 1]) / np.sin(step)
    return np.where(np.isfinite(supports[:, 0]), bound + 1e-6 * np.abs(some).max(1), -np.inf)


def fewest_copies(vectors: np.ndarray, most: int) -> np.ndarray:
    """Places, ascending, of the first `most` of all equal vectors: no query needs more of them."""
    rows = np.ascontiguousarray(vectors)
    own = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(own, kind="stable")
    first = np.searchsorted(own[order], own[order])
    return np.sort(order[np.arange(len(own)) - first < most])


def search_block(queries: np.ndarray, query_ids: np.ndarray, reach: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray, scale: np.ndarray, rest: np.ndarray, books: np.ndarray, k: int = K) -> tuple[np.ndarray, ...]:
    """Query ids, ids and exact scores of the k best in the block for each query, but for those below its floor.

    ids must ascend. scale and rest are those of whole vectors; floors are scores over the query's length."""
    levels, out = len(books), ([], [], [])
    flat = codes.astype(np.int64) + np.arange(levels) * books.shape[1]
    slack, directions = ROUNDING * lengths(vectors), unit(queries)
    for q, lut in lookup_tables(directions, books):
        estimate = lut[flat[:, 0]]
        for level in range(1, levels):
            estimate += lut[flat[:, level]]
        estimate *= scale
        highest = estimate + reach[q] * rest + slack
        highest[ids == query_ids[q]] = -np.inf
        found = np.flatnonzero((highest >= floor[q]) & (highest > -np.inf))
        if len(found) > 8 * k:  # the best estimates tell what the others must come up to
            best = found[np.argpartition(-estimate[found], 4 * k - 1)[: 4 * k]]
            found = found[highest[found] >= np.partition(vectors[best] @ directions[q] - slack[best], -k)[-k]]
        if len(found) > k:
            rough = vectors[found] @ directions[q]
            found = found[rough + slack[found] >= np.partition(rough - slack[found], -k)[-k]]
        exact = exact_scores(vectors[found], queries[q])
        order = np.lexsort((ids[found], -exact))[:k]
        out[0].append(np.full(len(order), query_ids[q]))
        out[1].append(ids[found][order])
        out[2].append(exact[order])
    return tuple(np.concatenate(x) if x else np.empty(0) for x in out)


def lookup_tables(queries: np.ndarray, books: np.ndarray):
    """(number, table) of each query: its inner products with all entries of all codebooks."""
    flat = books.reshape(-1, books.shape[2]).T
    for k in range(0, len(queries), TABLES):
        yield from enumerate(queries[k : k + TABLES] @ flat, k)


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of components, the same in any block."""
    return np.cumsum(vectors * query, axis=1)[:, -1] if len(vectors) else np.empty(0)


def search(rows: DataFrame, is_query, k: int = K, levels: int = LEVELS, codes: int = CODES) -> DataFrame:
    """query_id, rank, vec_id and score; rows has vec_id and embedding, is_query tells queries by vec_id."""
    vectors, session = proper(rows), rows.sparkSession
    sizes = [r.d for r in vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").collect()]
    if len(sizes) > 1:
        common = F.array_position(F.array(*map(F.lit, sizes)), F.size("embedding"))
        vectors = vectors.groupBy("vec_id").agg(F.min(F.struct(common.alias("nth"), "embedding")).alias("e")).select("vec_id", "e.embedding")
    else:
        vectors = vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    vectors = cut(vectors, "vectors")
    asked = vectors.where(is_query(F.col("vec_id"))).select(F.size("embedding").alias("d")).distinct().collect()
    found = [search_dimension(vectors.where(F.size("embedding") == d), is_query, k, levels, codes) for d in sorted(r.d for r in asked)]
    if not found:
        return session.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def search_dimension(vectors: DataFrame, is_query, k: int, levels: int, codes: int) -> DataFrame:
    """search() among vectors of one dimension, one for each vec_id, of which some are queries."""
    session, result = vectors.sparkSession, "query_id long, vec_id long, score double"
    sample = np.array([r[0] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(SAMPLE + HELD).toLocalIterator()], np.float64)
    sample = sample[fewest_copies(sample, 1)]
    fitted = max(1, len(sample) * SAMPLE // (SAMPLE + HELD))
    sample, directions = sample / np.abs(sample).max(), unit(sample)
    books, cells = fit_codebooks(directions[:fitted], levels, codes), fit_cells(directions[:fitted])
    visited = cells_to_visit(sample[:fitted], cells, k)
    rests = factors(directions[fitted:], encode(directions[fitted:], books), books)[1] if fitted < len(sample) else directions[:0]
    far = np.linalg.norm(rests, axis=1)
    worst = far.max() if len(far) else 0.0
    rests = rests[far > 1e-7] / far[far > 1e-7, None]
    kind = vectors.schema["embedding"].dataType.simpleString()

    def rows_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.array(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch)
                length, x = lengths(x), unit(x)
                packed, own = encode(x, books), own_cell(x, cells)
                scale, missing = factors(x, packed, books)
                rest = np.linalg.norm(missing, axis=1)
                rest = np.where(rest > worst + ROUNDING, np.inf, rest * length)
                along = (x * cells[own]).sum(1)
                across = np.linalg.norm(x - along[:, None] * cells[own], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(scale * length), pa.array(rest), pa.array(own.astype(np.int32)), pa.array(along * length), pa.array(across * length)], names=["vec_id", "embedding", "codes", "scale", "rest", "cell", "along", "across"])

    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    indexed = cut(vectors.mapInArrow(index, f"vec_id long, embedding {kind}, codes binary, scale double, rest double, cell int, along double, across double"), "index")
    # cells are few, and so are their sizes and projections
    projections = [F.max(F.col("along") * float(np.cos(a)) + F.col("across") * float(np.sin(a))).alias(f"p{j}") for j, a in enumerate(ANGLES)]
    stats = indexed.groupBy("cell").agg(F.count("*").alias("n"), *projections).collect()
    sizes, supports = np.zeros(len(cells), np.int64), np.full((len(cells), len(ANGLES)), -np.inf)
    for r in stats:
        sizes[r.cell], supports[r.cell] = r.n, r[2:]

    def ask(batches):
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch)
                length, x = lengths(x), unit(x)
                order = np.argsort(-(x @ cells.T), axis=1, kind="stable")
                bounds = np.take_along_axis(cell_bounds(x, cells, supports), order, axis=1)
                held = np.cumsum(sizes[order], axis=1)
                first = np.maximum((held <= k).sum(1) + 1, visited)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(length), pa.array(reaches(x, rests)), pa.array(first.astype(np.int32)), pa.array([*order.astype(np.int32)], pa.list_(pa.int32())), pa.array([*bounds], pa.list_(pa.float64()))], names=["vec_id", "embedding", "length", "reach", "first", "cells", "bounds"])

    asked = cut(indexed.where(is_query(F.col("vec_id"))).select("vec_id", "embedding").mapInArrow(ask, f"vec_id long, embedding {kind}, length double, reach double, first int, cells array<int>, bounds array<double>"), "asked")
    block = min(CANDIDATE_BLOCK, max(LEAST_BLOCK, 2 * int(sizes.sum()) // len(stats)))  # so that no group is much larger than others
    blocks = {r.cell: -(-r.n // block) for r in stats}
    n_asked = max(1, -(-asked.count() // QUERY_BLOCK))
    of_cell = F.create_map(*(F.lit(x) for kv in blocks.items() for x in kv))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    none = lambda kind: F.lit(None).cast(kind)
    candidates = indexed.select("cell", place(of_cell[F.col("cell")]).alias("block"), copies(F.lit(n_asked)).alias("part"), F.lit(False).alias("asked"), "vec_id", "embedding", none("double").alias("reach"), none("double").alias("floor"), "codes", "scale", "rest")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("vec_id", "ascending")])
        asked = group["asked"].to_numpy()
        mine, theirs = np.flatnonzero(asked), np.flatnonzero(~asked)
        if not len(mine) or not len(theirs):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, x = group["vec_id"].to_numpy(), np.array(group["embedding"].combine_chunks().flatten(), np.float64).reshape(group.num_rows, -1)
        theirs = theirs[fewest_copies(x[theirs], k + 1)]
        column = lambda name, at: group[name].to_numpy()[at].astype(np.float64)
        codes = np.frombuffer(b"".join(group["codes"].take(pa.array(theirs)).to_pylist()), np.uint8).reshape(len(theirs), -1)
        q, v, s = search_block(x[mine], ids[mine], column("reach", mine), column("floor", mine), x[theirs], ids[theirs], codes, column("scale", theirs), column("rest", theirs), books, k)
        return pa.table({"query_id": pa.array(q.astype(np.int64)), "vec_id": pa.array(v.astype(np.int64)), "score": pa.array(s.astype(np.float64))})

    def visit(sent: DataFrame) -> DataFrame:
        """The k nearest in the cells that queries are sent to."""
        sent = sent.withColumn("n", of_cell[F.col("cell")]).where("n is not null")
        queries = sent.select("cell", copies(F.col("n")).alias("block"), place(F.lit(n_asked)).alias("part"), F.lit(True).alias("asked"), "vec_id", "embedding", "reach", "floor", none("binary").alias("codes"), none("double").alias("scale"), none("double").alias("rest"))
        return candidates.unionByName(queries).groupBy("cell", "block", "part").applyInArrow(run, result)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = lambda found: found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    near = cut(ranked(visit(asked.withColumn("floor", F.lit(float("-inf"))).withColumn("cell", F.explode(F.slice("cells", F.lit(1), F.col("first")))))), "near")
    # a little lower, for rounding; none where fewer than k were found, or where the score is beyond doubles
    last = near.where((F.col("rank") == k) & (F.abs("score") < float("inf"))).select(F.col("query_id").alias("vec_id"), "score")
    floor = F.col("score") / F.col("length")
    floored = asked.join(last, "vec_id", "left").withColumn("floor", F.coalesce(floor - ROUNDING * F.abs(floor), F.lit(float("-inf"))))
    rest = floored.select("vec_id", "embedding", "reach", "floor", "first", F.posexplode(F.arrays_zip("cells", "bounds")).alias("nth", "c")).where((F.col("nth") >= F.col("first")) & (F.col("c.bounds") >= F.col("floor")))
    others = visit(rest.select("vec_id", "embedding", "reach", "floor", F.col("c.cells").alias("cell")))
    return ranked(near.drop("rank").unionByName(others))


def op5_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % QUERY_EVERY == 0)
