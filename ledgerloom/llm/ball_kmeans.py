"""Operator 11: centroid clustering by ball k-means, in whole numbers.

A cluster is a ball: its centroid, and a radius that no member lies beyond. j is a neighbour of i
only if half the distance of their centroids is within i's radius; no member of i can be nearer to
any other. Neighbours are put in order of distance. A member nearer to its centroid than half the
way to the nearest neighbour is in the ball's stable core and stays. The rest lie in annuli: whoever is
beyond half the way to the n-th neighbour and not beyond that to the next is compared, exactly, with n
centroids. A cluster whose centroid and whose neighbours' centroids haven't moved keeps its members
unseen. "Half the way" counts as beyond where equal, since ties go to the smaller number.

Components become floor(1024 * x), distances are squared and exact in 64 bits, and centroids are
exact floors of means, so no order of rows or tasks changes a result.

A round reads the vectors with their clusters and writes them anew in one pass; the last rows of a
task are its partial sums, one for each cluster, which Parquet reads without the vectors. What
reaches the driver is `k` centroids, sizes and radii; a radius is the largest distance to the former
centroid, plus how far that moved. No vector is shuffled, so neither copies nor large clusters
meet in a task, and a lost executor costs its tasks of one round. Rounds end early once no centroid
moves, as all later ones would repeat it.

Vectors that are null, that have another number of components, or null, non-finite or too large ones
(131,072 or more: a squared distance might leave 64 bits) take no part. Repeated rows, and rows that
share a vec_id, are vectors of their own, each with a row in the result; rows without a vec_id are
clustered but can't begin as centroids. Rows alike in vec_id begin in order of their components.
Fewer vectors than `k` make fewer clusters, none an empty result. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, table

K, ROUNDS, DIMENSION, SCALE = 8, 10, 64, 1024
#: Whole components stay below this, so squared distances stay below 2 ** 62.
LARGEST = 1 << 27
STATE = "vec_id long, v array<int>, cluster int, distance long, sums array<long>, n long"


def whole_vectors(rows: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """vec_id and v, whole components, of the rows that take part."""
    e = F.col("embedding")
    proper = (F.size(e) == dimension) & F.forall(e, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST / SCALE))
    whole = F.transform(e, lambda x: F.floor(SCALE * x.cast("double")).cast("int"))
    return rows.where(F.coalesce(proper, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, salt: str = "3") -> np.ndarray:
    """The vectors whose SHA-256 of `salt:vec_id` is smallest, in that order."""
    ranked = vectors.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return np.array([r.v for r in ranked.orderBy("h", "v").limit(k).collect()], np.int64)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = x - centroid
    return np.einsum("ij,ij->i", gap, gap)


class Balls:
    """Centroids with what a task needs of the others: for each, its neighbours' distances and numbers, nearest first."""

    def __init__(self, centroids: np.ndarray, radii: list[int | None], moved: np.ndarray):
        """radii: bounds on members' distances (None: unknown); moved: whether a centroid differs from the one of the round before."""
        self.centroids, self.rings, self.still = centroids, [], []
        for i, (centroid, radius) in enumerate(zip(centroids, radii, strict=True)):
            apart = squared(centroids, centroid)
            ring = sorted((int(d), j) for j, d in enumerate(apart) if j != i and (radius is None or int(d) <= 4 * radius * radius))
            # a quarter of the squared distance, rounded up: reached by squared distances from there on
            self.rings.append((np.array([-(-d // 4) for d, _ in ring], np.int64), [j for _, j in ring]))
            self.still.append(radius is not None and not moved[i] and not any(moved[j] for _, j in ring))

    def assign(self, v: np.ndarray, own: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid and squared distance of each row, from those of the round before."""
        own, distance = own.copy(), distance.copy()
        for i in np.unique(own):
            if self.still[i]:
                continue
            rows = np.flatnonzero(own == i)
            x, (halfway, ring) = v[rows], self.rings[i]
            nearest, least = np.full(len(rows), i, own.dtype), squared(x, self.centroids[i])
            annulus = np.searchsorted(halfway, least, side="right")  # 0: the stable core
            for n, j in enumerate(ring, 1):
                meets = np.flatnonzero(annulus >= n)
                if not len(meets):
                    break
                d = squared(x[meets], self.centroids[j])
                nearer = (d < least[meets]) | ((d == least[meets]) & (j < nearest[meets]))
                nearest[meets[nearer]], least[meets[nearer]] = j, d[nearer]
            own[rows], distance[rows] = nearest, least
        return own, distance


def assigned(state: DataFrame, balls: Balls) -> DataFrame:
    """The vectors with their new clusters, and partial sums of each task behind them (v null; distance: the largest)."""
    k, dimension = balls.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes, far = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, dimension)
            own, distance = balls.assign(v, batch.column("cluster").to_numpy(), batch.column("distance").to_numpy())
            for i in np.unique(own):
                mine = own == i
                sums[i] += v[mine].sum(0)
                sizes[i] += mine.sum()
                far[i] = max(far[i], distance[mine].max())
            blank = [pa.nulls(len(v), pa.list_(pa.int64())), pa.nulls(len(v), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own, pa.int32()), pa.array(distance), *blank], names=NAMES)
        some = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.list_(pa.int32())), pa.array(some, pa.int32()), pa.array(far[some]), pa.array(list(sums[some]), pa.list_(pa.int64())), pa.array(sizes[some])], names=NAMES)

    return state.where("v is not null").select("vec_id", "v", "cluster", "distance").mapInArrow(run, STATE)


NAMES = [field.split()[0] for field in STATE.split(", ")]


def totals(state: DataFrame) -> dict[int, tuple[list[int], int, int]]:
    """Of each cluster that has members: component sums, size, largest squared distance. k * dimension rows, whatever the size."""
    parts = state.where("sums is not null").select("cluster", "n", "distance", F.posexplode("sums").alias("at", "x"))
    rows = parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x"), F.sum("n").alias("n"), F.max("distance").alias("far")).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r.cluster, r["at"])):
        out.setdefault(r.cluster, ([], r.n, r.far))[0].append(int(r.x))
    return out


def ball_kmeans(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, salt: str = "3") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector, and the centroids. vectors: vec_id and v, as whole_vectors makes them."""
    state = cut(vectors.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), "vectors")
    centroids = first_centroids(state, k, salt)
    if not len(centroids):
        return state.select("vec_id", "cluster", "distance").where("false"), centroids
    balls = Balls(centroids, [None] * len(centroids), np.ones(len(centroids), bool))
    for _ in range(rounds):
        state = cut(assigned(state, balls), "assigned", instead_of=state)
        found, new, radii = totals(state), centroids.copy(), [0] * len(centroids)
        for i, (sums, n, far) in found.items():
            new[i] = [x // n for x in sums]
            radii[i] = isqrt(far) + 1 + isqrt(int(squared(new[i : i + 1], centroids[i])[0])) + 1
        moved = (new != centroids).any(1)
        centroids, balls = new, Balls(new, radii, moved)
        if not moved.any():
            break
    else:
        state = cut(assigned(state, balls), "assigned", instead_of=state)
    return state.where("v is not null").select("vec_id", "cluster", "distance"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found with cluster_inertia, inertia (null if beyond a long) and centroid_sha256."""
    spread = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fitting = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()

    def own(values: list[Column]) -> Column:
        return F.element_at(F.array(*values), F.col("cluster") + 1)

    if not len(centroids):
        return found.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    return found.select("*", own([fitting(spread.get(i, 0)) for i in range(len(centroids))]).alias("cluster_inertia"), fitting(sum(spread.values())).alias("inertia"), own([F.lit(digest(c)) for c in centroids]).alias("centroid_sha256"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*ball_kmeans(whole_vectors(table(spark, sf_dir, "embeddings"))))


def sql(k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, salt: str = "3") -> str:
    """The same by comparing every vector with every centroid, for DuckDB."""
    proper = f"len(embedding) = {dimension} and len(list_filter(embedding, lambda x: x is not null and isfinite(x) and abs(x) < {LARGEST // SCALE})) = {dimension}"
    steps = [
        f"kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings where {proper})",
        f"c0 as materialized (select row_number() over (order by sha256('{salt}:' || vec_id), v) - 1 as c, v from kept where vec_id is not null qualify c < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} as materialized (select r, arg_min(c, row(d, c)) as cluster, min(d) as distance from (select r, c, list_sum(list_transform(list_zip(kept.v, c{n}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from kept, c{n}) group by r)")
        if n < rounds:
            steps.append(f"s{n} as (select cluster, i, sum(x) as s, count(*) as m from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as i from a{n} join kept using (r)) group by cluster, i)")
            # a division that rounds down, of whole numbers
            steps.append(f"m{n} as (select cluster, list(cast((s - ((s % m) + m) % m) // m as bigint) order by i) as v from s{n} group by cluster)")
            steps.append(f"c{n + 1} as materialized (select c, coalesce(m{n}.v, c{n}.v) as v from c{n} left join m{n} on c = cluster)")
    return (
        "with " + ",\n".join(steps) + "\n"
        "select vec_id, cast(cluster as integer) as cluster, cast(distance as bigint) as distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,\n"
        f"cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256\n"
        f"from a{rounds} join kept using (r) join c{rounds} on c = cluster"
    )
