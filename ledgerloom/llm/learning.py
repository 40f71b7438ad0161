"""What the trained operators share: labelled samples of bounded size, and logistic fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_bucket(doc_id, buckets: int):
    """crc32 of doc_id as text, modulo buckets; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % buckets


def labelled_ids(labels: DataFrame, label: str, usable, rows: int) -> DataFrame:
    """doc_id and y of at most `rows` labelled ids of each class, the first by a hash of doc_id.

    An id that is labelled more than once counts as 1 if at least half its labels do."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y")).select("doc_id", (F.col("y") >= 0.5).cast("int").alias("y"))
    by_hash = F.xxhash64("doc_id")
    return one.where("y = 1").orderBy(by_hash, "doc_id").limit(rows).unionByName(one.where("y = 0").orderBy(by_hash, "doc_id").limit(rows))


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, usable, rows: int, *columns) -> DataFrame:
    """doc_id, y and the columns of the labelled sample's documents, whatever other columns docs has.

    At most 2 * rows ids are broadcast."""
    ids = labelled_ids(labels.select("doc_id", label), label, usable, rows)
    return docs.select("doc_id", *columns).join(F.broadcast(ids), "doc_id")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights with the intercept last, by Newton's method with an L2 penalty on all but the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
