"""Operator 2: a quality classifier as a sparse ensemble of rules.

Small trees are boosted on statistics of the labelled sample's texts. Every path from a root to a
node is a conjunctive rule; a lasso logistic fit keeps few of them; what it keeps is compiled into
one Spark column over the statistics, so scoring evaluates inside code generation.

Null and empty texts have statistics of zero and are scored like any other. Each row is scored by
itself, so rows that repeat a doc_id are scored each by its own text, and learned from each. Without labels of both
kinds the score is the share of labels that are 1 (0.5 without any label).
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, map_arrow, table
from ledgerloom.llm.learning import id_bucket, labelled_documents, sigmoid

#: Labelled documents of each class that are fitted on.
SAMPLE = 2000
FOLDS, THRESHOLD = 5, 0.3
TREES, DEPTH, BINS, LEAST, SHRINK = 24, 3, 32, 12, 0.3
#: Penalties tried, strongest first; held-out rows of the sample choose.
PENALTIES = (0.01, 0.004, 0.001)

STATISTICS = (
    "chars", "words", "word_chars", "upper_share", "digit_share", "symbol_share", "bang_share", "pipe_share", "stop_share",
    "letter_share", "space_share", "line_words", "duplicate_lines", "distinct_words", "top_word", "upper_words", "symbol_words", "pair_repeats",
)

#: Which bytes count for what; bytes over 127 count as letters.
CLASSES = np.zeros((256, 8))
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~_=+{}[]\\", b"!?", b"|", b".,;:", None, b" \t\n\r\x0b\x0c")):
    CLASSES[list(_bytes) if _bytes else [*range(65, 91), *range(97, 123), *range(128, 256)], _k] = 1
MARKED = re.compile(r"[#*$%&|<>]")


def statistics_of(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    shares = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES / n).tolist()
    words = text.split()
    m = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    shouted = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
    marked = sum(c for w, c in counts.items() if MARKED.search(w)) if shares[2] or shares[4] else 0
    pairs = len(set(zip(words, words[1:])))
    return [
        float(len(text)), float(len(words)), (n - shares[7] * n) / m, *shares[:6], *shares[6:8], m / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        len(counts) / m, max(counts.values(), default=0) / m, shouted / m, marked / m, 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
    ]


def with_statistics(texts: DataFrame) -> DataFrame:
    """doc_id, and s: an array of the statistics of each whole text."""

    def run(batches):
        for batch in batches:
            rows = [statistics_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "s"])

    return map_arrow(texts, run, "doc_id long, s array<double>")


#: A condition: (statistic, threshold, above). A rule: conditions that all hold, sorted.
Condition = tuple[int, float, bool]
Rule = tuple[Condition, ...]


@dataclass
class Ensemble:
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def column(self, s: Column) -> Column:
        """The score as a Spark expression over the array of statistics."""
        parts = [F.when(functools.reduce(lambda a, b: a & b, [(s[k] > t) if above else (s[k] <= t) for k, t, above in rule]), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in zip(self.rules, self.weights, strict=True)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-functools.reduce(lambda a, b: a + b, parts, F.lit(self.bias))))

    def text(self) -> list[str]:
        """The rules, heaviest first, to be read."""
        said = lambda rule: " and ".join(f"{STATISTICS[k]} {'>' if above else '<='} {t:.4g}" for k, t, above in rule)
        return [f"{w:+.3f} if {said(r)}" for r, w in sorted(zip(self.rules, self.weights, strict=True), key=lambda x: -abs(x[1]))]


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for k, t, above in rule:
            out[:, j] *= (x[:, k] > t) if above else (x[:, k] <= t)
    return out


def grow(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule, found: set[Rule], out: np.ndarray) -> None:
    """One regression tree; adds each node's path to found and each leaf's mean to out."""
    if path:
        found.add(tuple(sorted(path)))
    best, base = (1e-9, 0, 0.0), residual[rows].sum() ** 2 / len(rows)
    if depth and len(rows) >= 2 * LEAST:
        for k, values in enumerate(cuts):
            if not len(values):
                continue
            bins = np.searchsorted(values, x[rows, k], "left")
            n = np.cumsum(np.bincount(bins, minlength=len(values) + 1))[:-1]
            total = np.cumsum(np.bincount(bins, residual[rows], len(values) + 1))[:-1]
            ok = (n >= LEAST) & (len(rows) - n >= LEAST)
            gain = np.where(ok, total**2 / np.maximum(n, 1) + (residual[rows].sum() - total) ** 2 / np.maximum(len(rows) - n, 1) - base, -1)
            if gain.max() > best[0]:
                best = (float(gain.max()), k, float(values[int(gain.argmax())]))
    if best[0] <= 1e-9:
        out[rows] = residual[rows].mean()
        return
    _, k, t = best
    left = x[rows, k] <= t
    for part, above in ((rows[left], False), (rows[~left], True)):
        grow(x, residual, part, cuts, depth - 1, (*path, (k, t, above)), found, out)


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees, each grown on a random half of the rows."""
    rng, found = np.random.default_rng(7), set()
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    score = np.full(len(y), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(TREES):
        rows = np.sort(rng.permutation(len(y))[: max(len(y) // 2, min(len(y), 4 * LEAST))])
        step, paths = np.zeros(len(y)), set()
        grow(x, y - sigmoid(score), rows, cuts, DEPTH, (), paths, step)
        score += SHRINK * 4 * step
        found |= paths
    return sorted(found)


def fit_lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None) -> np.ndarray:
    """Weights with the bias last: logistic loss plus penalty times the sum of |weights|, by accelerated proximal steps."""
    z = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(z.shape[1]) if start is None else start.copy()
    size = 4 * len(y) / max(float(np.linalg.eigvalsh(z.T @ z)[-1]), 1e-9)
    ahead, t = w.copy(), 1.0
    for _ in range(250):
        new = ahead - size * (z.T @ (sigmoid(z @ ahead) - y)) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * penalty, 0)
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (last - 1) / t * (new - w)
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """x: statistics by row; y: 0 or 1. A fifth of the rows, if there are 300, chooses the penalty."""
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Ensemble(bias=math.log((share + 1e-6) / (1 - share + 1e-6)))
    rules = extract_rules(x, y)
    z = holds(rules, x)
    kept, seen = [], set()
    for j in range(z.shape[1]):  # rules that hold on the same rows, or nearly all or none, add nothing
        key = z[:, j].tobytes()
        if key not in seen and LEAST <= z[:, j].sum() <= len(y) - LEAST:
            seen.add(key)
            kept.append(j)
    rules, z = [rules[j] for j in kept], z[:, kept]
    held = np.arange(len(y)) % 5 == 0 if len(y) >= 300 else np.zeros(len(y), bool)
    penalty, w = PENALTIES[1], None
    if held.any():
        losses = []
        for p in PENALTIES:
            w = fit_lasso(z[~held], y[~held], p, w)
            q = np.clip(sigmoid(z[held] @ w[:-1] + w[-1]), 1e-6, 1 - 1e-6)
            losses.append(-np.mean(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q)))
        penalty = PENALTIES[int(np.argmin(losses))]
    w = fit_lasso(z, y, penalty, w)
    used = np.flatnonzero(np.abs(w[:-1]) > 1e-4)
    return Ensemble([rules[j] for j in used], w[used].tolist(), float(w[-1]))


def fit_on(docs: DataFrame, labels: DataFrame) -> Ensemble:
    """From labelled documents outside the held-out fold; only statistics reach the driver.

    Classes are sampled apart, so the fit is weighted back to their shares among all labels."""
    usable = id_bucket(F.col("doc_id"), FOLDS) != 0
    texts = labelled_documents(docs, labels, "quality", usable, SAMPLE, F.coalesce("text", F.lit("")).alias("text"))
    found: dict[int, list] = {0: [], 1: []}
    # y travels in the low bit of the key: the statistics see the text alone
    keyed = texts.select((F.xxhash64("doc_id", "text").bitwiseAND(F.lit(-2)) + F.col("y")).alias("doc_id"), "text")
    for key, s in with_statistics(keyed).orderBy("doc_id").toLocalIterator():
        found[key & 1].append(s)
    x, y = np.array(found[0] + found[1], float).reshape(-1, len(STATISTICS)), np.array([0.0] * len(found[0]) + [1.0] * len(found[1]))
    order = np.random.default_rng(3).permutation(len(y))
    ensemble = fit(x[order], y[order])
    share = labels.where(F.col("quality").isNotNull() & usable).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    if ensemble.rules and share and 0 < share < 1:
        ensemble.bias += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return ensemble


def score(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    scored = with_statistics(id_and_text(docs)).select("doc_id", (id_bucket(F.col("doc_id"), FOLDS) == 0).alias("held_out"), ensemble.column(F.col("s")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """All columns of the rows that aren't rejected, texts and nulls unchanged.

    Statistics are joined to no row: they are computed beside the row's own columns."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            rows = [statistics_of(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*(f"c{k}" for k in range(len(names))), "s"])

    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    schema = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)) + ", s array<double>"
    return map_arrow(plain, run, schema).where(ensemble.column(F.col("s")) >= THRESHOLD).drop("s").toDF(*names)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_on(docs, table(spark, sf_dir, "labels")))
