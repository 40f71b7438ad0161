"""Operator 1: toxicity by compression distance.

zstandard trains a dictionary on ordinary and one on toxic text of the labelled sample. Each window
of WINDOW words is compressed with both; what the toxic dictionary saves is the window's margin,
and a document's counts of margins above several thresholds, weighted by a logistic fit, its score.

What is trained on what:

    base      by zstandard, on windows of ordinary texts; both dictionaries begin with it, so that
              both compress ordinary text alike
    ordinary  base, then a dictionary that zstandard trains on short windows of ordinary texts
    toxic     base, then a dictionary that zstandard trains on the marking runs of toxic texts: runs
              of five-byte strings that are NOVEL times as frequent in toxic documents. (Trained on
              whole toxic texts it mostly holds the ordinary words they too consist of; README has
              figures.)

zstandard stores a short block as it is unless compression gains some bytes, and looks for no match
in a block's last eight bytes. Every window therefore stands between ANCHOR, which both dictionaries
hold, and TAIL, which neither does: lengths are then linear in what the window itself saves.

Weights are fitted on margins by dictionaries that haven't seen the document: the sample is halved,
and each half is judged by dictionaries of the other. The dictionaries in use are trained on all of
it. The driver gets the sample's ordinary windows and marking runs, all of them (SAMPLE bounds rows,
so nothing of a row is left out); counts of strings and margins are computed where the texts are.

Null and empty texts have one empty window, no margin, and the score that goes with it. Rows that
repeat a doc_id are scored each by its own text, and learned from each. Without PER_HALF labels of
each kind in each half every score is the share of toxic labels (0 without any label).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, id_and_text, map_arrow, table
from ledgerloom.llm.learning import fit_logistic, id_bucket, labelled_documents, sigmoid

#: Labelled documents of each class that are learned from, each with its whole text.
SAMPLE = 4000
#: Bytes of a training sample; what is longer is trained on in parts.
SAMPLE_BYTES = 4096
#: Words of a scored window, and of the windows that base and ordinary dictionary are trained on.
WINDOW, BASE_WINDOW, SHORT_WINDOW = 6, 24, 3
GRAM, NOVEL = 5, 20
BASE, DICTIONARY = 8192, 2048
FOLDS, PER_HALF = 3, 2
THRESHOLD, RIDGE = 0.7, 0.3
#: Margins in bytes from which windows are counted.
STEPS = (3, 4, 5, 6, 7)
#: Bytes without a five-byte string of any language.
ANCHOR, TAIL = bytes(range(128, 192)), bytes(range(240, 248))

PARAMS = {"window_log": 17, "chain_log": 16, "hash_log": 15, "search_log": 6, "min_match": 5, "target_length": 32, "strategy": zstandard.STRATEGY_GREEDY, "write_content_size": False, "write_checksum": False, "write_dict_id": False, "format": zstandard.FORMAT_ZSTD1_MAGICLESS}


def windows(text: str, size: int) -> list[bytes]:
    """The whole text in lower case, in windows that start and end with a space."""
    words = text.lower().split()
    return [f" {' '.join(words[k : k + size])} ".encode("utf-8", "replace") for k in range(0, len(words), size)] or [b"  "]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]


class Scorer:
    """Holds both dictionaries in digested form."""

    def __init__(self, model: Model):
        self.ordinary, self.toxic, self.weights = self._with(model.ordinary), self._with(model.toxic), np.array(model.weights)

    @staticmethod
    def _with(content: bytes):
        params = zstandard.ZstdCompressionParameters(**PARAMS)
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params).compress

    def margins(self, text: str) -> np.ndarray:
        ordinary, toxic = self.ordinary, self.toxic
        blocks = [b"%b%b%b" % (ANCHOR, w, TAIL) for w in windows(text, WINDOW)]
        return np.array([len(ordinary(b)) - len(toxic(b)) for b in blocks])

    def features(self, text: str) -> list[float]:
        g = self.margins(text)
        over = [int((g >= t).sum()) for t in STEPS]
        return [*map(math.log1p, over), 10 * over[0] / len(g), 10 * over[2] / len(g), math.log1p(len(g))]

    def score(self, text: str) -> float:
        return float(sigmoid(np.dot(self.features(text), self.weights[:-1]) + self.weights[-1]))


N_FEATURES = len(STEPS) + 3


def gram_counts(texts: Iterable[str]) -> Counter:
    """In how many words of how many documents each five-byte string stands."""
    found: Counter = Counter()
    for word, n in Counter(w for t in texts for w in set(t.lower().split())).items():
        raw = f" {word} ".encode("utf-8", "replace")
        for g in {raw[k : k + GRAM] for k in range(len(raw) - GRAM + 1)}:
            found[g] += n
    return found


def marking_runs(word: str, keep: set[bytes]) -> list[bytes]:
    """The longest runs of kept strings in a word between spaces."""
    raw, runs, start = f" {word} ".encode("utf-8", "replace"), [], -1
    for k in range(len(raw) - GRAM + 2):
        if k <= len(raw) - GRAM and raw[k : k + GRAM] in keep:
            start = k if start < 0 else start
        elif start >= 0:
            runs.append(raw[start : k + GRAM - 1])
            start = -1
    return runs


def runs_of(text: str, keep: set[bytes]) -> bytes:
    """A toxic text's marking runs as one training sample, each once."""
    words = dict.fromkeys(text.lower().split())
    return b" ".join(dict.fromkeys(r for w in words for r in marking_runs(w, keep)))


def in_parts(sample: bytes, most: int = SAMPLE_BYTES) -> list[bytes]:
    """A sample as parts of at most `most` bytes, which begin at spaces where there are any."""
    parts, at = [], 0
    while len(sample) - at > most:
        end = sample.rfind(b" ", at + 1, at + most)
        end = end if end > 0 else at + most
        parts.append(sample[at:end])
        at = end
    return [*parts, sample[at:]]


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """Content of a dictionary that zstandard trains; samples too few for that are taken as they are, all of them."""
    try:
        raw = zstandard.train_dictionary(size, samples, k=k, d=d, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)
    offsets = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))  # what ends a dictionary's header
    return raw[raw.find(offsets) + len(offsets) :]


def dictionaries(ordinary: list[bytes], runs: list[bytes]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary, of one length, from ordinary windows of BASE_WINDOW words and marking runs."""
    base = trained(ordinary, BASE, 32, 6)
    toxic = trained(runs, DICTIONARY, 32, 8)
    short = [w for x in ordinary for w in windows(x.decode("utf-8", "replace"), SHORT_WINDOW)]
    return ANCHOR + base + trained(short, DICTIONARY, 32, 8)[: len(toxic)], ANCHOR + base + toxic


def kept_grams(toxic: Counter, ordinary: Counter, n_toxic: int, n_ordinary: int) -> set[bytes]:
    least = max(3, math.ceil(0.01 * n_toxic))
    return {g for g, n in toxic.items() if n >= least and n * n_ordinary >= NOVEL * (ordinary[g] + 0.5) * n_toxic}


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of texts at hand."""
    keep = kept_grams(gram_counts(toxic), gram_counts(ordinary), len(toxic), len(ordinary))
    return dictionaries([x for t in ordinary for w in windows(t, BASE_WINDOW) for x in in_parts(w)], [x for t in toxic for x in in_parts(runs_of(t, keep)) if x])


def constant(n_toxic: int, n: int) -> Model:
    share = n_toxic / max(1, n)
    return Model(b" ", b" ", [0.0] * N_FEATURES + [math.log((share + 1e-6) / (1 - share + 1e-6))])


def fit(sample: list[tuple[str, int]]) -> Model:
    """What fit_on does, for texts at hand: halves are every second text of a class."""
    parts = [[t for t, y in sample if y == k] for k in (1, 0)]
    if min(map(len, parts)) < 2 * PER_HALF:
        return constant(len(parts[0]), len(sample))
    rows, labels = [], []
    for k in (0, 1):
        scorer = Scorer(Model(*train_dictionaries(*(p[1 - k :: 2] for p in parts)), [0.0] * (N_FEATURES + 1)))
        for p, y in zip(parts, (1, 0)):
            rows += [scorer.features(t) for t in p[k::2]]
            labels += [y] * len(p[k::2])
    return Model(*train_dictionaries(*parts), fit_logistic(np.array(rows), np.array(labels), RIDGE).tolist())


def counted_grams(labelled: DataFrame) -> DataFrame:
    """gram, y, half and n over all texts of the sample."""

    def run(batches):
        for batch in batches:
            groups: dict[tuple, list[str]] = {}
            for y, half, text in zip(*(c.to_pylist() for c in batch.columns)):
                groups.setdefault((y, half), []).append(text)
            for (y, half), texts in groups.items():
                found = gram_counts(texts)
                yield pa.RecordBatch.from_arrays([pa.array([*found], pa.binary()), pa.array([y] * len(found), pa.int32()), pa.array([half] * len(found), pa.int32()), pa.array([*found.values()], pa.int64())], names=["gram", "y", "half", "n"])

    return map_arrow(labelled.select("y", "half", "text"), run, "gram binary, y int, half int, n long").groupBy("gram", "y", "half").agg(F.sum("n").alias("n"))


def training_samples(labelled: DataFrame, keeps: dict) -> DataFrame:
    """y, half, model and sample: ordinary windows, and toxic texts' marking runs by each model's strings."""

    def run(batches):
        for batch in batches:
            rows = []
            for y, half, text in zip(*(c.to_pylist() for c in batch.columns)):
                if y:
                    rows += [(y, half, m, x) for m, keep in keeps.items() if m in (2, 1 - half) for x in in_parts(runs_of(text, keep)) if x]
                else:
                    rows += [(y, half, 2, x) for w in windows(text, BASE_WINDOW) for x in in_parts(w)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["y", "half", "model", "sample"])

    return map_arrow(labelled.select("y", "half", "text"), run, "y int, half int, model int, sample binary")


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """From labelled documents outside the held-out fold, read whole as they are scored whole.

    Model k of three is trained on what isn't in half k, the third on all."""
    usable = id_bucket(F.col("doc_id"), FOLDS) != 1
    rows = labelled_documents(docs, labels, "toxic", usable, SAMPLE, F.coalesce("text", F.lit("")).alias("text"))
    labelled = cut(rows.select("y", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).cast("int").alias("half"), "text"), "labelled")
    sizes = {(r.y, r.half): r.n for r in labelled.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get((y, half), 0) for y in (0, 1) for half in (0, 1)) < PER_HALF:
        return constant(sum(n for (y, _), n in sizes.items() if y), sum(sizes.values()))
    # only strings of enough toxic documents reach the driver: at most a hundred for each that a document holds
    counts = counted_grams(labelled).groupBy("gram").pivot("y", [0, 1]).agg(*(F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"h{h}") for h in (0, 1))).na.fill(0)
    least = max(3, math.ceil(0.01 * min(sizes[1, 0], sizes[1, 1])))
    found = counts.where((F.col("1_h0") + F.col("1_h1") >= least) & ((F.col("1_h0") + F.col("1_h1")) * (sizes[0, 0] + sizes[0, 1]) >= (F.col("0_h0") + F.col("0_h1")) * (sizes[1, 0] + sizes[1, 1]))).collect()
    keeps = {}
    for m in (0, 1, 2):
        halves = (0, 1) if m == 2 else (1 - m,)
        toxic, ordinary = (Counter({bytes(r.gram): sum(r[f"{y}_h{h}"] for h in halves) for r in found}) for y in (1, 0))
        keeps[m] = kept_grams(toxic, ordinary, *(sum(sizes[y, h] for h in halves) for y in (1, 0)))
    ordinary, toxic = (training_samples(labelled.where(F.col("y") == y), keeps) for y in (0, 1))
    some = ordinary.unionByName(toxic)
    ordinary, runs = [], {m: [] for m in keeps}
    for r in some.orderBy("y", F.xxhash64("sample"), "sample", "half", "model").toLocalIterator():
        if r.y:
            runs[r.model].append(bytes(r["sample"]))
        else:
            ordinary.append((r.half, bytes(r["sample"])))
    pairs = [dictionaries([w for half, w in ordinary if half != m], runs[m]) for m in keeps]

    def judge(batches):
        scorers = [Scorer(Model(*pairs[k], [0.0] * (N_FEATURES + 1))) for k in (0, 1)]
        for batch in batches:
            x = [scorers[half].features(text.as_py()) for half, text in zip(batch.column(1).to_pylist(), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    judged = map_arrow(labelled.select("y", "half", "text"), judge, "y int, x array<double>").collect()
    judged = sorted((r.y, r.x) for r in judged)  # sums of doubles in one order
    return Model(*pairs[2], fit_logistic(np.array([x for _, x in judged]), np.array([y for y, _ in judged]), RIDGE).tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    scored = map_arrow(id_and_text(docs), run, "doc_id long, score double")
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), FOLDS) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_on(docs, table(spark, sf_dir, "labels")))
