"""The inverted index against scans of the texts themselves."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import inverted as I
from ledgerloom.operators import search as S

WORDS = ["the", "rope", "ropes", "making", "makings", "river", "reveur", "été", "a", "mill"]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 30))) + rng.choice(["", ". Rope, making!", "\nROPE 7 making"])) for i in range(700)]
    rows += [(-1, None), (-2, ""), (-3, "a a a a the"), (-4, "the " * 3000)]
    path = str(tmp_path_factory.mktemp("texts") / "docs")
    spark.createDataFrame([(*r, 0) for r in rows], "doc long, body string, slot int").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(texts):
    return I.index_of(texts, "doc", "body")


def found(df):
    return {r[0]: round(r.score, 6) for r in df.collect()}


def test_scores_are_those_of_a_scan(texts, index):
    terms = ["the", "rope", "été", "absent"]
    assert found(I.scores(index, dict.fromkeys(terms, 1.0))) == found(S.bm25(texts, "doc", "body", terms))
    assert index.slots == 3 and index.n == 704 and found(I.scores(index, {"absent": 1.0})) == {}


@pytest.mark.parametrize("topic", ["rope making", "rivver", "a a", "the rope making mill", "mill"])
def test_topics_are_those_of_a_scan(texts, index, topic):
    ours, scanned = found(I.lexical(index, topic)), found(S.lexical(texts, "doc", "body", topic))
    assert {k: (ours.get(k), v) for k, v in scanned.items() if abs(v - ours.get(k, 0)) > 2e-6} == {} and ours.keys() == scanned.keys()


@pytest.mark.parametrize("k", [1, 7, 300, 2000])
def test_the_best_are_found_though_slots_stay_unread(texts, index, k):
    weighted = {"river": 1.0, "mill": 2.0, "the": 0.1}
    everything = sorted(((-s, d) for d, s in found(I.scores(index, weighted)).items()))[:k]
    assert [(r.doc, round(r.score, 6)) for r in I.best(index, weighted, k).collect()] == [(d, -s) for s, d in everything]


def test_only_buckets_of_the_terms_are_read(index):
    plan = index.postings(["the"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,the)]" in plan


def test_a_bound_holds_for_each_document_of_its_slot(index):
    over = index.all_postings.select("term", "bound", F.explode("docs").alias("d")).where(F.col("bound") < I.saturation(F.col("d.tf"), F.col("d.length"), index.mean) - 1e-12)
    assert over.isEmpty() and index.all_postings.groupBy("slot", "term").count().where("count > 1").isEmpty()


def test_an_index_is_built_once_and_again_after_a_change(spark, texts, index, tmp_path):
    assert I.index_of(texts, "doc", "body").folder == index.folder != I.index_of(texts.where("doc < 9"), "doc", "body", "few").folder
    path = str(tmp_path / "docs")
    texts.limit(20).write.parquet(path)
    first = I.index_of(spark.read.parquet(path), "doc", "body")
    texts.limit(5).write.mode("append").parquet(path)
    second = I.index_of(spark.read.parquet(path), "doc", "body")
    assert (first.n, second.n) == (20, 25) and first.folder != second.folder
    # without its `about` an index counts as unfinished and is written anew
    fs, about = I.path_of(spark, f"{second.folder}/about")
    fs.delete(about, True)
    assert I.index_of(spark.read.parquet(path), "doc", "body").n == 25


def test_no_documents(spark, texts, tmp_path):
    path = str(tmp_path / "none")
    texts.where("false").write.parquet(path)
    empty = I.index_of(spark.read.parquet(path), "doc", "body")
    assert empty.n == 0 and found(I.best(empty, {"the": 1.0}, 5)) == {} and found(I.lexical(empty, "rope making")) == {}


def disk(spark, docs, folder):
    """Bytes that building an index shuffles, spills and leaves."""

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        held = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))

    before = shuffled()
    index = I.build(docs, "doc_id", "text", folder)
    fs, path = I.path_of(spark, folder)
    return index, shuffled() - before + fs.getContentSummary(path).getLength()


def test_building_writes_less_than_four_times_the_texts(spark, tmp_path):
    """Shuffles and index together, where nearly every word is a posting of its own."""
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choices("aeioulmnrst", k=rng.choice((2, 3, 5, 7)))) for _ in range(300))) for i in range(3000)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    fs, where = I.path_of(spark, path)
    index, used = disk(spark, spark.read.parquet(path), str(tmp_path / "index"))
    assert index.n == 3000 and used < 4 * fs.getContentSummary(where).getLength()


def test_rows_that_share_a_key(spark, tmp_path):
    rows = [(1, "rope mill rope"), (1, "mill river mill"), (1, "mill"), (None, "rope"), (None, "rope"), (None, "rope a"), (2, None), (2, ""), *((i, "a mill") for i in range(3, 600))] * 2
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc long, body string").repartition(5).write.parquet(path)
    index = I.index_of(spark.read.parquet(path), "doc", "body")
    said = {}
    for key, text in rows:
        words = (text or "").split()
        for at, word in enumerate(words):
            said.setdefault((word, key, len(words)), []).append(at)
    held = index.all_postings.select("term", "slot", F.explode("docs").alias("d")).select("term", "slot", "d.*").collect()
    assert {(r.term, r.doc, r.length): (r.tf, r.at) for r in held} == {k: (len(v), sorted(v)) for k, v in said.items()} and len(held) == len(said)
    slots = {}
    for r in held:
        slots.setdefault(r.doc, set()).add(r.slot)
    assert all(len(x) == 1 for x in slots.values())


@pytest.mark.parametrize("numbers", [[], [0], [7, 7], [-5, 300, 2], [-(2**63), 2**63 - 1, 0], [2**40, 2**40 + 65535]])
def test_thinned_numbers(numbers):
    least, width, raw = I.thin(np.array(numbers, np.int64))
    assert I.thick(least, width, raw).tolist() == numbers and len(raw) == width * len(numbers)


@pytest.mark.parametrize("key", ["doc", "cast(doc as smallint)", "concat('é', doc)", "if(doc % 5 = 0, null, doc)", "cast(doc as decimal(30, 2))", "date_add(date'2020-01-01', cast(doc as int))"])
def test_keys_of_other_types(texts, tmp_path, key):
    path = str(tmp_path / "docs")
    texts.where("doc between -4 and 60").selectExpr(f"{key} as k", "body").write.parquet(path)
    docs = texts.sparkSession.read.parquet(path)
    index = I.index_of(docs, "k", "body")
    held = index.all_postings.where("term = 'the'").select(F.inline("docs")).select("k", "tf", "length")
    scanned = docs.select("k", F.filter(I.tokens(F.col("body")), lambda t: t == "the").alias("t"), F.size(I.tokens(F.col("body"))).alias("length")).where("size(t) > 0").groupBy("k", "length").agg(F.sum(F.size("t")).alias("tf"))
    assert held.schema["k"].dataType == docs.schema["k"].dataType
    assert sorted(map(str, held.collect())) == sorted(map(str, scanned.select("k", F.col("tf").cast("int"), "length").collect())) != []


def test_blocks_of_texts(monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 50)
    rng = random.Random(3)
    rows = sorted((rng.randint(0, 40), ["a"] * rng.randint(0, 9)) for _ in range(900)) + [(50, ["b"] * 7)] * 300
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + 100]]), pa.array([r[1] for r in rows[i : i + 100]], pa.list_(pa.string()))], ["k", "t"]) for i in range(0, len(rows), 100)]
    for repeated in (False, True):
        made = [b.to_pylist() for b in I.blocks(iter(batches), repeated)]
        assert [(r["k"], r["t"]) for b in made for r in b] == rows and len(made) > 5
        if repeated:
            assert all(a[-1]["k"] != b[0]["k"] for a, b in zip(made, made[1:]))
