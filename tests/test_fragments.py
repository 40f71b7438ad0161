"""Streamed folds of fragments against folds of whole tables."""

import random
import time

import pytest

from ledgerloom.operators import app
from ledgerloom.streaming import fragments as S


def fragment(conv, turn, seq, kind, slot=None, id=None, name=None, text=None, n=None):
    return (conv, turn, seq, kind, slot, id, name, text, n, None)


def turn_rows(rng, conv, turn, ended=True):
    rows = []
    for seq in range(rng.randint(1, 9)):
        if rng.random() < 0.5:
            rows.append(fragment(conv, turn, seq, "text", text=rng.choice(["a", "b ", "", None, "ß\U0001f600"])))
        else:
            slot = rng.randrange(2)
            rows.append(fragment(conv, turn, seq, "call", slot, rng.choice([None, f"c{slot}", ""]), rng.choice([None, f"tool{slot}"]), rng.choice(['{"a"', ": 1}", None])))
    return [*rows, fragment(conv, turn, len(rows), "end", n=len(rows) + 1)] if ended else rows


def run(spark, folder, checkpoint, name, until, wait=600_000):
    """Until until(query) holds. Timers keep a query of all that is available going, so it's stopped from here."""
    stream = S.fold_stream(spark.readStream.schema(S.FRAGMENT).option("maxFilesPerTrigger", 1).parquet(folder), wait)
    query, began = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime="1 second").format("parquet").option("path", name).start(), time.monotonic()
    try:
        while query.isActive and time.monotonic() - began < 120 and not until(query):
            time.sleep(0.5)
    finally:
        query.stop()


def has_read(n):
    return lambda query: sum(p.numInputRows for p in query.recentProgress) >= n


def rows_of(df):
    return sorted((r.conv_id, r.turn, r.text, [tuple(c) for c in r.calls], r.n_fragments, r.complete) for r in df.collect())


@pytest.fixture
def spark_with_store(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_shuffled_batches_and_a_restart(spark_with_store, tmp_path):
    spark, rng = spark_with_store, random.Random(2)
    rows = [r for c in range(6) for t in range(4) for r in turn_rows(rng, c, t)]
    rng.shuffle(rows)
    rows += rows[:20]  # delivered twice
    out, folder, checkpoint = str(tmp_path / "out"), str(tmp_path / "in"), str(tmp_path / "cp")
    half = len(rows) // 2
    part = lambda some: spark.createDataFrame(some, S.FRAGMENT).coalesce(1).write.mode("append").parquet(folder)
    part(rows[: half // 2])
    part(rows[half // 2 : half])
    run(spark, folder, checkpoint, out, has_read(half))
    first = rows_of(spark.read.parquet(out))
    part(rows[half:])
    run(spark, folder, checkpoint, out, has_read(len(rows) - half))  # goes on from the checkpoint
    whole = S.fold_all(spark.createDataFrame(rows, S.FRAGMENT))
    found = rows_of(spark.read.parquet(out))
    assert 0 <= len(first) < len(found) == 24 and found == rows_of(whole)
    by_hand = {}
    for c, t, seq, kind, slot, id_, name, text, n, _ in rows:
        by_hand.setdefault((c, t), {})[seq] = (kind, slot, id_, name, text)
    assert [(c, t, x, k) for c, t, x, k, *_ in found] == [(*key, *S.folded(parts)) for key, parts in sorted(by_hand.items())]


def test_a_turn_that_never_ends_is_emitted_as_it_is(spark_with_store, tmp_path):
    spark = spark_with_store
    rows = [fragment(1, 1, 1, "text", text="b"), fragment(1, 1, 0, "text", text="a"), fragment(2, 1, 0, "text", text="x"), fragment(2, 1, 1, "end", n=2)]
    spark.createDataFrame(rows, S.FRAGMENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")

    def both(_):
        try:
            return spark.read.schema(S.TURN).parquet(out).count() == 2
        except Exception:
            return False

    run(spark, str(tmp_path / "in"), str(tmp_path / "cp"), out, both, wait=2000)
    assert rows_of(spark.read.parquet(out)) == [(1, 1, "ab", [], 2, False), (2, 1, "x", [], 2, True)]


def test_text_equals_the_batch_fold_of_a_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    cut = rows.selectExpr("conv_id", "turn", "posexplode(split(text, '(?<= )')) as (seq, text)")
    fragments = cut.selectExpr("conv_id", "turn", "cast(seq as int) as seq", "'text' as kind", "cast(null as int) as slot", "cast(null as string) as id", "cast(null as string) as name", "text", "cast(null as int) as n", "cast(null as timestamp) as ts")
    found = {(r.conv_id, r.turn): r.text for r in S.fold_all(fragments).collect()}
    assert found == {(r.conv_id, r.turn): r.text for r in app.fold_fragments(fragments, ["conv_id", "turn"], "seq", "text").collect()} == {(r.conv_id, r.turn): r.text for r in rows.collect()}
