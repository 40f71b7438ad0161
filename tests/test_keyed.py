"""Keyed tables: only touched buckets are rewritten, and a change counts wholly or not at all."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import tables
from ledgerloom.operators.keyed import Checkpoints, Conflict, KeyedTable

ROOT = str(Path(__file__).resolve().parent.parent)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def people(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", None if i % 2 else i) for i in range(100)], "id long, name string, age int")
    return KeyedTable.create(rows, str(tmp_path / "t"), ["id"], 8)


def test_changes_equal_those_of_frames(spark, people):
    old = people.read()
    new = spark.createDataFrame([(3, None, 33), (200, "new", None), (None, "no key", 1)], "id long, name string, age int")
    wanted = rows_of(tables.upsert(old, new, ["id"]))
    before, touched = dict(people.versions), people.touched(new)
    people.upsert(new)
    assert rows_of(people.read()) == wanted == rows_of(KeyedTable(spark, people.folder).read())
    assert {b for b in before if people.versions[b] != before[b]} == set(touched) and len(touched) < 8
    people.delete(spark.createDataFrame([(i,) for i in range(50)], "id long"))
    assert people.read().where("id < 50").isEmpty() and people.read().count() == 52
    people.insert_missing(spark.createDataFrame([(60, "other", 1), (1, "back", 1), (1, "back", 1)], "id long, name string, age int"))
    assert rows_of(people.read().where("id in (1, 60)")) == [(1, "back", 1), (60, "n60", 60)]
    people.wipe(F.col("age") > 90)
    assert sorted(r.id for r in people.read().collect()) == [92, 94, 96, 98] and people.read().columns == ["id", "name", "age"]
    people.wipe(F.lit(False))
    assert people.read().collect() == [] and people.versions == {} and people.read().columns == ["id", "name", "age"]
    people.upsert(new.where("false"))
    people.upsert(new)
    assert people.read().count() == 3


def test_children_of_touched_parents(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, i) for i in range(20)], "parent int, child int")
    kept = KeyedTable.create(rows, str(tmp_path / "c"), ["parent"], 4)
    kept.replace_children(spark.createDataFrame([(1, 100)], "parent int, child int"), spark.createDataFrame([(1,), (2,), (9,)], "parent int"))
    assert set(rows_of(kept.read())) == {(i % 5, i) for i in range(20) if i % 5 not in (1, 2)} | {(1, 100)}


def test_a_change_that_breaks_off_has_not_happened(spark, people):
    before = rows_of(people.read())

    def broken(batches):
        for batch in batches:
            yield batch
        raise RuntimeError("lost")

    new = spark.createDataFrame([(i, "x", 1) for i in range(40)], "id long, name string, age int")
    with pytest.raises(Exception, match="lost"):
        people.change(new, lambda old: tables.upsert(old, new, ["id"]).mapInArrow(broken, "id long, name string, age int"))
    assert rows_of(people.read()) == before == rows_of(KeyedTable(spark, people.folder).read())
    people.upsert(new)
    people.vacuum()
    assert people.read().where("name = 'x'").count() == 40 and people.vacuum() == 0 and people.read().count() == 100


def test_two_changes_at_once(spark, people):
    other, new = KeyedTable(spark, people.folder), spark.createDataFrame([(1, "first", 1)], "id long, name string, age int")
    people.upsert(new)
    with pytest.raises(Conflict):
        other.upsert(new.withColumn("name", F.lit("second")))
    assert KeyedTable(spark, people.folder).read().where("id = 1").first().name == "first"
    other = KeyedTable(spark, people.folder)
    other.upsert(new.withColumn("name", F.lit("second")))
    assert other.read().where("id = 1").first().name == "second"


KILLED = """
import os, sys
from pyspark import TaskContext
from ledgerloom.session import session
from ledgerloom.operators import tables
from ledgerloom.operators.keyed import KeyedTable
spark = session("local[2,4]", **{"spark.sql.shuffle.partitions": "3"})
rows = spark.range(500).selectExpr("id", "cast(id as string) as name")
kept = KeyedTable.create(rows, sys.argv[1], ["id"], 4)
def once(batches):
    for batch in batches:
        yield batch
    if TaskContext.get().attemptNumber() == 0:
        os.kill(os.getpid(), 9)  # the worker dies with its task after all rows are written
new = spark.range(300, 700).selectExpr("id", "'new' as name")
kept.change(new, lambda old: tables.upsert(old, new, ["id"]).mapInArrow(once, "id long, name string"))
found = KeyedTable(spark, sys.argv[1]).read()
print("FOUND", found.count(), found.select("id").distinct().count(), found.where("name = 'new'").count())
"""


def test_killed_tasks_leave_nothing(tmp_path):
    out = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path / "k")], cwd=ROOT, capture_output=True, text=True, timeout=200, env={**__import__("os").environ, "PYTHONPATH": ROOT})
    assert "FOUND 700 700 400" in out.stdout, out.stderr[-1500:]


def test_checkpoints(spark, tmp_path):
    states = Checkpoints.create(spark, str(tmp_path / "s"))
    of = lambda columns, *rows: spark.createDataFrame([*rows], columns)
    now = lambda n: F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")
    states.begin(of("collection string, title string", ("a", "A"), ("b", "B"), ("c", "C")), "r1", now(1))
    states.save(of("collection string, graph string, stats string", ("a", "g", "s"), ("unknown", "g", "s")), now(2))
    states.fail(of("collection string, error string", ("b", "e" * 5000)), now(3))
    assert sorted((r.collection, r.status, r.graph, len(r.error or ""), r.updated.day) for r in states.table.read().collect()) == [("a", "extracted", "g", 0, 2), ("b", "failed", None, 4000, 3), ("c", "extracting", None, 0, 1)]
    wanted = of("collection string", ("a",), ("b",), ("c",), ("d",))
    assert sorted(r.collection for r in states.pending(wanted).collect()) == ["b", "c", "d"]
    states.begin(of("collection string, title string", ("a", "A2"), ("b", "B")), "r2", now(4))
    assert sorted((r.collection, r.title, r.run_id, r.status, r.graph, r.error) for r in states.table.read().collect()) == [("a", "A2", "r2", "extracting", None, None), ("b", "B", "r2", "extracting", None, None), ("c", "C", "r1", "extracting", None, None)]
