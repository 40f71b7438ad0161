"""Interval labels against walks by hand."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import intervals


def forest(rng, n, chain=0):
    """child to parent; the first few are roots, and a chain hangs on one of them."""
    up = {f"n{i}": f"n{rng.randrange(max(1, i - 12), i) if rng.random() < 0.7 else rng.randrange(i)}" for i in range(4, n)}
    up |= {f"c{i}": f"c{i - 1}" if i else "n0" for i in range(chain)}
    return up


@pytest.fixture(scope="module", params=[(30, 0), (150, 70)])
def case(request, spark, tmp_path_factory):
    up = forest(random.Random(request.param[0]), *request.param)
    edges = spark.createDataFrame([(p, c) for c, p in up.items()] + [(None, "x"), ("y", None)], "src string, dst string").repartition(5)
    return up, intervals.build(edges, str(tmp_path_factory.mktemp("tree") / "h"))


def chain_of(up, n):
    out = [n]
    while out[-1] in up:
        out.append(up[out[-1]])
    return out


def test_labels(case):
    up, tree = case
    labels = {r.node: r for r in tree.labels.collect()}
    nodes = set(up) | set(up.values())
    assert set(labels) == nodes and sorted(r.pre for r in labels.values()) == list(range(len(nodes)))
    below = {n: {m for m in nodes if n in chain_of(up, m)} for n in nodes}
    for n, r in labels.items():
        assert (r.root, r.depth, r.parent, r.size) == (chain_of(up, n)[-1], len(chain_of(up, n)) - 1, up.get(n), len(below[n]))
        assert {m for m in nodes if r.pre <= labels[m].pre <= r.last} == below[n]
    assert len(tree.jumps) <= max(r.depth for r in labels.values()).bit_length() + 1


def test_ranges_and_pointers(case, spark, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK", 8)
    up, tree = case
    some = spark.createDataFrame([(n,) for n in sorted(set(up.values()))[::2] + ["n0", "absent"]], "node string")
    asked = {r.node for r in some.collect()} - {"absent"}
    nodes = set(up) | set(up.values())
    wanted = {(a, n, chain_of(up, n).index(a)) for n in nodes for a in chain_of(up, n)}
    assert sorted(map(tuple, tree.descendants(some).collect())) == sorted(w for w in wanted if w[0] in asked)
    starts = some.where("node <> 'absent'").distinct()
    assert sorted(map(tuple, tree.ancestors(starts).collect())) == sorted((n, a, d) for a, n, d in wanted if n in asked)


def test_what_is_no_forest(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame([*rows], "src string, dst string")
    with pytest.raises(intervals.NotAForest, match="two parents"):
        intervals.label(frame(("a", "c"), ("b", "c")))
    with pytest.raises(intervals.NotAForest, match="cycle"):
        intervals.label(frame(("a", "b"), ("b", "c"), ("c", "a"), ("r", "s")))
    with pytest.raises(intervals.NotAForest, match="cycle"):
        intervals.label(frame(("a", "a")))
    twice = intervals.build(frame(("a", "b"), ("a", "b")), str(tmp_path / "h"))
    assert sorted((r.node, r.pre, r.last) for r in twice.labels.collect()) == [("a", 0, 1), ("b", 1, 1)]
    none = intervals.build(frame().where("false"), str(tmp_path / "none"))
    assert none.labels.isEmpty() and none.jumps == []


def test_labels_are_kept(spark, tmp_path):
    path = str(tmp_path / "edges")
    spark.createDataFrame([("a", "b")], "src string, dst string").write.parquet(path)
    first = intervals.hierarchy_of(spark.read.parquet(path))
    assert first.labels.inputFiles() == intervals.hierarchy_of(spark.read.parquet(path)).labels.inputFiles()
    assert first.labels.inputFiles() != intervals.hierarchy_of(spark.read.parquet(path), "other").labels.inputFiles()
