"""Sources, flattening, streams and the entry file."""

import json

from pyspark.sql import functions as F

from ledgerloom.operators import app, flatten, graph, industry, knowledge, tables
from ledgerloom.operators.components import components
from ledgerloom.sources import files, paged
from ledgerloom.streaming import events


def pages(endpoint, page, size):
    if endpoint == "bad" and page == 2:
        raise OSError("lost")
    return [{"uri": f"/{endpoint}/{page}/{k}"} for k in range(size)], 3


def test_paged_source(spark):

    rows, whole = paged.read_pages(spark, "tests.test_pipelines:pages", "good", 4)
    assert whole and rows.count() == 12 and "uri" in json.loads(rows.first().record)
    rows, whole = paged.read_pages(spark, "tests.test_pipelines:pages", "bad", 4)
    assert not whole and rows.count() == 4


RESOURCE = {
    "uri": "/repositories/1/resources/1", "ead_id": "e1", "id_0": "MSS:12 a", "title": "T", "create_time": "2020-01-02T03:04:05Z", "created_by": "ann", "system_mtime": "x",
    "lang_materials": [{"language_and_script": {"language": "eng"}}, {"language_and_script": {"language": "eng"}}],
    "dates": [{"date_type": "inclusive", "expression": "1900", "begin": "1900", "end": None}, {"date_type": "inclusive", "expression": "1901", "begin": "1901", "end": "1902"}],
    "notes": [{"persistent_id": "p1", "type": "scopecontent", "label": "L", "publish": True, "content": ["<p>Hello", "you</p>"], "subnotes": []}, {"persistent_id": None, "type": "x", "label": None, "publish": None, "content": ["no"], "subnotes": []}],
    "linked_agents": [{"ref": "/agents/people/1", "role": "creator"}, {"ref": "/agents/people/2", "role": "odd"}, {"ref": None, "role": "creator"}],
}


def test_flattening(spark):
    schema = (
        "uri string, ead_id string, id_0 string, title string, create_time string, created_by string, system_mtime string, lang_materials array<struct<language_and_script: struct<language: string>>>, "
        "dates array<struct<date_type: string, expression: string, begin: string, end: string>>, notes array<struct<persistent_id: string, type: string, label: string, publish: boolean, content: array<string>, subnotes: array<struct<content: string>>>>, linked_agents array<struct<ref: string, role: string>>"
    )
    raw = spark.createDataFrame([(json.dumps(RESOURCE),)], "v string").select(F.from_json("v", schema).alias("r")).select("r.*")
    one = flatten.collections(raw).first()
    assert one.creating_user == "ann" and one.languages == ["eng"] and one.collection_type_prefix == "Mss"
    assert one.dates_by_type["date_inclusive_expression"] == "1901" and "system_mtime" not in one.asDict()
    notes, edges = flatten.notes(raw)
    assert [n.content for n in notes.collect()] == ["Hello you"] and edges.count() == 1
    assert {(e.rel, e.dst) for e in flatten.agent_edges(raw).collect()} == {("CREATED_BY", "/agents/people/1"), ("RELATED_TO", "/agents/people/2")}
    assert flatten.properties(raw, "uri").first().create_time_ts is not None


def test_industry_lookup_keeps_commas(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("code,label\n1,Agriculture industries; farming\n12,Grain, hay and feed\n12,Grain, hay\n")
    found = {r.code: r.label for r in files.lookup(spark, str(tmp_path / "codes.csv")).collect()}
    assert found == {"1": "Agriculture industries; farming", "12": "Grain, hay"}
    rows = spark.createDataFrame([("Mss:1 x",), ("no",), ("MSS:129",), ("MSS:",)], "id_0 string")
    out = {r.id_0: r for r in industry.with_industry(rows, "id_0", files.lookup(spark, str(tmp_path / "codes.csv"))).collect()}
    assert out["Mss:1 x"].industry_path == "Agriculture industries; farming" and out["no"].industry_path == "Not Applicable"
    assert out["MSS:129"].industry_path == "Agriculture industries; farming-Grain, hay-Not Found" and out["MSS:"].industry_path == "Not Found"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.html").write_text("<p>one</p><script>x</script><p>two &amp; three</p>")
    (tmp_path / "c.bin").write_bytes(b"?")
    kept, skipped = files.scan(spark, str(tmp_path))
    assert kept.count() == 2 and skipped.count() == 1
    assert {r.text for r in files.convert(kept).collect()} == {"plain", "one\ntwo & three"}
    assert files.relation_types(spark).count() == 2 * 27 - 6


def test_components_and_closure(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (6, 6), (9, 1), (5, 4)], "a int, b int")
    assert {r.node: r.root for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4}
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a int, b int")
    assert {r.root for r in components(chain).collect()} == {0}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert {(r.node, r.depth) for r in graph.closure(ring, spark.createDataFrame([("a",)], "node string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    parents = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None)], "node string, parent string")
    assert not graph.may_move(parents, "a", "c") and graph.may_move(parents, "c", "a") and not graph.may_move(parents, "a", "a")


def test_hot_nodes_are_not_shuffled(spark, monkeypatch):
    """A node of high degree is joined by a broadcast of bounded size, and no shuffled key exceeds the limit."""
    from ledgerloom.operators import components as C

    monkeypatch.setattr(C, "HOT_DEGREE", 50)
    edges = spark.range(1, 2000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    stars = C.large_star(edges.unionByName(spark.range(3000, 3100).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))), 2099)
    plan = stars._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    mixed = edges.unionByName(spark.createDataFrame([(5000, 4000), (4000, 1999)], "a long, b long"))
    assert {r.root for r in components(mixed).collect()} == {0}
    both = mixed.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    assert C.with_least(both, least, 2001).count() == both.count()


def test_upserts_keep_what_is_not_given(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", "q")], "k int, v string, w string")
    assert {tuple(r) for r in tables.upsert(old, new, ["k"]).collect()} == {(1, "a", "x"), (2, "b", "z"), (3, "c", "q")}
    scope = app.effective_scope(spark.createDataFrame([(1, 1), (2, 2)], "id int, at int"), spark.createDataFrame([(2, 1), (3, 5)], "id int, at int"), "id", "at")
    assert {(r.id, r.scope) for r in scope.collect()} == {(1, "user"), (2, "user"), (3, "conversation")}


def test_knowledge_steps(spark):
    units = spark.createDataFrame([("c", k, "x" * 400) for k in range(6)], "collection string, i long, text string")
    chunks = {r.i: r.chunk for r in knowledge.packed(units, 250).collect()}
    assert chunks == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}
    kept = knowledge.relevant("q", units.withColumn("rank", F.col("i")), lambda q, ts: [False] * len(ts), rescue=F.col("i") > 2)
    assert [r.i for r in kept.collect()] == [3, 4]
    assert knowledge.relevant("q", units, lambda q, ts: 1 / 0).count() == 6


def test_streams(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(events.read_events(spark, str(tmp_path / "in"), rows.schema))
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == rows.count()


def test_entry_file(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 60
    assert entry.entry(spark).count() == 10


def test_section_growth_reads_short_documents(spark, tmp_path):
    from ledgerloom.plans import catalogue

    text = " ".join(f"word{k}" for k in range(300))
    spark.createDataFrame([(k, f"{k} {text}") for k in range(60)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert len(text) < 4000 and catalogue.QUERIES["section_growth"](spark, str(tmp_path)).count() > 0
