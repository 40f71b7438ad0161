"""Operators that no registered query runs: sources, records, exports, dossiers, bookkeeping."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom import cli
from ledgerloom.functions import records as R
from ledgerloom.functions import text as T
from ledgerloom.operators import app, exports, flatten, guard, knowledge, resolution, tables
from ledgerloom.sources import files, paged


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def calls(endpoint, page, size):
    with open(endpoint, "a") as f:
        f.write(f"{page}\n")
    return [{"page": page}], 3


def failing(endpoint, page, size):
    raise OSError("404")


def test_pages_are_fetched_once(spark, tmp_path):
    log = tmp_path / "log"
    rows, whole = paged.read_pages(spark, "tests.test_operators:calls", str(log), 1)
    assert whole and rows.count() == 3 and rows.count() == 3
    assert sorted(log.read_text().split())[-2:] == ["2", "3"] and len(log.read_text().split()) == 4  # one more to learn the last page
    assert json.loads(paged.read_one(spark, "tests.test_operators:calls", str(tmp_path / "one"))) == {"page": 1}
    with pytest.raises(Exception, match="404"):
        paged.read_one(spark, "tests.test_operators:failing", "x")


def test_lookups_by_key(spark):
    keys, raw = spark.createDataFrame([("a",), ("b",)], "uri string"), spark.createDataFrame([("a", 1)], "uri string, v int")
    found, lost = paged.fetch_by_keys(keys, raw)
    assert rows_of(found) == [("a", 1)] and rows_of(lost) == [("b",)]
    ids = spark.createDataFrame([(0, "a"), (1, "z")], "pos int, uri string")
    with pytest.raises(KeyError, match="z"):
        tables.strict_lookup(raw, ids, "uri")
    assert rows_of(tables.strict_lookup(raw, ids.where("pos = 0"), "uri"), "v") == [(1,)]


def test_ontology(spark, tmp_path):
    (tmp_path / "o.rdf").write_text("""<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s"><owl:ObjectProperty rdf:about="http://x#hasA"><owl:inverseOf rdf:resource="http://x#isAOf"/><rdfs:comment>A.</rdfs:comment></owl:ObjectProperty>
<owl:ObjectProperty rdf:about="http://x#knows"><rdf:type rdf:resource="http://owl#SymmetricProperty"/></owl:ObjectProperty></rdf:RDF>""")
    assert rows_of(files.ontology(spark, str(tmp_path / "o.rdf")), "name", "symmetric") == [("hasA", False), ("knows", True)]
    assert {r.name: r.inverse for r in files.ontology(spark, str(tmp_path / "o.rdf")).collect()} == {"hasA": "isAOf", "knows": None}


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    docx = archive(**{"word/document.xml": '<w:p a="1"><w:r><w:t>One &amp;</w:t><w:t xml:space="preserve"> two</w:t></w:r></w:p><w:p ></w:p><w:p><w:t>three</w:t></w:p>'})
    pptx = archive(**{"ppt/slides/slide10.xml": "<a:p><a:t>last</a:t></a:p>", "ppt/slides/slide2.xml": "<a:p><a:t>first</a:t></a:p><a:p><a:t>line</a:t></a:p>"})
    xlsx = archive(**{"xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><t>ann</t></si></sst>", "xl/worksheets/sheet1.xml": '<row r="1"><c t="s"><v>0</v></c><c t="inlineStr"><is><t>age</t></is></c></row><row r="2"><c t="s"><v>1</v></c><c><v>7</v></c></row><row r="3"><c/><c><v>8</v></c></row>'})
    for name, content in (("a.docx", docx), ("b.pptx", pptx), ("c.xlsx", xlsx), ("d.docx", b"broken"), ("e.pdf", b"%PDF")):
        (tmp_path / name).write_bytes(content)
    found = {r.path[-6:]: r.text for r in files.convert(files.scan(spark, str(tmp_path))[0]).collect()}
    assert found == {"a.docx": "One & two\n\nthree", "b.pptx": "first\nline\n\nlast", "c.xlsx": "name: ann; age: 7\nage: 8", "d.docx": None, "/e.pdf": None}


def test_record_fields(spark):
    schema = "uri string, title string, parent struct<ref: string>, resource struct<ref: string>, instances array<struct<instance_type: string, digital_object: struct<ref: string>>>"
    raw = spark.createDataFrame([("/o/1", "t", ("/o/9",), ("/r/1",), [("text", None), ("text", None), ("digital_object", ("/d/1",))]), ("/o/2", "u", None, ("/r/1",), []), ("/o/3", "v", None, None, None)], schema)
    found = {r.uri: r for r in flatten.archival_objects(raw).collect()}
    assert [found[u].parent_uri for u in ("/o/1", "/o/2", "/o/3")] == ["/o/9", "/r/1", ""]
    assert found["/o/1"].digital_objects == ["/d/1"] and found["/o/1"].container_instance_types == ["text"]
    assert rows_of(flatten.part_edges(flatten.archival_objects(raw)), "src", "dst") == [("/o/9", "/o/1"), ("/r/1", "/o/2")]
    schema = "uri string, names array<struct<sort_name: string, primary_name: string>>, dates_of_existence array<struct<structured_date_range: struct<begin_date_standardized: string, begin_date_expression: string, end_date_standardized: string, end_date_expression: string>, structured_date_single: struct<date_standardized: string, date_expression: string>>>, related_agents array<struct<ref: string, relator: string>>"
    raw = spark.createDataFrame([("/agents/people/1", [("Roe, Jane", "Roe")], [(("1900", None, None, "1950?"), None), (None, ("1", "1"))], [("/agents/people/2", "is_parent_of"), ("/agents/people/3", None)]), ("/agents/families/2", [("", "Roes")], [(None, ("1820", "about 1820"))], None)], schema)
    found = {r.uri: r for r in flatten.agents(raw).collect()}
    one, two = found["/agents/people/1"], found["/agents/families/2"]
    assert (one.agent_type, one.display_name, one.existence_begin, one.existence_end) == ("person", "Roe, Jane", "1900", "1950?")
    assert (two.agent_type, two.display_name, two.existence_begin, two.existence_end, two.existence_expression) == ("family", "Roes", "1820", "", "about 1820")
    assert rows_of(flatten.related_agents(raw), "rel", "dst") == [("ASSOCIATIVE", "/agents/people/3"), ("IS_PARENT_OF", "/agents/people/2")]
    refs = spark.createDataFrame([(["/repositories/1/accessions/1", "/x/2"],)], "refs array<string>")
    assert refs.select(R.refs_to(F.col("refs")).alias("x")).first().x == ["/repositories/1/accessions/1"]
    said = spark.range(1).select(R.chunk_prefix(F.lit("Note of"), F.lit("Box"), F.lit("scope"), F.lit("")).alias("x")).first().x
    assert said == 'Note of "Box" - scope: '


def test_text_parts(spark):
    one = spark.range(1).select(T.sentences(F.lit("One. Two! Three")).alias("s"), T.paragraphs(F.lit("a\n \nb\nc")).alias("p"), T.year_of(F.lit("built 1850?")).alias("y"), T.year_of(F.lit("18500")).alias("n")).first()
    assert one.s == ["One.", "Two!", "Three"] and one.p == ["a", "b\nc"] and one.y == 1850 and one.n is None


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, '=a,"b"', ["x"], "[T](http://l/1)"), (2, "plain\ttext\nhere", [], "[U](http://l/2)")], "k int, v string, l array<string>, _p string")
    exports.write_csv(df.coalesce(1).drop("_p"), str(tmp_path / "c"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "c").glob("part-*")).decode()
    assert text == '\ufeffk,v,l\r\n1,"\'=a,""b""","[""x""]"\r\n2,plain text here,[]\r\n'
    assert rows_of(exports.csv_lines(df, guard=False, skip_private=True))[0] == ('1,"=a,""b""","[""x""]"',)
    assert exports.csv_header(df, skip_private=True) == "k,v,l"
    assert rows_of(exports.tsv_lines(df.select("_p", "k", "v"), link="_p"))[0] == ('1\t=a,"b"\thttp://l/1',)
    assert exports.markdown_table(df.select("k", "v"), ["k"], 0) == '| k | v |\n| --- | --- |\n| 1 | =a,"b" |'
    result = exports.tabular([df.select("k"), df.select("k", "v")], 3)
    assert result["columns"] == ["k", "v"] and len(result["rows"]) == 3 and result["truncated"]
    assert exports.safe_spec_text('{"mark": "bar", "href": 1}') == '{"mark": "bar"}'
    assert cli.found(spark, "the", "/root/testdata/sf0.001", 5).count() == 5


def test_dossiers(spark):
    nodes = spark.createDataFrame([("/r/1", "T", "e1")], "uri string, title string, ead_id string")
    edges = spark.createDataFrame([("/r/1", "HAS_NOTE", "/n/1"), ("/o/1", "PART_OF", "/r/1")], "src string, rel string, dst string")
    notes = spark.createDataFrame([("/r/1", "p1", "scope", "short"), ("/r/1", "p2", "bio", "much longer")], "uri string, persistent_id string, type string, content string")
    text = knowledge.record_dossier("/r/1", nodes, edges, notes)
    assert text.split("\n") == ["ead_id: e1", "title: T", "HAS_NOTE: /n/1", "PART_OF: /o/1", "[bio] much longer", "[scope] short"]
    assert knowledge.record_dossier("/none", nodes, edges, notes) == ""
    entity = "id string, kind string, display_name string, agent_type string, exists_from string, exists_to string, event_type string, date string, description string, alternate_names array<string>, twin string, source_uri array<string>"
    entities = spark.createDataFrame([("a", "Agent", "Ida", "person", "1800", None, "", None, "d", ["I."], "/t/1", ["/s/2", "/s/1", "/none"]), ("b", "Agent", "Ida", None, None, None, None, None, None, [], None, [])], entity)
    relations = spark.createDataFrame([("a", "RICO_KNOWS", None, "Bo", "1820", "q", 0.5), ("a", "RICO_KNOWS", None, "Bo", "1820", "q", 0.5), ("a", "RICO_HAS_CHILD", "daughter", "Cy", None, "", 1.0)], "src string, rel string, nature string, other string, date string, quote string, confidence double")
    records = spark.createDataFrame([("/t/1", "Twin", "u"), ("/s/1", "S1", "u1"), ("/s/2", "S2", "u2")], "uri string, title string, url string")
    hits = spark.createDataFrame([("a", True), ("b", False)], "id string, top boolean")
    found = {r.id: r.dossier for r in knowledge.entity_dossiers(hits, entities, relations, records).collect()}
    assert found["a"].split("\n") == [
        "# Agent: Ida", "- type: person", "- exists from: 1800", "- description: d", "- also seen as: I.", "- archivist-created record: [Twin](u)", "Relationships (2):", "- daughter: Cy",
        '- knows: Bo (1820) — "q" [confidence 0.5]', "## Source records", "- [S2](u2) (uri /s/2)", "- [S1](u1) (uri /s/1)",
    ]
    assert found["b"].split("\n") == ["## Distinct same-name entity — Agent: Ida", "(no relationships recorded for this entity)"]
    assert rows_of(knowledge.entity_relations(spark.createDataFrame([("a", "RICO_KNOWS", "Bo"), ("a", "RICO_KNOWS", "Bo")], "src string, rel string, other string"), "a")) == [("knows", "Bo")]
    lexical = spark.createDataFrame([("a", 0.5), ("b", 2.0)], "id string, score double")
    assert rows_of(knowledge.entity_hits(lexical, lambda: lexical), "id") == [("b",)]
    assert rows_of(knowledge.entity_hits(lexical.where("score < 1"), lambda: lexical), "id") == [("b",)]


def test_model_calls_and_checkpoints(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, text string")
    out = knowledge.map_batches(rows, lambda texts: ['x {"v": 1} y' for _ in texts], "text", "answer")
    assert {r.graph.v for r in knowledge.parsed(out, "answer", "v int").collect()} == {1}
    assert {r.answer for r in knowledge.map_batches(rows, lambda texts: 1 / 0, "text", "answer").collect()} == {None}
    state = lambda *x: spark.createDataFrame([*x], "collection string, status string")
    old, done, failed = state(("a", "failed"), ("b", "done")), state(("a", "")), state(("c", ""))
    assert rows_of(knowledge.checkpoint_states(old, done, failed)) == [("a", "done"), ("b", "done"), ("c", "failed")]


def test_resolution_as_a_whole(spark):
    def entity(k, name, start=None, end=None):
        return (k, "agent", "corporate_body", [name], [name.split()], start, end, None, [])

    schema = "id int, type string, agent_type string, names array<string>, tokens array<array<string>>, start int, end int, year int, neighbours array<string>"
    rows = [entity(1, "north mill"), entity(2, "north mill"), entity(3, "north mill", 1900), entity(4, "north mill", None, 1850), entity(5, "old mill company"), entity(6, "old mill"), entity(7, "far away")]
    entities = spark.createDataFrame(rows, schema)
    relations = spark.createDataFrame([(5, 6, "hasSuccessor"), (1, 7, "knows")], "src int, dst int, type string")
    merged, stats = resolution.resolve(entities, relations)
    of = {r.node: r.cluster for r in merged.collect()}
    assert of[1] == of[2] and of.get(3) != of.get(4) and of.get(5, 5) != of.get(6, 6)
    one = stats.first()
    assert one.pooled_entities == 7 and one.merged_entities == 7 - sum(k != c for k, c in of.items()) and one.clusters_gt1 == len({c for k, c in of.items() if k != c})
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    scored = {(r.a, r.b): r.reason for r in resolution.scored_pairs(pairs, entities, "id").collect()}
    assert scored == {(1, 2): "same name", (3, 4): "date veto"}


def test_desk_rules(spark, tmp_path):
    folders = spark.createDataFrame([(1, 7, None, "Inbox"), (2, 7, 1, "Old")], "id int, user_id int, parent_id int, name string")
    assert not app.name_is_free(folders, 7, None, "INBOX") and app.name_is_free(folders, 7, 1, "inbox") and app.name_is_free(folders, 7, None, "inbox", exclude=1)
    assert [spark.range(1).select(app.clamped(n).alias("x")).first().x for n in (0, 50, 900)] == [1, 50, 200]
    old = spark.createDataFrame([(1, "a", 1, 1)], "k int, v string, made int, changed int")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    assert rows_of(tables.upsert(old, new, ["k"], "made", "changed", F.lit(9))) == [(1, "b", 1, 9), (2, "c", 9, 9)]
    tables.create_by_label(spark.createDataFrame([("A", 1), ("B", 2)], "label string, k int"), str(tmp_path / "n"))
    assert sorted(p.name for p in (tmp_path / "n").glob("label=*")) == ["label=A", "label=B"]
    assert tables.capped(old, 0)[1] and not tables.capped(old, 1)[1]


def test_guard_allows_named_functions_and_bounded_sizes(spark):
    things = spark.range(2000).selectExpr("id as k", "cast(id as string) as name", "array(id) as list")
    run = lambda query, **more: guard.run_guarded(spark, query, {"things": things}, **more)[0]
    refused = [
        "select current_user(), input_file_name() from things", "select current_user from things", "select * from range(3)", "select k from things where exists (select 1 from things t where t.k = 1 and uuid() = '')",
        "select k from things order by rand()", "select (select max(version()) from things)", "select spark_partition_id() from things", "select k, x from things lateral view json_tuple(name, 'a') t as x", "with a as (select session_user() u) select u from a",
    ]
    for query in refused:
        with pytest.raises(guard.Refused):
            run(query)
    assert run("select max(k) over (order by k) as m, upper(name) from things where k in (select k from things where k < 3) and name like '%1'").count() == 1
    assert run("with a as (select x from things lateral view explode(list) t as x) select count(*) as n, sum(case when x > 5 then 1 else 0 end) from a").first()[0] == 2000
    assert run("select filter(list, v -> v > 1)[0] as v from things where k = 4").first().v == 4
    with pytest.raises(guard.Refused, match="too large"):
        run("select count(*) from things a cross join things b cross join things c cross join things d")
    with pytest.raises(guard.Refused, match="too large"):
        run("select a.k from things a cross join things b", largest=1 << 20)
    with pytest.raises(guard.Refused, match="upper"):
        run("select upper(name) from things", functions=frozenset({"count"}))
