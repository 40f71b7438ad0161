"""Golden cases of text, record and resolution functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import records as R
from ledgerloom.functions import text as T
from ledgerloom.operators import exports, guard, passages, resolution


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("given", "wanted"), [("MSS:5", "Mss"), (" Mss:66", "Mss"), ("ARCH QX 1.5", "Arch"), ("", "Other"), ("X:1", "X")])
def test_collection_prefix(spark, given, wanted):
    assert one(spark, R.collection_prefix(F.col("v")), v=given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("Elm & Ash Rail-Road Corp.", "elm and ash railroad corporation"), ("Roe, Jane, 1811-1877", "roe jane")])
def test_normal_name(spark, given, wanted):
    assert one(spark, T.normal_name(F.col("v")), v=given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("By: Ida Orr and Cy Poe.", ["Ida Orr", "Cy Poe"]), ("signed by the owner", [])])
def test_credits(spark, given, wanted):
    assert one(spark, T.credits(F.col("v")), v=given) == wanted


def test_names_and_addresses(spark):
    assert one(spark, T.relation_constant(F.col("v")), v="isOrWasLeaderOf") == "RICO_IS_OR_WAS_LEADER_OF"
    assert one(spark, T.relation_type(F.col("v")), v="is_part_of") == "IS_PART_OF"
    assert one(spark, R.public_url("http://b", F.col("v")), v="/repositories/3/resources/42") == "http://b/resources/42#tree::resource_42"
    assert one(spark, R.public_url("http://b", F.col("v")), v="/odd") == ""
    assert one(spark, R.agent_type(F.col("v")), v="/agents/corporate_entities/1") == "corporate_entity"
    assert one(spark, R.agent_type(F.col("v")), v="/agents/robots/1") == "robots"
    assert one(spark, T.safe_path(F.col("v")), v="a/./b") == "a/b"
    assert one(spark, T.safe_path(F.col("v")), v="a/../b") is None


def test_redaction(spark):
    text = "Stay here. Leave out the Ledger line. Stay there; leave [:HOLDS] out."
    assert one(spark, T.redacted(F.col("v"), ["Ledger", "HOLDS"]), v=text) == "Stay here. Stay there;"


def test_lexical_query():
    assert T.lexical_query_text("boat timber") == '"boat timber"^2 OR (boat timber) OR (boat timber~1)'
    assert T.lexical_query_text("boat") == "boat"


def test_initials():
    assert resolution.initials_agree(["e", "q", "poe"], ["poe", "edgar", "q"])
    assert not resolution.initials_agree(["e", "q"], ["edgar", "quill"])


def entity(name, **more):
    base = {"type": "agent", "agent_type": "person", "names": [name], "tokens": [name.split()], "start": None, "end": None, "year": None, "neighbours": []}
    return base | more


def test_pair_scores():
    assert resolution.score_pair(entity("ann lee"), entity("ann lee")) == (1.0, "same name")
    assert resolution.score_pair(entity("ann lee", start=1900), entity("ann lee", end=1880))[1] == "date veto"
    assert resolution.score_pair(entity("ann lee", start=1851), entity("ann lee", start=1867))[0] == 0.88
    assert resolution.score_pair(entity("ann lee"), entity("ann lee", type="place"))[0] == 0


def test_clusters_refuse_conflicts():
    assert resolution.greedy_clusters([(1, 2), (2, 3)], {(1, 3)}) == {1: 1, 2: 1, 3: 3}
    assert set(resolution.greedy_clusters([(1, 2), (2, 3)], set()).values()) == {1}


def test_clusters_by_hand():
    """Against a comparison of all members at every union."""
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(2, 14)
        pairs = [tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(1, 25))]
        bad = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(0, 8))}
        of = {}
        for a, b in pairs:
            x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
            if x is not y and not any((min(p, q), max(p, q)) in bad for p in x for q in y):
                for m in (both := x | y):
                    of[m] = both
        assert resolution.greedy_clusters(pairs, bad) == {k: min(v) for k, v in of.items()}


def test_chunks():
    assert passages.chunk_text("  ") == []
    assert passages.chunk_text(" a  b ") == ["a  b"]
    text = " ".join(f"Sentence number {k} is here." for k in range(100))
    chunks = passages.chunk_text(text, 300, 60)
    assert len(chunks) > 3 and all(b.split(" ", 1)[0] in a for a, b in zip(chunks, chunks[1:]))
    assert passages.split_long("x" * 10, 4) == ["xxxx", "xxxx", "xx"]


def test_chunks_of_one_long_run():
    """Slices lose outer blanks where they are joined, not where they open a chunk."""
    first, second, third = passages.chunk_text("abcd " * 600)
    assert first == ("abcd " * 200).strip() and len(first) == 999
    assert second == ("abcd " * 40).strip() + " " + "abcd " * 200  # the tail of 200 begins within a word, which goes
    assert third == "abcd " * 39 + " " + ("abcd " * 200).strip()
    assert passages.chunk_text("aa bb\n\n cc  dd \n \nee", 100) == ["aa bb\n\n cc  dd \n \nee"]
    assert passages.chunk_text("aa bb.\n\n cc  dd \n \nee. ff", 10, 4) == ["aa bb.", "bb. cc dd", "dd ee. ff"]


def test_empty_parts_of_long_texts():
    assert passages.split_long("\n\naaaaaaaa\n\nbbbbbbbb", 15) == ["aaaaaaaa", "bbbbbbbb"]
    assert passages.split_long("x" * 15 + "   \n\nbbb", 15) == ["x" * 15, "bbb"]
    assert passages.split_long("aaa\n\n\n\n" + "y" * 14 + ". z", 15) == ["aaa", "y" * 14 + ".", "z"]
    assert passages.split_long(". " + "b" * 20, 10) == [". bbbbbbbb", "bbbbbbbbbb", "bb"]


def walk(seqs, matches, exists, taken, gap=2):
    """Positions outwards from a run, one by one."""
    kept, last = 0, 0
    for n, s in enumerate(seqs, 1):
        if not exists(s) or s in taken or n - last > gap + 1:
            break
        kept, last = (n, n) if matches(s) else (kept, last)
    return list(seqs)[:kept]


def test_walk_needs_a_later_match(spark):
    exists = set(range(10)).__contains__
    assert walk(range(1, 9), {3, 4}.__contains__, exists, set(), 2) == [1, 2, 3, 4]
    assert walk(range(1, 9), {5}.__contains__, exists, set(), 2) == []
    for hits, free in (({3, 4}, 9), ({5}, 9), ({1, 4, 8}, 9), ({2, 6}, 9), ({1, 2, 3}, 2), (set(), 9)):
        rows = spark.createDataFrame([(1, d, d <= free, d in hits) for d in range(1, 9)], "w int, d int, free boolean, matched boolean")
        assert sorted(r.d for r in passages.reach(rows, ["w"], 2).collect()) == walk(range(1, 9), hits.__contains__, lambda s: s <= free, set(), 2)
    texts = spark.createDataFrame([(1, 1, "1.2.3 and 1.2.4"), (1, 2, "3.4"), (2, 1, "2019.123 2019.123"), (3, 1, "1.1")], "run int, seq int, text string")
    assert {r.run: r.section for r in passages.section_of_runs(texts, ["run"], "seq", "text").collect()} == {1: "1.2", 2: "2019.123"}


def grown_by_hand(chunks):
    """chunks of one document: (seq, text, heading, score, kept, rank); sequential, run by run in order of rank."""
    by_seq = {c[0]: c for c in chunks}
    kept = sorted(c[0] for c in chunks if c[4])
    runs = []
    for s in kept:
        if runs and runs[-1][-1] == s - 1:
            runs[-1].append(s)
        else:
            runs.append([s])
    have, out = set(kept), {(s, k) for k, run in enumerate(runs) for s in run}
    for k, run in sorted(enumerate(runs), key=lambda x: min((by_seq[s][5], s) for s in x[1])):
        counts = {}
        for s in run:
            for m in re.findall(r"\b(\d+\.\d+)(?:\.\d+)*\b", by_seq[s][1]):
                counts[m] = counts.get(m, 0) + 1
        best = max(counts, key=counts.get, default=None)
        if best and counts[best] >= 2:
            matches = lambda s, b=best: bool(re.search(rf"\b{re.escape(b)}\.\d+\b", f"{by_seq[s][1]} {by_seq[s][2] or ''}"))
        else:
            matches = lambda s: by_seq[s][3] >= 0.8
        for way in (range(run[0] - 1, run[0] - 4, -1), range(run[-1] + 1, run[-1] + 31)):
            found = walk(way, matches, by_seq.__contains__, have)
            have |= set(found)
            out |= {(s, k) for s in found if len(by_seq[s][1].strip()) >= 30}
    return out


def test_section_growth_by_hand(spark):
    rng = random.Random(1)
    rows, wanted = [], set()
    for doc in range(60):
        chunks = []
        for s in range(rng.randint(3, 60)):
            if rng.random() < 0.05:
                continue
            text = " ".join(rng.choice(["1.2.3", "1.2", "2.7.1", "see rule", "of the house", "plain words stand here"]) for _ in range(rng.randint(1, 6)))
            chunks.append((s, text, rng.choice([None, "1.2.9", "about"]), rng.choice([0.1, 0.5, 0.85, 0.9]), rng.random() < 0.12, rng.randint(0, 50)))
        rows += [(doc, *c) for c in chunks]
        wanted |= {(doc, s, k) for s, k in grown_by_hand(chunks)}
    df = spark.createDataFrame(rows, "id int, seq long, text string, heading string, score double, kept boolean, rank int")
    junk = lambda text: len(text.strip()) < 30 or sum(c.isalpha() or c.isspace() for c in text) < 0.55 * len(text)
    bad = {(r[0], r[1]) for r in rows if junk(r[2]) and not r[5]}
    found = {(r.id, r.seq, r.run) for r in passages.section_growth(df, "id").collect()}
    assert found == {x for x in wanted if x[:2] not in bad}


def test_long_texts_part_at_blank_lines():
    assert passages.split_long("aaaaaaaaaa\n \nbbbbbbbbbb", 15) == ["aaaaaaaaaa", "bbbbbbbbbb"]
    assert passages.split_long("One two. Three four. Five.", 12) == ["One two.", "Three four.", "Five."]
    assert passages.split_long("a\n\nb\n\n" + "c" * 15 + "\n\nd", 10) == ["a\n\nb", "c" * 10, "ccccc\n\nd"]
    assert passages.split_long("short", 10) == ["short"]


def test_names_without_tokens_are_no_match():
    assert resolution.name_similarity(["the of"], ["the and"], [[]], [[]]) == 0.0
    assert resolution.name_similarity(["ann lee"], ["lee ann"], [["ann", "lee"]], [["lee", "ann"]]) > 0.6


@pytest.mark.parametrize("query", ["delete from t", "select 1; select 2", "", "select * from parquet.`/etc`", "insert into t select 1", "select reflect('a', 'b')"])
def test_guard_refuses(query):
    with pytest.raises(guard.Refused):
        guard.lexical_check(query)


def test_guard_plans(spark):
    tables = {"things": spark.range(5).toDF("k")}
    rows, more = guard.run_guarded(spark, "select k from things where k > 1", tables, 2)
    assert rows.count() == 2 and more
    spark.range(3).createOrReplaceTempView("hidden")
    with pytest.raises(guard.Refused):
        guard.run_guarded(spark, "select * from hidden", tables)


HIDING = [
    "select t.k, s.id from things t cross join hidden_table s",
    "select k from things union all select id from hidden_table",
    "select k from things where k in (select id from hidden_table)",
    "select k, (select max(id) from hidden_table) as m from things",
    "with h as (select id from hidden_table) select * from things join h on k = id",
    "select * from things where exists (select 1 from hidden_table where id = k)",
    "select * from hidden_view",
    "select k from things, lateral (select id from hidden_table where id = k)",
]
OPEN = ["with h as (select k from things) select a.k from h a join h b on a.k = b.k", "select 1 as x", "select * from values (1), (2)", "select count(*) from (select k from things group by k) where k > (select min(k) from things)", "select k from things order by k limit 2"]


def test_guard_checks_every_leaf(spark):
    """One allowed table opens no other, in joins, unions, subqueries, table expressions or views."""
    spark.sql("create table if not exists hidden_table using parquet as select id from range(3)")
    spark.sql("create or replace temp view hidden_view as select id from hidden_table")
    tables = {"things": spark.range(5).toDF("k")}
    for query in HIDING:
        with pytest.raises(guard.Refused):
            guard.run_guarded(spark, query, tables)
    for query in OPEN:
        assert guard.run_guarded(spark, query, tables)[0].count() >= 1
    spark.sql("drop table hidden_table")


def test_chart_specs():
    spec = {"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "mark": "bar", "data": {"values": [{"url": "kept", "b": 1}]}, "usermeta": {}, "encoding": {"href": 1, "x": {}}}
    safe = exports.safe_spec(spec)
    assert safe["data"]["values"] == [{"url": "kept", "b": 1}] and "usermeta" not in safe and "href" not in safe["encoding"]
    for bad in ({"data": {"url": "http://x"}}, {"mark": "image"}, {"mark": {"type": "image"}}):
        with pytest.raises(exports.UnsafeSpec):
            exports.safe_spec(bad)
