"""Knowledge-graph steps: text surface, chunk packing, extraction by a pluggable model, checkpoints, dossiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import records as R
from ledgerloom.functions import text as T
from ledgerloom.lineage import cut
from ledgerloom.operators.graph import closure
from ledgerloom.operators.passages import pack, split_rows

CHUNK_TOKENS, OVERHEAD, UNIT_CHARS = 3000, 20, 6000
RELATION_CAPS, SOURCES = (60, 25), 12
DOSSIER_CHARS = 15_000


def surface(collections: DataFrame, parts: DataFrame, titles: DataFrame, notes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """collection, i, source_uri, kind and text: titles and narrative notes of everything in a collection, numbered.

    collections: node; parts: src, dst; titles: uri, title; notes: uri, persistent_id, type, content."""
    inside = closure(parts, collections).select(F.col("root").alias("collection"), F.col("node").alias("uri"), "depth")
    named = inside.join(titles, "uri").select("collection", "depth", "uri", F.lit("title").alias("kind"), F.col("title").alias("text"), F.lit("").alias("pid"))
    told = inside.join(notes.where(F.col("type").isin(*kinds)), "uri").select("collection", "depth", "uri", F.col("type").alias("kind"), F.col("content").alias("text"), F.col("persistent_id").alias("pid"))
    units = named.unionByName(told).where(F.coalesce(F.col("text"), F.lit("")) != "").distinct()
    pieces = split_rows(units, "text", UNIT_CHARS)
    order = Window.partitionBy("collection").orderBy("depth", "uri", F.desc(F.col("kind") == "title"), "pid", "k")
    return pieces.select("collection", (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("uri").alias("source_uri"), "kind", F.col("piece").alias("text"))


def packed(units: DataFrame, budget: int = CHUNK_TOKENS) -> DataFrame:
    """collection, i and chunk number: units in order fill chunks of about `budget` tokens."""
    return pack(units.withColumn("size", T.estimated_tokens(F.col("text")) + OVERHEAD), "collection", "i", "size", budget).withColumnRenamed("bin", "chunk")


def map_batches(rows: DataFrame, call: Callable[[list[str]], list[str]], column: str, out: str, retries: int = 2) -> DataFrame:
    """A model as a function of texts, by batch, tried again on failure; null once it has failed for good."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answer: list = [None] * len(b)
            for left in range(retries, -1, -1):
                try:
                    answer = call(b[column].tolist())
                    break
                except Exception:
                    if not left:
                        break
            yield b.assign(**{out: answer})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` string"
    return rows.select(*names).mapInPandas(run, schema)


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The JSON object in a model's answer; rows whose answer holds none have a null."""
    return rows.withColumn("graph", F.from_json(T.json_object(F.col(column)), schema))


def checkpoint_states(old: DataFrame, done: DataFrame, failed: DataFrame, key: str = "collection") -> DataFrame:
    """Status of each collection: the newest outcome wins."""
    new = done.select(key, F.lit("done").alias("status")).unionByName(failed.select(key, F.lit("failed").alias("status")))
    return old.select(key, "status").join(new.select(key), key, "left_anti").unionByName(new)


def junk_free(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.where(~T.is_junk(F.col(text)))


def relevant(question: str, chunks: DataFrame, judge: Callable[[str, list[str]], list[bool]], text: str = "text", rescue: Column | None = None, keep: int = 2, order: str = "rank") -> DataFrame:
    """Chunks a judge finds relevant; a judge that fails keeps its batch. If none is left, up to `keep` that `rescue` names."""
    names, schema = chunks.columns, chunks.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield b[pd.Series(judge(question, b[text].tolist()), index=b.index).astype(bool)]
            except Exception:
                yield b

    kept = cut(chunks.select(*names).mapInPandas(run, schema), "judged")  # a judge is asked once
    return chunks.where(rescue).orderBy(order).limit(keep) if rescue is not None and kept.isEmpty() else kept


def record_dossier(uri: str, nodes: DataFrame, edges: DataFrame, notes: DataFrame, caps: tuple[int, int] = (15, 15)) -> str:
    """One record as text: properties, neighbours in either direction, notes from the longest, within a budget."""
    one = nodes.where(F.col("uri") == uri)
    props = F.create_map(*(x for c in nodes.columns for x in (F.lit(c), F.col(c).cast("string"))))
    card = one.select(R.property_card(props, ("uri",))).first()
    if card is None:
        return ""
    near = edges.where(F.col("src") == uri).select("rel", F.col("dst").alias("other")).unionByName(edges.where(F.col("dst") == uri).select("rel", F.col("src").alias("other"))).distinct()
    linked = near.orderBy("rel", "other").limit(sum(caps)).collect()
    told = notes.where(F.col("uri") == uri).orderBy(F.desc(F.length("content")), "persistent_id").limit(200).collect()
    text = "\n".join([card[0], *(f"{r}: {o}" for r, o in linked), *(f"[{n['type']}] {n['content']}" for n in told)])
    return text if len(text) <= DOSSIER_CHARS else text[:DOSSIER_CHARS] + "\n[truncated]"


def entity_hits(lexical: DataFrame, semantic: Callable[[], DataFrame], floor: float = 1.0, vector_floor: float = 0.80, hits: int = 8) -> DataFrame:
    """Entities found by words above a floor; by vectors only if there are none."""
    found = lexical.where(F.col("score") >= floor).orderBy(F.desc("score"), "id").limit(hits)
    return semantic().where(F.col("score") >= vector_floor).orderBy(F.desc("score"), "id").limit(hits) if found.isEmpty() else found


def names_agree(query: Column, names: Column) -> Column:
    """Whether every distinctive token of the query is in some candidate name."""
    all_tokens = F.array_distinct(F.flatten(F.transform(names, lambda n: T.name_tokens(T.normal_name(n)))))
    return F.size(F.array_except(T.name_tokens(T.normal_name(query)), all_tokens)) == 0


#: Labels of an entity's fields in a dossier, in order (fixed values).
CARD = {"agent_type": "type", "exists_from": "exists from", "exists_to": "exists to", "event_type": "event type", "date": "date", "description": "description"}


def entity_dossiers(hits: DataFrame, entities: DataFrame, relations: DataFrame, records: DataFrame) -> DataFrame:
    """id and dossier of found entities: card, twin record, relations, sources.

    hits: id, top (whether it's the best one); entities: id, kind, display_name, the fields of CARD,
    alternate_names, twin, source_uri; relations: src, rel, nature, other, date, quote, confidence;
    records: uri, title, url. Relations go by type and name, 60 for the best entity and 25 for its
    namesakes, each line once; sources are 12 at most."""
    said = F.concat(F.lit("- "), T.humanised(F.col("rel"), F.col("nature")), F.lit(": "), F.col("other"))
    said = F.concat(said, F.coalesce(F.concat(F.lit(" ("), R.filled(F.col("date")), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(' — "'), R.filled(F.col("quote")), F.lit('"')), F.lit("")))
    said = F.concat(said, F.when(F.col("confidence") < 0.95, F.format_string(" [confidence %.1f]", F.col("confidence").cast("double"))).otherwise(""))
    order = Window.partitionBy("id").orderBy("rel", "other", "line")
    lines = relations.join(hits.select(F.col("id").alias("src"), "top"), "src").select(F.col("src").alias("id"), "top", "rel", "other", said.alias("line")).withColumn("n", F.row_number().over(order))
    lines = lines.where(F.col("n") <= F.when(F.col("top"), RELATION_CAPS[0]).otherwise(RELATION_CAPS[1])).groupBy("id", "line").agg(F.min("n").alias("n"))
    told = lines.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))
    cited = entities.join(hits.select("id"), "id").select("id", F.posexplode("source_uri").alias("at", "uri")).join(records, "uri").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("at")))
    sources = cited.where(F.col("n") <= SOURCES).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(") (uri "), "uri", F.lit(")")).alias("line")))), lambda x: x["line"]).alias("sources"))
    twins = records.select(F.col("uri").alias("twin"), F.concat(F.lit("- archivist-created record: ["), "title", F.lit("]("), "url", F.lit(")")).alias("twin_line"))
    e = entities.join(hits, "id").join(twins, "twin", "left").join(told, "id", "left").join(sources, "id", "left")
    head = F.concat(F.when(F.col("top"), F.lit("# ")).otherwise(F.lit("## Distinct same-name entity — ")), "kind", F.lit(": "), "display_name")
    card = [F.concat(F.lit(f"- {label}: "), R.filled(F.col(c))) for c, label in CARD.items()]
    also = F.when(F.size("alternate_names") > 0, F.concat(F.lit("- also seen as: "), F.array_join(F.slice("alternate_names", 1, 6), ", ")))
    near = F.when(F.col("lines").isNull(), F.lit("(no relationships recorded for this entity)")).otherwise(F.concat(F.lit("Relationships ("), F.size("lines").cast("string"), F.lit("):\n"), F.array_join("lines", "\n")))
    return e.select("id", F.concat_ws("\n", head, *card, also, "twin_line", near, F.when(F.col("sources").isNotNull(), F.concat(F.lit("## Source records\n"), F.array_join("sources", "\n")))).alias("dossier"))


def entity_relations(edges: DataFrame, node: str, first: bool = True) -> DataFrame:
    """An entity's relations in order of type and name, capped, each line once."""
    cap = RELATION_CAPS[0 if first else 1]
    return edges.where(F.col("src") == node).select(T.humanised(F.col("rel")).alias("said"), "other").distinct().orderBy("said", "other").limit(cap)
