"""Nested source records to node and edge tables, one pass for each kind of record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as St

from ledgerloom.functions import records as R
from ledgerloom.functions import text as T

#: Fields that never become properties (fixed values).
LEFT_OUT = ("system_mtime", "jsonmodel_type", "lock_version", "repository", "classifications")
DATE_FIELDS = ("create_time", "user_mtime")
ROLES = {"creator": "CREATED_BY", "subject": "HAS_SUBJECT", "source": "SOURCE"}
OTHER_ROLE = "RELATED_TO"


def scalars(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns of plain values; nested ones are read by their own functions."""
    nested = (St.ArrayType, St.MapType, St.StructType)
    return [f.name for f in df.schema if not isinstance(f.dataType, nested) and f.name not in exclude and f.name not in LEFT_OUT]


def properties(df: DataFrame, key: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Scalar columns, audit fields renamed; timestamps parsed beside their own text, which a failed parse keeps."""
    out = df.select(key, *(c for c in scalars(df, exclude) if c != key)).withColumnsRenamed(R.AUDIT_NAMES)
    return out.withColumns({f"{c}_ts": R.timestamp_or_null(F.col(c)) for c in DATE_FIELDS if c in out.columns})


def node(df: DataFrame, key: str, exclude: tuple[str, ...] = (), **derived: Column) -> DataFrame:
    extra = df.select(F.col(key).alias("__key"), *(c.alias(n) for n, c in derived.items()))
    kept = properties(df, key, tuple(exclude) + tuple(derived))
    return kept.join(extra, F.col(key) == F.col("__key")).drop("__key") if derived else kept


def collections(raw: DataFrame) -> DataFrame:
    """Collection nodes of resource records."""
    made = {"collection_type_prefix": R.collection_prefix(F.col("id_0"))}
    if "lang_materials" in raw.columns:
        made["languages"] = R.languages(F.col("lang_materials"))
    if "dates" in raw.columns:
        made["dates_by_type"] = R.date_pivot(F.coalesce("dates", F.array().cast(raw.schema["dates"].dataType)))
    return raw.select(*(c for c in scalars(raw)), *(c.alias(n) for n, c in made.items())).withColumnsRenamed(R.AUDIT_NAMES)


def archival_objects(raw: DataFrame) -> DataFrame:
    made = [R.parent_uri(F.col("parent"), F.col("resource")).alias("parent_uri"), F.col("resource.ref").alias("resource_uri"), R.digital_refs(F.col("instances")).alias("digital_objects"), R.container_types(F.col("instances")).alias("container_instance_types")]
    return raw.select(*scalars(raw), *made).withColumnsRenamed(R.AUDIT_NAMES)


def agents(raw: DataFrame) -> DataFrame:
    made = [R.agent_type(F.col("uri")).alias("agent_type"), R.display_name(F.col("names")).alias("display_name"), R.existence_dates(F.col("dates_of_existence")).alias("__e")]
    return raw.select(*scalars(raw, ("agent_type",)), *made).select("*", "__e.*").drop("__e").withColumnsRenamed(R.AUDIT_NAMES)


def notes(raw: DataFrame, parent: str = "uri") -> tuple[DataFrame, DataFrame]:
    """Note nodes and HAS_NOTE edges; notes without a persistent_id are left out."""
    one = raw.select(F.col(parent).alias("src"), F.explode("notes").alias("n")).where(F.coalesce(F.col("n.persistent_id"), F.lit("")) != "")
    parts = F.concat(F.coalesce(F.col("n.content"), F.array().cast("array<string>")), F.coalesce(F.transform("n.subnotes", lambda s: s["content"].cast("string")), F.array().cast("array<string>")))
    table = one.select(F.col("n.persistent_id").alias("persistent_id"), F.col("n.type").alias("type"), F.col("n.label").alias("label"), T.note_content(parts).alias("content"), F.coalesce(F.col("n.publish"), F.lit(False)).alias("publish")).dropDuplicates(["persistent_id"])
    return table, one.select("src", F.lit("HAS_NOTE").alias("rel"), F.col("n.persistent_id").alias("dst")).distinct()


def agent_edges(raw: DataFrame, parent: str = "uri") -> DataFrame:
    """Edges to linked agents by role; roles without a name of their own share one."""
    roles = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    one = raw.select(F.col(parent).alias("src"), F.explode("linked_agents").alias("a")).where(F.col("a.ref").isNotNull())
    return one.select("src", F.coalesce(F.try_element_at(roles, F.col("a.role")), F.lit(OTHER_ROLE)).alias("rel"), F.col("a.ref").alias("dst")).distinct()


def related_agents(raw: DataFrame) -> DataFrame:
    one = raw.select(F.col("uri").alias("src"), F.explode("related_agents").alias("a")).where(F.col("a.ref").isNotNull())
    return one.select("src", T.relation_type(F.coalesce(R.filled(F.col("a.relator")), F.lit("associative"))).alias("rel"), F.col("a.ref").alias("dst")).distinct()


def part_edges(objects: DataFrame) -> DataFrame:
    """HAS_PART from each object's parent; objects without one have none."""
    return objects.where(F.col("parent_uri") != "").select(F.col("parent_uri").alias("src"), F.lit("HAS_PART").alias("rel"), F.col("uri").alias("dst")).distinct()


def children(raw: DataFrame, column: str, parent: str = "uri") -> DataFrame:
    """One row for each entry of an array of structs, beside its parent."""
    return raw.select(F.col(parent).alias("parent_uri"), F.explode(column).alias("c")).select("parent_uri", "c.*")


def unfilled_stubs(agents_: DataFrame) -> DataFrame:
    """Agents that only links have named so far, and that haven't failed."""
    return agents_.where(F.col("display_name").isNull() & ~F.coalesce(F.col("fetch_failed"), F.lit(False))).select("uri")
