"""The schema catalogue: assembled from live properties and edges, filtered, redacted."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import records as R
from ledgerloom.functions import text as T


def properties_of(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(label, property, type) of live tables, from their schemas."""
    return [(name, f.name, f.dataType.simpleString().upper()) for name, df in sorted(tables.items()) for f in df.schema]


def assemble(node_props: DataFrame, edges: DataFrame) -> DataFrame:
    """label, properties (name: type), relationships (rel, direction, labels at the other end).

    node_props: label, property, types; edges: rel, start_label, end_label."""
    props = node_props.groupBy("label").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("property", R.normal_types(F.col("types")).alias("type"))))).alias("properties"))
    ends = edges.select(F.col("start_label").alias("label"), "rel", F.lit("out").alias("direction"), F.col("end_label").alias("other")).unionByName(edges.select(F.col("end_label").alias("label"), "rel", F.lit("in").alias("direction"), F.col("start_label").alias("other")))
    near = ends.groupBy("label", "rel", "direction").agg(F.sort_array(F.collect_set("other")).alias("labels"))
    relations = near.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rel", "direction", "labels"))).alias("relationships"))
    return props.join(relations, "label", "full_outer")


def metadata(rows: DataFrame, known: DataFrame, denied: list[str]) -> DataFrame:
    """Catalogue rows (schema_type, name, description) of known names, redacted; rows that still offend go."""
    bad = "|".join(map(re.escape, denied)) if denied else r"(?!)"
    kept = rows.join(known.select("name"), "name", "left_semi").where(~F.col("name").rlike(bad))
    clean = kept.withColumn("description", T.redacted(F.col("description"), denied) if denied else F.col("description"))
    return clean.where(~F.coalesce(F.col("description").rlike(bad), F.lit(False)))


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct (start_label, rel, end_label)."""
    return edges.select("start_label", "rel", "end_label").distinct()
