"""Checks of what a model or a user hands in: extracted graphs and tool calls. Errors are rows; nothing is raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import resolution as R
from ledgerloom.sources.files import RELATIONS

#: Menus of the extraction format (fixed values).
ENTITY_TYPES = ("agent", "place", "event")
AGENT_TYPES = ("person", "family", "corporate_body")
GENERIC = "inferredGenericRelationship"
RELATION_MENU = (*sorted({w for line in RELATIONS.split("\n") for w in line.split()}), GENERIC)
#: JSON types that a declared argument type takes (fixed values); a boolean is no number.
ARGUMENT_TYPES = {"str": ("STRING",), "int": ("BIGINT", "INT"), "float": ("DOUBLE", "DECIMAL"), "bool": ("BOOLEAN",)}


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def in_menu(c: Column, menu) -> Column:
    return F.coalesce(c.isin(*menu), F.lit(False))


def with_evidence_check(rows: DataFrame, units: DataFrame, key: list[str]) -> DataFrame:
    """rows with `cited`: there is evidence, and every index of it names a unit."""
    each = rows.select(*key, F.explode("evidence").alias("i")).join(units.select("i", F.lit(True).alias("known")), "i", "left")
    whole = each.groupBy(*key).agg(F.min(F.coalesce("known", F.lit(False))).alias("cited"))
    return rows.join(whole, key, "left").withColumn("cited", F.coalesce("cited", F.lit(False)))


def entity_errors(entities: DataFrame, units: DataFrame) -> DataFrame:
    """n and error of each fault of an entity (n, id, name, type, agent_type, evidence)."""
    first = entities.where(~blank(F.col("id"))).groupBy("id").agg(F.min("n").alias("first"))
    rows = with_evidence_check(entities, units, ["n"]).join(first, "id", "left")
    faults = [
        (blank(F.col("id")), "no id"), (~blank(F.col("id")) & (F.col("n") > F.col("first")), "duplicate id"), (blank(F.col("name")), "no name"),
        (~in_menu(F.col("type"), ENTITY_TYPES), "invalid type"), (F.col("type").eqNullSafe("agent") & ~in_menu(F.col("agent_type"), AGENT_TYPES), "invalid agent_type"), (~F.col("cited"), "evidence"),
    ]
    return rows.select("n", F.explode(F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), said) for bad, said in faults)), lambda x: x.isNotNull())).alias("error"))


def relation_errors(relations: DataFrame, entities: DataFrame, units: DataFrame) -> DataFrame:
    """n and error of each fault of a relation (n, src, dst, type, quote, evidence)."""
    ids = entities.where(~blank(F.col("id"))).select("id").distinct()
    ends = lambda c: ids.select(F.col("id").alias(c), F.lit(True).alias(f"has_{c}"))
    rows = with_evidence_check(relations, units, ["n"]).join(ends("src"), "src", "left").join(ends("dst"), "dst", "left")
    proved = R.proved_quotes(relations, units).select("n", F.lit(True).alias("proved"))
    rows = rows.join(proved, "n", "left")
    faults = [
        (F.col("has_src").isNull() | F.col("has_dst").isNull(), "unknown end"), (F.col("src").eqNullSafe(F.col("dst")), "relates to itself"),
        (~in_menu(F.col("type"), RELATION_MENU), "type not in menu"), (~F.col("cited"), "evidence"), (~blank(F.col("quote")) & F.col("cited") & F.col("proved").isNull(), "quote not in evidence"),
    ]
    return rows.select("n", F.explode(F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), said) for bad, said in faults)), lambda x: x.isNotNull())).alias("error"))


def salvage(entities: DataFrame, relations: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid part of a graph: entities without faults but repeated ids, and relations between them without any."""
    good = entities.join(entity_errors(entities, units).where("error <> 'duplicate id'").select("n"), "n", "left_anti")
    return good, relations.join(relation_errors(relations, good, units).select("n"), "n", "left_anti")


def call_errors(calls: DataFrame, spec: DataFrame) -> DataFrame:
    """call, tool and error: the first fault of each call (call, tool, arguments as JSON text).

    spec: tool, argument, type, required. Unknown tools come first, then unexpected arguments, then
    missing ones and wrong types in the order of the specification's names."""
    known = spec.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("argument", "type", "required"))).alias("declared"))
    rows = calls.join(known, "tool", "left")
    given = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
    extra = F.array_sort(F.array_except(given, F.transform("declared", lambda a: a["argument"])))
    variant = F.try_parse_json("arguments")

    def fault(a: Column) -> Column:
        kind = F.regexp_replace(F.schema_of_variant(F.try_variant_get(variant, F.concat(F.lit("$."), a["argument"]), "variant")), r"\(.*", "")
        wrong = F.lit(False)
        for name, kinds in ARGUMENT_TYPES.items():
            wrong = F.when(a["type"] == name, ~F.coalesce(kind.isin(*kinds), F.lit(False))).otherwise(wrong)
        missing = ~F.array_contains(given, a["argument"])
        return F.when(missing & a["required"], F.concat(F.lit("missing "), a["argument"])).when(~missing & wrong, F.concat(F.lit("wrong type of "), a["argument"]))

    first = F.try_element_at(F.filter(F.transform("declared", fault), lambda x: x.isNotNull()), F.lit(1))
    error = F.when(F.col("declared").isNull(), "unknown tool").when(F.size(extra) > 0, F.concat(F.lit("unexpected "), F.array_join(extra, ","))).otherwise(first)
    return rows.select("call", "tool", error.alias("error")).where("error is not null")
