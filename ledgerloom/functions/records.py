"""Functions on nested descriptive records: dates, agents, identifiers, property cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUDIT_NAMES = {"created_by": "creating_user", "last_modified_by": "modifying_user"}
#: Spelling of collection types by their upper-case form (fixed values).
PREFIXES = {"MSS": "Mss", "ARCH": "Arch"}


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def timestamp_or_null(value: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00"))


def date_pivot(dates: Column) -> Column:
    """map of `date_<type>_<part>` from an array of dates; the last of a type wins."""


    def part(name: str) -> Column:
        return F.transform(dates, lambda d: F.struct(F.concat(F.lit("date_"), d["date_type"], F.lit(f"_{name}")).alias("key"), F.coalesce(d[name], F.lit("")).alias("value")))

    entries = F.flatten(F.array(*map(part, ("expression", "begin", "end"))))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])))


def languages(materials: Column) -> Column:
    found = F.transform(materials, lambda m: m["language_and_script"]["language"])
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != "")))


def display_name(names: Column) -> Column:
    first = F.try_element_at(names, F.lit(1))
    return F.coalesce(filled(first["sort_name"]), filled(first["primary_name"]), F.lit(""))


def agent_type(uri: Column) -> Column:
    plural = F.regexp_extract(uri, r"/agents/([^/]+)/", 1)
    return F.when(plural == "people", "person").when(plural == "corporate_entities", "corporate_entity").when(plural == "families", "family").when(plural == "software", "software").otherwise(plural)


def record_label(uri: Column) -> Column:
    """Kind of record by an anchored pattern; null for anything else."""
    out = F.lit(None).cast("string")
    for pattern, label in ((r"^/repositories/\d+/resources/\d+$", "Collection"), (r"^/repositories/\d+/archival_objects/\d+$", "ArchivalObject"), (r"^/repositories/\d+/accessions/\d+$", "Accession"), (r"^/repositories/\d+/digital_objects/\d+$", "DigitalObject"), (r"^/agents/[a-z_]+/\d+$", "Agent")):
        out = F.when(uri.rlike(pattern), label).otherwise(out)
    return out


def public_url(base: str, uri: Column, resource_uri: Column | None = None) -> Column:
    """Address of a record in the staff interface; empty for an unknown shape."""
    n = F.regexp_extract(uri, r"/(\d+)$", 1)
    kind = F.regexp_extract(uri, r"/([a-z_]+)/\d+$", 1)
    parent = F.regexp_extract(resource_uri, r"/(\d+)$", 1) if resource_uri is not None else F.lit("")
    at = F.lit(base.rstrip("/"))
    return (
        F.when(kind == "resources", F.concat(at, F.lit("/resources/"), n, F.lit("#tree::resource_"), n))
        .when((kind == "archival_objects") & (parent != ""), F.concat(at, F.lit("/resources/"), parent, F.lit("#tree::archival_object_"), n))
        .when(kind.isin("accessions", "digital_objects"), F.concat(at, F.lit("/"), kind, F.lit("/"), n))
        .when(uri.rlike(r"^/agents/[a-z_]+/\d+$"), F.concat(at, uri))
        .otherwise(F.lit(""))
    )


def collection_prefix(id_0: Column) -> Column:
    value = F.trim(F.coalesce(id_0, F.lit("")))
    head = F.upper(F.trim(F.substring_index(value, ":", 1)))
    named = F.when(head == "MSS", "Mss").when(head == "ARCH", "Arch").otherwise(F.trim(F.substring_index(value, ":", 1)))
    known = F.when(head.isin(*PREFIXES), named).otherwise(F.when(F.length(head) > 1, F.initcap(F.lower(head))).otherwise(head))
    return F.when(value == "", "Other").when(value.contains(":"), known).when(F.upper(value).startswith("ARCH"), "Arch").otherwise("Other")


def existence_dates(dates: Column) -> Column:
    """begin, end and expression of the first entry: of its range, else of its single date."""
    d = F.try_element_at(dates, F.lit(1))
    r, s = d["structured_date_range"], d["structured_date_single"]
    pick = lambda *c: F.coalesce(*(filled(x) for x in c), F.lit(""))
    begin, end = pick(r["begin_date_standardized"], r["begin_date_expression"], s["date_standardized"], s["date_expression"]), pick(r["end_date_standardized"], r["end_date_expression"])
    return F.struct(begin.alias("existence_begin"), end.alias("existence_end"), pick(s["date_expression"], F.concat_ws(" - ", filled(r["begin_date_expression"]), filled(r["end_date_expression"]))).alias("existence_expression"))


def digital_refs(instances: Column) -> Column:
    return F.filter(F.transform(instances, lambda i: i["digital_object"]["ref"]), lambda r: r.isNotNull())


def container_types(instances: Column) -> Column:
    plain = F.filter(instances, lambda i: i["digital_object"]["ref"].isNull() & i["instance_type"].isNotNull())
    return F.array_distinct(F.transform(plain, lambda i: i["instance_type"]))


def parent_uri(parent: Column, resource: Column) -> Column:
    return F.coalesce(filled(parent["ref"]), filled(resource["ref"]), F.lit(""))


def refs_to(refs: Column, part: str = "/accessions/") -> Column:
    return F.filter(refs, lambda r: r.contains(part))


def chunk_prefix(label: Column, name: Column, kind: Column, title: Column) -> Column:
    of = F.concat_ws(" ", label, F.when(filled(name).isNotNull(), F.concat(F.lit('"'), name, F.lit('"'))))
    what = F.coalesce(filled(title), filled(kind))
    return F.concat(F.concat_ws(" - ", filled(of), what), F.lit(": "))


def property_card(props: Column, skip: tuple[str, ...] = (), limit: int = 300) -> Column:
    """`key: value` lines of a map, keys sorted, blanks and skipped keys left out, long values cut."""
    entries = F.filter(F.map_entries(props), lambda e: e["value"].isNotNull() & (e["value"] != "") & (e["value"] != "[]") & ~e["key"].isin(*(skip or ("",))))
    cut = lambda v: F.when(F.length(v) > limit, F.concat(F.left(v, F.lit(limit)), F.lit("…"))).otherwise(v)
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit(": "), cut(e["value"]))), "\n")


def serialised(props: Column) -> Column:
    """`col: value; …` of a map, blanks left out."""
    kept = F.filter(F.map_entries(props), lambda e: e["value"].isNotNull() & ~e["value"].isin("", "nan", "None", "NaT"))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def normal_types(types: Column) -> Column:
    """`X NOT NULL` to X, lists to LIST, several joined by |."""
    one = F.transform(types, lambda t: F.when(t.startswith("LIST<"), "LIST").otherwise(F.regexp_replace(t, " NOT NULL$", "")))
    return F.array_join(F.array_sort(F.array_distinct(one)), "|")


def years_clash(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Whether two life spans are disjoint."""
    return F.coalesce(a_from > b_to, F.lit(False)) | F.coalesce(b_from > a_to, F.lit(False))


def years_differ(a: Column, b: Column, tolerance: int = 2) -> Column:
    return F.coalesce(F.abs(a - b) > tolerance, F.lit(False))
