"""Upserts, replacements, deletions and look-ups on tables that are rewritten, not changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], created: str | None = None, updated: str | None = None, now: Column | None = None) -> DataFrame:
    """Property-wise merge: non-null values of new rows override, others are kept."""
    columns = [c for c in old.columns if c not in key]
    n = new.select(*(F.col(c).alias(f"__{c}") for c in new.columns), F.lit(True).alias("__new"))
    o = old.withColumn("__old", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    joined = o.join(n, on, "full_outer")
    value = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) if f"__{c}" in n.columns else F.col(c) for c in columns}
    if created and now is not None:
        value[created] = F.when(F.col("__old").isNull(), now).otherwise(F.col(created))
    if updated and now is not None:
        value[updated] = F.when(F.col("__new"), now).otherwise(F.col(updated))
    return joined.select(*(F.coalesce(k, f"__{k}").alias(k) for k in key), *(value[c].alias(c) for c in columns))


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key isn't there yet, once each, beside the old."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def replace_children(old: DataFrame, new: DataFrame, parent: str, touched: DataFrame | None = None) -> DataFrame:
    """Children of touched parents go, new ones come."""
    gone = (touched if touched is not None else new).select(parent).distinct()
    return old.join(gone, parent, "left_anti").unionByName(new)


def delete_using(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(other.select(*on), on, "left_anti")


def insert_where_exists(old: DataFrame, new: DataFrame, other: DataFrame, on: list[str], key: list[str]) -> DataFrame:
    return insert_missing(old, new.join(other.select(*on), on, "left_semi"), key)


def guarded_update(rows: DataFrame, allowed: Column, **values: Column) -> DataFrame:
    for name, value in values.items():
        rows = rows.withColumn(name, F.when(allowed, value).otherwise(F.col(name)))
    return rows


def partial_update(rows: DataFrame, where: Column, **given) -> DataFrame:
    """Only given values that aren't None change."""
    return rows.withColumns({k: F.when(where, F.lit(v)).otherwise(F.col(k)) for k, v in given.items() if v is not None})


def delete_tree(root: DataFrame, levels: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Cascade: levels are (rows, own key, parent key); returns what is left of each."""
    gone, left = root.select(F.col(root.columns[0]).alias("__gone")), []
    for rows, own, parent in levels:
        lost = rows.join(gone, F.col(parent) == F.col("__gone"), "left_semi")
        left.append(rows.join(gone, F.col(parent) == F.col("__gone"), "left_anti"))
        gone = lost.select(F.col(own).alias("__gone"))
    return left


def ordered_lookup(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a list of ids (pos, key) in its order; missing ones are left out."""
    return ids.join(rows, key).orderBy("pos")


def strict_lookup(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The same, but a missing id is an error."""
    missing = ids.join(rows, key, "left_anti")
    lost = [r[0] for r in missing.select(key).limit(10).collect()]
    if lost:
        raise KeyError(f"not found: {lost}")
    return ordered_lookup(rows, ids, key)


def latest(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


def capped(rows: DataFrame, cap: int) -> tuple[DataFrame, bool]:
    """At most cap rows, and whether there are more."""
    return rows.limit(cap), bool(rows.limit(cap + 1).count() > cap)


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def wipe(nodes: DataFrame, edges: DataFrame, keep: Column, key: str = "uri") -> tuple[DataFrame, DataFrame]:
    """What a wipe leaves: the nodes that `keep` names, and the edges between them."""
    left = nodes.where(F.coalesce(keep, F.lit(False)))
    ids = left.select(F.col(key).alias("__k"))
    return left, edges.join(ids, F.col("src") == F.col("__k"), "left_semi").join(ids, F.col("dst") == F.col("__k"), "left_semi")


def create_by_label(rows: DataFrame, path: str, label: str = "label") -> None:
    """Bulk creation: rows appended to one folder for each label. Rows of a label are spread over tasks, so none is hot."""
    rows.write.partitionBy(label).mode("append").parquet(path)


def write_vectors(nodes: DataFrame, vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """nodes with the vectors that are given; others keep their own."""
    new = vectors.select(key, F.col(column).alias("__new"))
    old = F.col(column) if column in nodes.columns else F.lit(None).cast(vectors.schema[column].dataType)
    return nodes.join(new, key, "left").withColumn(column, F.coalesce("__new", old)).drop("__new")


def returned(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows that an upsert of new into old touches, as they are afterwards."""
    return upsert(old.join(new.select(*key), key, "left_semi"), new, key)
