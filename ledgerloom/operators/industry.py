"""Collection type and industry hierarchy of an identifier such as `MSS:123`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_APPLICABLE, NOT_FOUND = "Not Applicable", "Not Found"


def read_lookup(lines: DataFrame) -> DataFrame:
    """code and label from lines of text: split at the first comma alone, header skipped, last code wins."""
    numbered = lines.withColumn("__n", F.monotonically_increasing_id())
    parts = F.split("value", ",", 2)
    rows = numbered.where("__n > 0").select(F.trim(parts[0]).alias("code"), F.trim(F.get(parts, F.lit(1))).alias("label"), "__n").where("code <> '' and label is not null")
    return rows.groupBy("code").agg(F.max_by("label", "__n").alias("label"))


def code_of(id_0: Column) -> Column:
    """First token after `MSS:`, in any case; null for other identifiers."""
    value = F.trim(F.coalesce(id_0, F.lit("")))
    return F.when(F.upper(value).startswith("MSS:"), F.split(F.trim(F.substring(value, 5, 10_000)), r"\s+")[0])


def with_industry(rows: DataFrame, id_0: str, lookup: DataFrame) -> DataFrame:
    """Adds code, label, path, and top and second level. The lookup is a code list, joined three times."""
    found = rows.withColumn("industry_code", code_of(F.col(id_0)))
    for alias, key in (("own", F.col("industry_code")), ("top", F.left("industry_code", F.lit(1))), ("second", F.left("industry_code", F.lit(2)))):
        found = found.join(lookup.select(F.col("code").alias(f"__{alias}_code"), F.col("label").alias(f"__{alias}")), F.col(f"__{alias}_code") == key, "left").drop(f"__{alias}_code")
    n, mss = F.length("industry_code"), F.col("industry_code").isNotNull()
    label, top = F.coalesce("__own", F.lit(NOT_FOUND)), F.coalesce("__top", F.lit(NOT_FOUND))
    second = F.coalesce("__second", F.lit("None"))
    path = F.when(n == 0, NOT_FOUND).when(n == 1, label).when(n == 2, F.concat_ws("-", top, label)).otherwise(F.concat_ws("-", top, second, label))
    outside = lambda c: F.when(mss, c).otherwise(F.lit(NOT_APPLICABLE))
    columns = {
        "industry_code": outside(F.col("industry_code")), "industry_label": outside(label), "industry_path": outside(path),
        "industry_top_code": outside(F.when(n == 0, NOT_FOUND).otherwise(F.left("industry_code", F.lit(1)))), "industry_top": outside(top),
        "industry_second_code": outside(F.when(n < 2, "None").otherwise(F.left("industry_code", F.lit(2)))), "industry_second": outside(F.when(n < 2, "None").otherwise(second)),
    }
    return found.withColumns({f"__new_{k}": v for k, v in columns.items()}).drop("__own", "__top", "__second", "industry_code").withColumnsRenamed({f"__new_{k}": k for k in columns})
