"""Exports: CSV, TSV and Markdown files of rows, and chart specifications made safe."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as St

from ledgerloom.functions import text as T

BOM = "\ufeff"
#: Rows of a rendered table at most (fixed value).
MOST_ROWS = 200


def as_text(field: St.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (St.ArrayType, St.MapType, St.StructType)):
        return F.to_json(c)
    if isinstance(field.dataType, (St.TimestampType, St.DateType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if isinstance(field.dataType, St.TimestampType) else c.cast("string")
    return c.cast("string")


def csv_lines(df: DataFrame, guard: bool = True, skip_private: bool = False) -> DataFrame:
    """One `value` per row; structured cells become JSON, names beginning with _ are left out on demand."""
    fields = [f for f in df.schema if not (skip_private and f.name.startswith("_"))]
    return df.select(F.concat_ws(",", *(T.csv_cell(as_text(f), guard) for f in fields)).alias("value"))


def csv_header(df: DataFrame, skip_private: bool = False) -> str:
    return ",".join(f.name for f in df.schema if not (skip_private and f.name.startswith("_")))


def write_csv(df: DataFrame, path: str, guard: bool = True) -> None:
    """A folder of part files with CRLF line ends; each begins with a byte order mark and the header."""
    lines, header = csv_lines(df, guard), BOM + csv_header(df)
    with_header = lines.mapInPandas(lambda batches: _headed(batches, header), "value string")
    with_header.write.option("lineSep", "\r\n").text(path)


def _headed(batches, header):
    import pandas as pd

    first = True
    for rows in batches:
        if first and len(rows):
            rows, first = pd.concat([pd.DataFrame({"value": [header]}), rows]), False
        yield rows


def tsv_lines(df: DataFrame, link: str | None = None) -> DataFrame:
    """One `value` per row; a link column, if named, comes last as the address alone."""
    fields = sorted(df.schema, key=lambda f: f.name == link)
    cells = (F.regexp_replace(as_text(f), r"^\[[^\]]*\]\(([^)]*)\)$", "$1") if f.name == link else as_text(f) for f in fields)
    return df.select(F.concat_ws("\t", *(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")) for c in cells)).alias("value"))


def tabular(frames: list[DataFrame], cap: int) -> dict[str, Any]:
    """Rows of unlike frames as {columns, rows, truncated}: columns as first seen, at most cap rows."""
    both = union_of_rows(frames)
    rows = both.limit(cap + 1).collect()
    return {"columns": both.columns, "rows": [r.asDict(recursive=True) for r in rows[:cap]], "truncated": len(rows) > cap}


def union_of_rows(frames: list[DataFrame]) -> DataFrame:
    """Rows of unlike columns beside each other; columns in the order in which they're first seen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def markdown_table(df: DataFrame, order: list, limit: int = 200) -> str:
    """A Markdown table of at most `limit` rows, in order."""
    limit = max(1, min(limit, MOST_ROWS))
    rows = df.orderBy(*order).limit(limit).select(F.concat(F.lit("| "), F.concat_ws(" | ", *(T.markdown_cell(as_text(f)) for f in df.schema)), F.lit(" |")).alias("v")).collect()
    head = "| " + " | ".join(df.columns) + " |"
    return "\n".join([head, "|" + " --- |" * len(df.columns), *(r[0] for r in rows)])


class UnsafeSpec(ValueError):
    """The chart specification would load something."""


def safe_spec(spec: Any, inside_data: bool = False, top: bool = True) -> Any:
    """Without links and notes to renderers; refuses what loads from an address or draws images.

    Inline data is left alone: a column may be called url."""
    if isinstance(spec, list):
        return [safe_spec(x, inside_data, False) for x in spec]
    if not isinstance(spec, dict):
        return spec
    out = {}
    for k, v in spec.items():
        if inside_data:
            out[k] = v
            continue
        if k == "url":
            raise UnsafeSpec("data can't be loaded from an address")
        if k in ("href", "usermeta"):
            continue
        if k == "mark" and (v == "image" or isinstance(v, dict) and v.get("type") == "image"):
            raise UnsafeSpec("images aren't drawn")
        if k == "$schema" and (not top or "vega.github.io/schema/" not in str(v)):
            continue
        out[k] = safe_spec(v, k == "values", False)
    return out


def safe_spec_text(text: str) -> str:
    return json.dumps(safe_spec(json.loads(text)))
