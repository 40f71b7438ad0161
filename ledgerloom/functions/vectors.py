"""Vector functions on arrays; products are summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, rescaled: bool = False) -> Column:
    """Cosine, or (1 + cosine) / 2 as some servers report it; null for a zero vector."""
    value = F.try_divide(dot(a, b), norm(a) * norm(b))
    return (value + 1) / 2 if rescaled else value


def literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))
