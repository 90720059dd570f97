"""Vector functions on array<float> columns; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector]).cast("array<double>") if vector else F.array().cast("array<double>")


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a query of the same width; 0 for a zero vector, null for another width or a zero query."""
    length = sum(float(x) * float(x) for x in query) ** 0.5
    if not length:
        return F.lit(None).cast("double")
    value = F.coalesce(dot(vector, literal(query)) / (F.nullif(norm(vector), F.lit(0.0)) * F.lit(length)), F.lit(0.0))
    return F.when(F.size(vector) == len(query), value)


def cosine_eps(vector: Column, query: list[float], eps: float = 1e-9) -> Column:
    """Cosine with both norms raised by a small number, so that zero vectors score 0; null for another width."""
    length = sum(float(x) * float(x) for x in query) ** 0.5 + eps
    return F.when(F.size(vector) == len(query), dot(vector, literal(query)) / ((norm(vector) + eps) * F.lit(length)))


def unit(vector: Column) -> Column:
    n = norm(vector)
    return F.when(n > 0, F.transform(vector, lambda x: (x.cast("double") / n).cast("float"))).otherwise(vector)
