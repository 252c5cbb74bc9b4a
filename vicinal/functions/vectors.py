"""Vector expressions. Components are doubles before any arithmetic; distances are rounded to 9 places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "dot_product")
LEAST_NORM = 1e-12


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.greatest(F.sqrt(dot(v, v)), F.lit(LEAST_NORM))


def normalised(v: Column) -> Column:
    """v / max(|v|, 1e-12); the norm is bound once a row, not once a component."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / n))[0]


def distance(metric: str, a: Column, b: Column) -> Column:
    """cosine: 1 - cos; l2: Euclidean; dot_product: the negated product, so that smaller is nearer."""
    if metric == "cosine":
        return F.round(F.abs(1 - dot(a, b) / (norm(a) * norm(b))), 9)
    if metric == "l2":
        return F.round(F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)), 9)
    if metric == "dot_product":
        return F.round(-dot(a, b), 9) + F.lit(0.0)
    raise ValueError(f"{metric!r} is not one of {', '.join(METRICS)}")
