"""Vector arithmetic on float arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit-length copy; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length == 0, a).otherwise(
        F.transform(a, lambda x: (x / length).cast("float"))
    )


def cosine(a: Column, b: Column) -> Column:
    """NULL where a vector is zero, as it has no direction."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
