"""Dense vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """dot / (norm · norm); null when a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def unit(a: Column) -> Column:
    """The vector scaled to length one, so later cosines are plain dot products."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda v: v.cast("double") / length))
