"""Column builders for dense vectors (ARRAY of numbers), computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    """Sum of the products of the components; 0 for empty vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), _zero(), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(d, _zero(), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one has the length 0, or holds a null or NaN."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(length > 0, dot(a, b) / F.when(length > 0, length))
    return F.when(~F.isnan(value), value)


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    # vector and length are bound once as a struct: written into the inner lambda, the length would be computed for every component
    bound = F.array(F.struct(F.transform(v, lambda x: x.cast("double")).alias("v"), F.sqrt(dot(v, v)).alias("l")))
    return F.transform(bound, lambda s: F.when(s["l"] == 0, s["v"]).otherwise(F.transform(s["v"], lambda x: x / F.when(s["l"] != 0, s["l"]))))[0]


def arg_max(v: Column) -> Column:
    """Index of the first largest component; NaN never wins; 0 for an empty vector."""
    clean = F.transform(v, lambda x: F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x.cast("double")))
    return F.coalesce(F.greatest(F.array_position(clean, F.array_max(clean)) - 1, F.lit(0)), F.lit(0)).cast("bigint")
