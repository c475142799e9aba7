"""Weights of terms as column builders, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity(tf: Column) -> Column:
    return tf.cast("double")


def binary(tf: Column) -> Column:
    return F.when(tf > 0, 1.0).otherwise(0.0)


def sublinear(tf: Column) -> Column:
    """1 + ln tf; 0 where the term doesn't occur."""
    return F.when(tf > 0, F.lit(1.0) + F.ln(F.when(tf > 0, tf))).otherwise(0.0)


TF: dict[str, Callable[[Column], Column]] = {"identity": identity, "binary": binary, "sublinear": sublinear}


def idf(n: Column, df: Column) -> Column:
    """ln(n / df); null where either is 0 or null."""
    return F.when((n > 0) & (df > 0), F.ln(n.cast("double") / F.when(df > 0, df)))


FEATURES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "binary": lambda tf, df, n: F.lit(1.0),
    "tfidf": lambda tf, df, n: tf * idf(n, df),
    "btfidf": lambda tf, df, n: idf(n, df),
    "stfidf": lambda tf, df, n: sublinear(tf) * idf(n, df),
}


def choose(registry: dict, name: str, what: str):
    """The entry of a registry; ValueError for an unknown name."""
    if name not in registry:
        raise ValueError(f"unknown {what} {name!r}; known: {', '.join(registry)}")
    return registry[name]
